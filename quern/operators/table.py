"""Analysis of tables whose columns the caller names: filters, exact statistics, groups, census, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegralType, NumericType, TimestampType

from quern.functions.text import fingerprint, is_sql, looks_like_date, rough_shape, to_number
from quern.operators.quantiles import MARKS, UPPER_MEDIAN, at_ranks, counted_values, each_value, ranked
from quern.plans.lineage import cut

# Rules over statement shapes (id, confidence, what must match, what must not).
ANTI_PATTERNS = [
    ("select-star", "high", [r"\bSELECT\s+\*"], []),
    ("no-where", "high", [r"^SELECT\b", r"\bFROM\b"], [r"\bWHERE\b", r"\bCOUNT\s*\("]),
    ("leading-wildcard", "high", [r"\bLIKE\s+'?%|\bLIKE\s+\?\s*\|\|"], []),
    ("function-on-column", "high", [r'\bWHERE\b[^;]*\b(UPPER|LOWER|SUBSTR|SUBSTRING|TRIM|CAST|CONVERT|TO_CHAR)\s*\(\s*[A-Z0-9_."]+\s*\)\s*(=|<|>|LIKE)'], []),
    ("not-in", "low", [r"\bNOT\s+(IN|EXISTS)\b"], []),
    ("or-filter", "low", [r"\bWHERE\b[^;]*\bOR\b"], []),
    ("cartesian", "high", [r'\bFROM\s+[A-Z0-9_."]+\s*,\s*[A-Z0-9_."]+'], [r"\bWHERE\b"]),
    ("order-by-unbounded", "high", [r"\bORDER\s+BY\b"], [r"\b(LIMIT|TOP|FETCH FIRST|ROWNUM|UP TO)\b"]),
    ("sap-fae", "high", [r"\bFOR ALL ENTRIES\b"], []),
    ("select-single", "low", [r"^SELECT SINGLE\b"], []),
]
NUMERIC_SHARE = 0.8
#: Rows of a range in which neighbouring values are compared.
ROWS = 1 << 16


def column(df: DataFrame, which: int | str) -> Column:
    """A column by name or by its place from 1; a place outside the table is an error that says so."""
    if isinstance(which, int):
        if not 1 <= which <= len(df.columns):
            raise ValueError(f"column {which} is outside the table's 1 to {len(df.columns)}")
        which = df.columns[which - 1]
    return F.col(f"`{which}`")


def number(df: DataFrame, which: int | str) -> Column:
    """A column as double; what isn't of a numeric type goes through to_number as text."""
    name = df.columns[which - 1] if isinstance(which, int) else which
    cell = column(df, which)
    return cell.cast("double") if isinstance(df.schema[name].dataType, NumericType) else to_number(cell.cast("string"))


def select_rows(df: DataFrame, value: int | str | None = None, where: tuple[int | str, str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose ``where`` cell contains a text (any case) and whose value lies in the range; a range drops non-numbers."""
    if where is not None:
        df = df.filter(F.lower(column(df, where[0]).cast("string")).contains(where[1].lower()))
    if value is not None and (low is not None or high is not None):
        v = number(df, value)
        bounds = [v >= low] * (low is not None) + [v <= high] * (high is not None)
        df = df.filter(reduce(lambda a, b: a & b, bounds))
    return df


def _stats() -> list[Column]:
    return [F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 4).alias("avg"), F.max("v").alias("max")]


def analyze_value(df: DataFrame, value: int | str, **rows) -> DataFrame:
    """One row of statistics of the selected rows' value column."""
    chosen = select_rows(df, value, **rows)
    v = chosen.select(number(df, value).alias("v")).filter("v is not null")
    marks = ranked(v, [], MARKS)
    return v.agg(*_stats()).crossJoin(F.broadcast(marks)).select("n", "total", "avg", *MARKS, "max")


def summarize_by(df: DataFrame, group: str, value: int | str) -> DataFrame:
    """The statistics of a value column in each group."""
    v = df.select(F.col(group), number(df, value).alias("v")).filter("v is not null")
    marks = ranked(v, [group], MARKS).withColumnRenamed(group, "_g")
    told = v.groupBy(group).agg(*_stats())
    return told.join(marks, F.col(group).eqNullSafe(F.col("_g"))).select(group, "n", "total", "avg", *MARKS, "max")


def top_rows(df: DataFrame, value: int | str, n: int, ties: list[str], **rows) -> DataFrame:
    """The ``n`` selected rows with the largest value; ``ties`` order rows of equal value."""
    return select_rows(df, value, **rows).withColumn("value", number(df, value)).filter("value is not null").orderBy(F.desc("value"), *ties).limit(n)


def analyze_group(df: DataFrame, group: int | str, value: int | str, **rows) -> DataFrame:
    """By group (statements by their shape; blanks left out): rows, total, average over all rows, largest value."""
    key = column(df, group).cast("string")
    chosen = select_rows(df, value, **rows).select(F.trim(key).alias("k"), number(df, value).alias("v")).filter("k != ''")
    shape = F.when(is_sql(F.col("k")), fingerprint(F.col("k"))).otherwise(F.col("k"))
    total = F.coalesce(F.sum("v"), F.lit(0.0))
    return chosen.groupBy(shape.alias("group_key")).agg(
        F.count("*").alias("n"), F.round(total, 2).alias("total"), F.round(total / F.count("*"), 4).alias("avg"), F.max("v").alias("max")
    )


def _numeric(df: DataFrame, name: str) -> Column | None:
    """A column whose text as a number is its own value (null if that isn't finite), None for columns of other types."""
    kind, cell = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, IntegralType):
        return cell.cast("double")
    return F.when(F.abs(cell) < float("inf"), cell) if isinstance(kind, DoubleType) else None


def is_number(df: DataFrame, name: str) -> Column:
    """Whether a cell's text is a number; one that begins with neither a sign, a digit nor a separator isn't looked at further."""
    value = _numeric(df, name)
    if value is not None:
        return value.isNotNull()
    cell = F.col(f"`{name}`").cast("string")
    begin = F.ascii(F.trim(cell))
    return F.when(begin.between(43, 57) | (begin == 95), to_number(cell).isNotNull()).otherwise(False)


def _cells(df: DataFrame, name: str) -> DataFrame:
    """(column_name, cell, v, dated, n): each distinct non-blank cell of a column as text, as a number and whether it looks like a date.

    Values are counted before they become text, where equal ones have equal texts: a zero's text tells its sign.
    """
    kind, value, number_of = df.schema[name].dataType, F.col(f"`{name}`"), _numeric(df, name)
    cell, dated = value.cast("string"), F.lit(False)
    if isinstance(kind, DoubleType):
        keys, cell = [value, F.when(value == 0, cell).alias("_zero")], F.coalesce("_zero", cell)
    elif number_of is not None or isinstance(kind, (BooleanType, DateType, TimestampType)):
        keys = [value]
    else:
        keys, cell, df = [cell.alias(name)], value, df.filter(F.trim(cell) != "")
    if number_of is None:
        number_of, dated = to_number(cell), looks_like_date(cell)
    counted = df.filter(value.isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    return counted.select(F.lit(name).alias("column_name"), cell.alias("cell"), number_of.alias("v"), dated.alias("dated"), F.col("_n").alias("n"))


def census(df: DataFrame, most: int = 12) -> DataFrame:
    """One row by column: non-empty and distinct cells, kind, three samples, and what suits the kind.

    Kinds: number (80 % of the cells are; min, upper median, max, sum), datetime (a quarter of the cells, and at least
    5 or all of them, look like dates) or text (average length; the values with their counts where there are at most
    ``most``). Samples are the first distinct cells in text order. Each column is read and counted by value by itself; the
    distinct cells of columns that aren't numbers by type are told apart once and kept. Medians of the others come from their rows.
    """
    counted = {c: _cells(df, c) for c in df.columns}
    plain = [c for c in df.columns if _numeric(df, c) is not None]
    values = [each_value(df.select(F.lit(c).alias("column_name"), _numeric(df, c).alias("v")), ["column_name"]) for c in plain]
    first = [counted[c].orderBy("cell").limit(max(3, most + 1)).select("column_name", "cell", "n") for c in plain]
    parts = [counted[c] for c in plain]
    if len(plain) < len(df.columns):
        texts = cut(reduce(DataFrame.unionAll, [counted[c] for c in df.columns if c not in plain]))
        values.append(texts.filter("v is not null").select("column_name", "v", "n"))
        place = F.row_number().over(Window.partitionBy("column_name").orderBy("cell"))
        first.append(texts.select("column_name", "cell", "n", place.alias("_r")).filter(F.col("_r") <= max(3, most + 1)).drop("_r"))
        parts.append(texts)
    times = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    told = reduce(DataFrame.unionAll, parts).groupBy("column_name").agg(
        F.sum("n").alias("non_empty"), F.count("*").alias("distinct_cells"), times(F.col("v").isNotNull()).alias("numeric"), times(F.col("dated")).alias("dated"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("n")), 2).alias("sum"),
        F.round(F.sum(F.length("cell") * F.col("n")) / F.sum("n"), 4).alias("avg_length"),
    )
    dated = F.col("dated") >= F.least(F.col("non_empty"), F.greatest(F.lit(5), F.col("non_empty") / 4))
    told = told.withColumn("kind", F.when(F.col("numeric") >= NUMERIC_SHARE * F.col("non_empty"), "number").when(dated, "datetime").otherwise("text"))
    medians = at_ranks(reduce(DataFrame.unionAll, values), ["column_name"], UPPER_MEDIAN, few=True)
    cells = F.array_sort(F.collect_list(F.struct("cell", "n")))
    leading = reduce(DataFrame.unionAll, first).groupBy("column_name").agg(cells.alias("leading"))
    samples = F.array_join(F.slice("leading.cell", 1, 3), " | ").alias("samples")
    listed = F.array_sort(F.transform("leading", lambda x: F.struct((-x["n"]).alias("n"), x["cell"].alias("cell"))))
    few = (F.col("kind") == "text") & (F.col("distinct_cells") <= most)
    value_counts = F.when(few, F.array_join(F.transform(listed, lambda x: F.concat(x["cell"], F.lit("="), (-x["n"]).cast("string"))), ", ")).alias("value_counts")
    only = [F.when(F.col("kind") == "number", F.col(c)).alias(c) for c in ("min", "max", "sum", "median")]
    whole = told.join(medians, "column_name", "left").join(leading, "column_name", "left")
    return whole.select("column_name", "non_empty", "distinct_cells", "kind", *only, "avg_length", samples, value_counts)


def status_breakdown(df: DataFrame, status: str, most: int = 12) -> DataFrame:
    """The commonest values of a column and their share of all rows with one."""
    counted = df.filter(F.col(status).isNotNull()).groupBy(F.col(status).cast("string").alias("status")).agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("whole"))
    shared = counted.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col("n") / F.col("whole"), 4)).drop("whole")
    return shared.orderBy(F.desc("n"), "status").limit(most)


def time_window(df: DataFrame, ts: str, key: str) -> DataFrame:
    """First and last time, the rows that have them (smallest key among ties) and the seconds between."""
    at = F.col(ts).cast("timestamp")
    row = F.struct(at.alias("t"), F.col(key).alias("k"))
    last = F.struct(at.alias("t"), (-F.col(key)).alias("k"))
    told = df.filter(at.isNotNull()).agg(F.min(row).alias("a"), F.max(last).alias("b"), F.count("*").alias("n"))
    seconds = F.unix_timestamp("b.t") - F.unix_timestamp("a.t")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return told.select("n", stamp("a.t").alias("first_at"), F.col("a.k").alias("first_key"), stamp("b.t").alias("last_at"), (-F.col("b.k")).alias("last_key"), seconds.alias("span_s"))


def slow_rows(df: DataFrame, value: str, key: str, factor: float = 2.0, n: int = 10) -> DataFrame:
    """The slowest rows above ``factor`` times the median."""
    stats = ranked(df, [], {"p50": MARKS["p50"]}, value)
    above = df.crossJoin(F.broadcast(stats)).filter(F.col(value) > factor * F.col("p50"))
    return above.select(key, value, "p50", F.round(F.col(value) / F.col("p50"), 4).alias("times_p50")).orderBy(F.desc(value), key).limit(n)


def statement_groups(df: DataFrame, sql: str, duration: str, executions: str | None = None) -> DataFrame:
    """By statement shape: calls (times an execution count, at least 1), total and largest duration, mean by call.

    Statements are grouped by a cheap rough shape first; only the distinct ones go through the whole chain.
    """
    calls = F.greatest(F.lit(1), F.coalesce(F.col(executions).cast("bigint"), F.lit(1))) if executions else F.lit(1)
    rough = df.filter(is_sql(F.col(sql))).select(rough_shape(F.col(sql)).alias("rough"), calls.alias("c"), number(df, duration).alias("ms"))
    few = rough.groupBy("rough").agg(F.sum("c").alias("c"), F.sum("ms").alias("total"), F.max("ms").alias("most"))
    told = few.groupBy(fingerprint(F.col("rough")).alias("shape")).agg(F.sum("c").cast("bigint").alias("calls"), F.round(F.sum("total"), 2).alias("total_ms"), F.max("most").alias("max_ms"))
    return told.withColumn("mean_ms", F.round(F.col("total_ms") / F.col("calls"), 4))


def n_plus_one(groups: DataFrame, calls: int = 100, mean_ms: float = 50) -> DataFrame:
    """Statement groups called often and cheaply, as loops over single rows do."""
    return groups.filter((F.col("calls") >= calls) & (F.col("mean_ms") < mean_ms))


def anti_patterns(groups: DataFrame) -> DataFrame:
    """(rule, confidence, shapes, calls, total_ms) of the rules that statement shapes fall under."""
    hits = []
    for name, confidence, must, never in ANTI_PATTERNS:
        held = reduce(lambda a, b: a & b, [F.col("shape").rlike(p) for p in must] + [~F.col("shape").rlike(p) for p in never])
        hits.append(F.when(held, F.struct(F.lit(name).alias("rule"), F.lit(confidence).alias("confidence"))))
    found = groups.select("shape", "calls", "total_ms", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.groupBy("h.rule", "h.confidence").agg(F.count("*").alias("shapes"), F.sum("calls").alias("calls"), F.round(F.sum("total_ms"), 2).alias("total_ms"))


def guessed_duration(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column whether it could be a duration: spread far above its middle, not a running number.

    A column is vetoed when it never falls, when it is nearly unique whole numbers, or when its mean is
    under 1.2 times its upper median. Every answer is marked as a guess, and all values of 0 or more count.
    Falls are found inside ranges of ``ROWS`` rows, then between the ranges.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), number(df, c).alias("v")) for c in columns])
    long = df.select(F.monotonically_increasing_id().alias("at"), F.inline(pairs)).filter("v >= 0")
    inside = Window.partitionBy("column_name", "range").orderBy("at")
    fell = long.withColumn("range", F.floor(F.col("at") / ROWS)).withColumn("fell", (F.col("v") < F.lag("v").over(inside)).cast("int"))
    ranges = fell.groupBy("column_name", "range").agg(F.coalesce(F.sum("fell"), F.lit(0)).alias("fell"), F.min_by("v", "at").alias("first"), F.max_by("v", "at").alias("last"))
    border = F.coalesce((F.col("first") < F.lag("last").over(Window.partitionBy("column_name").orderBy("range"))).cast("int"), F.lit(0))
    falls = ranges.withColumn("border", border).groupBy("column_name").agg((F.sum("fell") + F.sum("border")).alias("falls"))
    counted = counted_values(long, ["column_name"])
    stats = counted.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct_values"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.min((F.col("v") == F.floor("v")).cast("int")).alias("whole")
    )
    told = stats.join(falls, "column_name").join(at_ranks(counted, ["column_name"], UPPER_MEDIAN, few=True), "column_name")
    serial = (F.col("whole") == 1) & (F.col("distinct_values") > 0.95 * F.col("n"))
    fits = (F.col("n") >= 10) & (F.col("falls") > 0) & ~serial & (F.col("median") > 0) & (F.col("mean") >= 1.2 * F.col("median")) & (F.col("max") > 10 * F.col("mean"))
    return told.select("column_name", "n", F.round(F.col("max") / F.col("mean"), 4).alias("spread"), fits.alias("guessed_duration"), F.lit("spread").alias("basis"))
