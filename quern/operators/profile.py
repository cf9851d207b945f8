"""Diagnosis of exports whose columns nobody named: roles of columns, profile of a table, timings in log text."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import normalize_header, to_number, truncate
from quern.operators import table

# Words of headers by what a column with them holds; the first letters of a statement; units and their ms.
HEADER_WORDS = {
    "statement": "sql statement stmt query command operation anweisung befehl abfrage sentencia consulta comando instrucao requete commande".split(),
    "duration": (
        "dur(ation)? elapsed latency exec(ution)?[_\\s-]?time runtime response[_\\s-]?time wait waittime time[_\\s-]?(ms|sec|s) ms msec millis seconds? secs? cost "
        "total[_\\s-]?time db[_\\s-]?time cpu dauer laufzeit zeit antwortzeit wartezeit ausfuhrungszeit duracion duracao tiempo tempo latencia duree temps durata duur tijd"
    ).split(" "),
    "count": (
        "count calls executions execs invocations rows? records? reads? fetch(es)? buffer[_\\s-]?gets gets hits anzahl aufrufe saetze datensaetze zeilen "
        "cantidad llamadas filas registros nombre appels lignes"
    ).split(" "),
    "timestamp": (
        "time(stamp)? date datetime when logged[_\\s-]?at created[_\\s-]?at start(ed)? end(ed)? zeitstempel datum uhrzeit beginn ende fecha hora data horario heure"
    ).split(" "),
    "status": (
        "status state severity level result outcome rc return[_\\s-]?code err(or)?[_\\s-]?code type zustand schweregrad ergebnis meldungstyp typ "
        "estado resultado nivel gravedad etat resultat niveau"
    ).split(" "),
}
EXECUTION_WORDS = "count calls executions execs invocations occurrences freq(uency)? anzahl aufrufe ausfuhrungen cantidad llamadas ejecuciones appels".split()
STATEMENT = r"(?i)^\s*\(?\s*(select|insert|update|delete|merge|with|upsert|call|exec|execute|create|alter|drop|truncate|fetch|open)\b"
UNITS = [("us", r"(?i)\b(micro|us|usec)\b", 0.001), ("ns", r"(?i)\b(ns|nanos?)\b", 0.000001), ("s", r"(?i)^(?!.*\bms\b).*\b(s|sec|secs|second|seconds)\b", 1000.0), ("min", r"(?i)\b(min|mins|minutes?)\b", 60000.0)]
UNIT_WORD = r"(?i)\b(ms|msec|millis|micro|us|usec|ns|nanos?|s|sec|secs|second|seconds|min|mins|minutes?)\b"
TIMED = r"(?i)(\d+(?:[.,]\d+)?)\s*(ms|msec|millis(?:econds)?|s|sec|secs|seconds?)\b"
TIMING_WORD = r"(?i)\b(took|duration|elapsed|latency|exec|runtime|cost|time)\b"
NEW_EVENT = re.compile(r"^\s*(\[|\d{4}-\d{2}-\d{2}|\d{2}[:/]\d{2}|(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b)", re.I)
VERB = re.compile(r"\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b", re.I)
CLAUSE = re.compile(
    r"^\s*(FROM|WHERE|AND|OR|JOIN|INNER|LEFT|RIGHT|FULL|OUTER|CROSS|GROUP|ORDER|HAVING|LIMIT|OFFSET|UNION|ON|SET|VALUES|INTO|WITH|SELECT|CASE|WHEN|THEN|ELSE|END|FETCH|RETURNING|[(),])", re.I
)
FIRST_WORD = re.compile(r"\b(SELECT|INSERT|UPDATE|DELETE|MERGE|WITH)\b", re.I)
#: Lines that a statement may span, and that may lie between it and its timing.
REACH = 40
#: Line numbers of one block in which statements are put together.
BLOCK = 4096
SHORTEST_SHAPE = 12


def words(kind: list[str]) -> str:
    return rf"(?i)\b({'|'.join(kind)})\b"


def unit(header: Column) -> Column:
    """(label, to_ms, stated): the time unit that a header names, ms if it names none."""
    told = [F.when(header.rlike(pattern), F.struct(F.lit(label).alias("label"), F.lit(ms).alias("to_ms"))) for label, pattern, ms in UNITS]
    found = F.coalesce(*told, F.struct(F.lit("ms").alias("label"), F.lit(1.0).alias("to_ms")))
    return F.struct(found["label"].alias("label"), found["to_ms"].alias("to_ms"), header.rlike(UNIT_WORD).alias("stated"))


def column_roles(df: DataFrame) -> DataFrame:
    """One row by column: place (from 1), column_name, role, basis, unit, to_ms, unit_stated, executions (a row stands for that many).

    Roles by the first rule that holds: statement (40 % of the values begin as one, or a header word with long texts),
    duration and count (80 % numbers and a header word), numeric, timestamp, status, text. Where no column is a duration
    the numeric one with the widest spread that passes the vetoes of ``guessed_duration`` is guessed to be. All values count.
    """
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns, 1)], "place int, column_name string")
    # shares are told row by row: counting by value first would shuffle all of a column of statements
    text = lambda c: F.col(f"`{c}`").cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("cell"), table.is_number(df, c).alias("number")) for c in df.columns])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    told = df.select(F.inline(cells)).filter("trim(cell) != ''").groupBy("column_name").agg(
        share(F.col("number")).alias("numbers"), share(F.col("cell").rlike(STATEMENT)).alias("statements"), F.avg(F.length("cell")).alias("length")
    )
    header = normalize_header(F.col("column_name"))
    known = names.join(F.broadcast(told), "column_name", "left").fillna(0.0, ["numbers", "statements", "length"]).withColumn("h", header)
    says = lambda kind: F.col("h").rlike(words(HEADER_WORDS[kind]))
    numeric = F.col("numbers") >= 0.8
    rules = [
        (F.col("statements") >= 0.4, "statement", "values"), (says("statement") & (F.col("length") > 20) & (F.col("numbers") < 0.3), "statement", "header"),
        (numeric & says("duration"), "duration", "header and values"), (numeric & says("count"), "count", "header and values"), (numeric, "numeric", "values"),
        (says("timestamp"), "timestamp", "header"), (says("status"), "status", "header"),
    ]
    chosen = F.coalesce(*[F.when(c, F.struct(F.lit(role).alias("role"), F.lit(basis).alias("basis"))) for c, role, basis in rules], F.struct(F.lit("text").alias("role"), F.lit("no match").alias("basis")))
    named = known.withColumn("r", chosen).select("place", "column_name", "h", F.col("r.role").alias("role"), F.col("r.basis").alias("basis"))
    named = df.sparkSession.createDataFrame(named.collect(), named.schema)  # a row for each column
    guess = None
    if named.filter("role = 'duration'").isEmpty():
        guesses = table.guessed_duration(df, df.columns).filter("guessed_duration").select("column_name", "spread").join(F.broadcast(named.filter("role = 'numeric'").select("column_name", "place")), "column_name")
        guess = guesses.agg(F.max(F.struct("spread", (-F.col("place")).alias("p")))["p"].alias("guess"))
    picked = F.coalesce(F.col("place") == -F.col("guess"), F.lit(False)) if guess is not None else F.lit(False)
    whole = (named if guess is None else named.crossJoin(F.broadcast(guess))).withColumn("u", unit(F.col("h")))
    return whole.select(
        "place", "column_name", F.when(picked, "duration").otherwise(F.col("role")).alias("role"), F.when(picked, "guessed by spread").otherwise(F.col("basis")).alias("basis"),
        F.col("u.label").alias("unit"), F.col("u.to_ms").alias("to_ms"), F.col("u.stated").alias("unit_stated"),
        ((F.col("role") == "count") & F.col("h").rlike(words(EXECUTION_WORDS))).alias("executions"),
    )


def profile(df: DataFrame, top: int = 10) -> DataFrame | None:
    """(section, item, n, ms): what a trace export says, by the columns that ``column_roles`` finds; None for a plain data table.

    Sections: columns, timing (marks in ms), slowest, statement, anti-pattern, status, window. Only the roles, a row
    for each column of the schema, come to the driver.
    """
    roles = column_roles(df).orderBy("place").collect()
    first = {r["role"]: r for r in reversed(roles)}
    duration, statement, status, stamp = (first.get(k) for k in ("duration", "statement", "status", "timestamp"))
    calls = next((r["column_name"] for r in roles if r["executions"]), None)
    if duration is None and statement is None:
        return None
    row = lambda section, item, n, ms: (F.lit(section).alias("section"), item.alias("item"), n.cast("bigint").alias("n"), ms.cast("double").alias("ms"))
    none = F.lit(None)
    told = [df.sparkSession.createDataFrame([("columns", f"{r['column_name']}: {r['role']} ({r['basis']})", r["place"], None) for r in roles], "section string, item string, n bigint, ms double")]
    if duration is not None:
        timed = df.withColumn("_ms", table.number(df, duration["column_name"]) * duration["to_ms"])
        marks = table.analyze_value(timed, "_ms")
        pairs = F.array(*[F.struct(F.lit(m).alias("item"), F.col(m).cast("double").alias("ms")) for m in ("total", "avg", "p50", "p95", "p99", "max")])
        told.append(marks.select("n", F.inline(pairs)).select(*row("timing", F.col("item"), F.col("n"), F.col("ms"))))
        item = F.col(f"`{(statement or roles[0])['column_name']}`").cast("string")
        told.append(timed.filter("_ms is not null").select(*row("slowest", truncate(item), none, F.col("_ms"))).orderBy(F.desc("ms"), "item").limit(top))
        if statement is not None:
            groups = table.statement_groups(timed, statement["column_name"], "_ms", calls)
            told.append(groups.orderBy(F.desc("total_ms"), "shape").limit(top).select(*row("statement", F.col("shape"), F.col("calls"), F.col("total_ms"))))
            told.append(table.anti_patterns(groups).select(*row("anti-pattern", F.col("rule"), F.col("calls"), F.col("total_ms"))))
    if status is not None:
        told.append(table.status_breakdown(df, status["column_name"]).select(*row("status", F.col("status"), F.col("n"), none)))
    if stamp is not None:
        at = F.col(f"`{stamp['column_name']}`").cast("string").try_cast("timestamp")
        ends = df.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(at).alias("n"))
        pairs = F.array(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")])
        told.append(ends.select("n", F.explode(pairs).alias("item")).select(*row("window", F.col("item"), F.col("n"), none)))
    return reduce(DataFrame.unionByName, told)


def _statement(lines: dict[int, str], at: int) -> str | None:
    """The statement that the timing on line ``at`` belongs to: on it, else below, else above; None if there is none."""

    def nearest(numbers) -> int | None:
        for k in numbers:
            line = lines.get(k, "")
            if line.strip() and VERB.search(line):
                return k
            if not line.strip() or NEW_EVENT.match(line):
                return None
        return None

    start = at if VERB.search(lines[at]) else nearest(range(at + 1, at + REACH + 1))
    if start is None:
        start = nearest(range(at - 1, at - REACH - 1, -1))
    if start is None:
        return None
    parts = [lines[start][FIRST_WORD.search(lines[start]).start() :]]
    for k in range(start + 1, start + REACH):
        line = lines.get(k, "")
        if not line.strip() or NEW_EVENT.match(line) or not (CLAUSE.match(line) or line[0].isspace()):
            break
        parts.append(line.strip())
        if line.rstrip().endswith(";"):
            break
    return " ".join(" ".join(parts).split())


def inline_timings(lines: DataFrame) -> DataFrame:
    """(file, line_no, ms, raw, statement) of the ``lines`` (file, line_no, raw) that state how long something took.

    Seconds count only beside a timing word. The statement of a timing is put together from the lines around it,
    inside blocks of ``BLOCK`` line numbers with the lines of their borders copied. Null lines count as empty.
    """
    margin = 2 * REACH
    spread = F.array_distinct(F.array(*[F.floor((F.col("line_no") + k) / BLOCK) for k in (-margin, 0, margin)]))
    near = lines.select("file", "line_no", F.coalesce("raw", F.lit("")).alias("raw"))
    figure = F.regexp_replace(F.regexp_extract("raw", TIMED, 1), ",", ".").try_cast("double")
    seconds = F.lower(F.regexp_extract("raw", TIMED, 2)).startswith("s")
    ms = F.when(~seconds, figure).when(F.col("raw").rlike(TIMING_WORD), figure * 1000)
    dealt = near.select("*", ms.alias("ms"), F.explode(spread).alias("block"))

    def put_together(part: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(part["line_no"], part["raw"], strict=True))
        timed = part[part["ms"].notna() & (part["line_no"] // BLOCK == part["block"])]
        rows = [(r.file, r.line_no, r.ms, r.raw, _statement(held, r.line_no)) for r in timed.itertuples(index=False)]
        return pd.DataFrame(rows, columns=["file", "line_no", "ms", "raw", "statement"])

    return dealt.groupBy("file", "block").applyInPandas(put_together, "file string, line_no long, ms double, raw string, statement string")


def timed_statements(timings: DataFrame) -> DataFrame:
    """The statement groups of ``inline_timings``; shapes under ``SHORTEST_SHAPE`` characters say nothing."""
    return table.statement_groups(timings, "statement", "ms").filter(F.length("shape") >= SHORTEST_SHAPE)
