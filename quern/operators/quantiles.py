"""Exact values at ranks of large groups, without a task that holds all of a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of equal width into which the span of a group's values is cut before one of them is sorted.
BUCKETS = 1 << 16
#: Bytes, as the planner estimates them, of input whose groups are each sorted by one task.
SORTED = 32 << 20
#: Groups, a row for each of which is sent to all tasks.
FEW = 10_000
#: Smallest value that at least this share of the values doesn't exceed.
MARKS = {name: (lambda n, p=p: F.ceil(n * p)) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
UPPER_MEDIAN = {"median": lambda n: F.floor(n / 2) + 1}


def counted_values(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, v, n): how often each value occurs; null values are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def each_value(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, v, 1) of each value that isn't null, -0.0 as 0.0 like in ``counted_values``; nothing is shuffled to count them."""
    v, kind = F.col(value), df.select(value).schema[0].dataType
    return df.filter(v.isNotNull()).select(*keys, F.when(v == 0, F.lit(0).cast(kind)).otherwise(v).alias("v"), F.lit(1).cast("bigint").alias("n"))


def _small(df: DataFrame) -> bool:
    """Whether the planner takes ``df`` to be at most ``SORTED`` bytes; joins and generated rows are estimated from above or unknown."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SORTED


def _span(rows: DataFrame, on: list[str], *more: Column) -> DataFrame:
    """(on, low, high) of the finite values of each group.

    Exact, so that it is the same whenever it is told: rows are placed once to be counted and once to be taken, and approximate
    quantiles of two tellings may differ.
    """
    finite = F.when(F.abs(F.col("v").cast("double")) < float("inf"), F.col("v").cast("double"))
    return rows.groupBy(*on).agg(F.min(finite).alias("low"), F.max(finite).alias("high"), *more)


def _bucket() -> Column:
    """The bucket of v between low and high, one below for what lies below all finite values and one above for what lies above."""
    v = F.col("v").cast("double")
    place = F.floor(BUCKETS * ((v - F.col("low")) / (F.col("high") - F.col("low"))))
    flat = F.col("low").isNull() | (F.col("high") <= F.col("low")) | (F.col("high") - F.col("low") == float("inf"))
    return F.when(v == float("-inf"), -1).when(F.isnan(v) | (v == float("inf")), BUCKETS + 1).when(flat, 0).otherwise(place)


def _cut_again(rows: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (on, rank, before, v, n) without the buckets that don't hold the rank; before counts what is left of the rest."""
    span = _span(rows, on)
    counts = rows.join(span, on).groupBy(*on, _bucket().alias("bucket")).agg(F.sum("n").alias("held"), F.first("rank").alias("rank"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("held").over(Window.partitionBy(*on).orderBy("bucket"))
    hit = counts.withColumn("upto", upto).filter("upto - held < rank and rank <= upto").select(*on, F.col("bucket").alias("_hit"), (F.col("upto") - F.col("held")).alias("before"))
    return rows.drop("before").join(span.join(hit, on), on).filter(_bucket() == F.col("_hit")).drop("low", "high", "_hit")


def at_ranks(counted: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], few: bool = False) -> DataFrame:
    """One row by group of ``counted`` (keys, v, n; a value may come more than once) with the value at each rank from 1; without keys always one row.

    ``ranks`` maps a column name to the rank as a function of the group's size. Where the planner takes the input to be small, a
    group's values are sorted by one task. Else the span of a group is cut into ``BUCKETS`` of equal width, the buckets are counted
    and those that hold a wanted rank are cut once more by their own span, so that a far value costs one cut; what is left is sorted. Both
    give the same values. Keys may be null. ``few`` says that there are so few groups that a row for each can be sent to all tasks: then,
    as without keys, the values are only shuffled once they are in a wanted bucket.
    """
    if _small(counted):
        order = Window.partitionBy(*keys).orderBy("v")
        rows = counted.select(*keys, "v", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("size"))
        return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= rank(F.col("size")), F.col("v"))).alias(name) for name, rank in ranks.items()])
    return _in_buckets(counted, keys, ranks, few)


def ranked(df: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], value: str = "v") -> DataFrame:
    """``at_ranks`` of the values of a column that aren't null.

    Values of small inputs are counted, as are those of more than ``FEW`` groups; else each row is placed where it is read, and only values in a
    wanted bucket are shuffled. The groups of a large input are counted at once.
    """
    if _small(df.select(*keys, value)):
        return at_ranks(counted_values(df, keys, value), keys, ranks)
    few = not keys or df.filter(F.col(value).isNotNull()).select(*keys).distinct().limit(FEW + 1).count() <= FEW
    return at_ranks((each_value if few else counted_values)(df, keys, value), keys, ranks, few)


def _in_buckets(counted: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], few_groups: bool) -> DataFrame:
    few = F.broadcast if few_groups or not keys else (lambda df: df)  # without keys: one row of edges, a row for each rank
    group = F.struct(*keys) if keys else F.lit(0)  # a struct of nulls equals another, a null doesn't
    grouped = counted.select(group.alias("g"), "v", "n")
    span = _span(grouped, ["g"], F.sum("n").alias("size"))
    placed = grouped.join(few(span), "g").select("g", "n", "size", _bucket().alias("bucket"))
    order = Window.partitionBy("g").orderBy("bucket")
    counts = placed.groupBy("g", "bucket").agg(F.sum("n").alias("held"), F.first("size").alias("size")).withColumn("upto", F.sum("held").over(order))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("size")).cast("bigint").alias("rank")) for name, rank in ranks.items()])
    hit = counts.select("g", "bucket", (F.col("upto") - F.col("held")).alias("before"), "upto", F.inline(wanted)).filter("before < rank and rank <= upto")
    hits = hit.groupBy("g").agg(F.collect_list(F.struct("bucket", "name", "rank", "before")).alias("hits"), F.collect_set("bucket").alias("places"))
    taken = grouped.join(few(span.drop("size").join(few(hits), "g")), "g").withColumn("bucket", _bucket()).filter(F.array_contains("places", F.col("bucket")))
    taken = taken.select("g", "v", "n", "bucket", F.inline("hits").alias("at", "name", "rank", "before")).filter("at = bucket").drop("at", "bucket")
    left = _cut_again(taken.groupBy("g", "name", "rank", "before", "v").agg(F.sum("n").alias("n")), ["g", "name"])
    inside = Window.partitionBy("g", "name").orderBy("v")
    found = left.withColumn("at", F.col("before") + F.sum("n").over(inside)).filter("at >= rank")
    values = [F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]
    if not keys:
        return found.agg(*values)
    return found.groupBy("g").agg(*values).select("g.*", *ranks)
