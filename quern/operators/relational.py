"""Row-level upkeep of tables: upserts, pending work, retention, latest matches, cascades, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.lineage import cut


def upsert(table: DataFrame, rows: DataFrame, key: list[str], at: str, ignore: bool = False) -> DataFrame:
    """``table`` with ``rows`` merged in by ``key``: of rows with one key the latest ``at`` stays, or (ignore) the earliest in the table."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_new"), F.col(at)] if ignore else [F.desc("_new"), F.desc(at)]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r", "_new")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet, so a batch that is run again goes on where it stopped."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def expired(rows: DataFrame, at: str, now: Column, days: int, hits: str | None = None, least: int = 2) -> DataFrame:
    """Rows older than ``days`` that were used less than ``least`` times (where ``hits`` counts uses)."""
    old = F.col(at) < now - F.expr(f"interval {days} days")
    return rows.filter(old & (F.col(hits) < least) if hits else old)


def keep_most_used(rows: DataFrame, n: int, last_used: str, hits: str, key: str) -> DataFrame:
    """What a cache of ``n`` entries holds: the latest used, then the most used."""
    return rows.orderBy(F.desc(last_used), F.desc(hits), key).limit(n)


def latest_match(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` that has the same keys, nulls being equal."""
    best = right.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(value, order).alias(value))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(best, same, "left").drop(*[f"_{k}" for k in keys])


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """What is left of each child table once the rows that name one of the ``parents`` (key) are gone."""
    gone = parents.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in children.items()}


def either_side(relations: DataFrame, seeds: DataFrame, key: str = "entity") -> DataFrame:
    """Relations (source, target) that touch a seed on either side: two equi-joins in place of one join with OR."""
    sides = [relations.join(seeds.select(F.col(key).alias(c)).distinct(), c, "left_semi") for c in ("source", "target")]
    sides = [x.select(*relations.columns) for x in sides]
    return sides[0].union(sides[1]).distinct()


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, old, new): what was added, removed or changed between two snapshots."""
    joined = before.select(key, F.col(value).alias("old")).join(after.select(key, F.col(value).alias("new")), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return joined.withColumn("change", change).filter("change is not null").select(key, "change", "old", "new")


def mapped(column: Column, cases: dict[str, str], other: Column) -> Column:
    """A backfill: each value of ``cases`` replaced, the others given by ``other``."""
    found = F.coalesce(*[F.when(column == k, v) for k, v in cases.items()])
    return F.coalesce(found, other)


def unreachable(nodes: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """The nodes (node) that no chain of edges (source, target) leads to from ``start``. Each round takes one step from the nodes found last."""
    reached = fresh = cut(nodes.select("node").distinct().filter(F.col("node") == start))
    edges = edges.select("source", "target").distinct()
    while not fresh.isEmpty():
        step = edges.join(fresh, edges["source"] == fresh["node"]).select(F.col("target").alias("node")).distinct()
        fresh = cut(step.join(reached, "node", "left_anti"))
        reached = cut(reached.unionByName(fresh))
    return nodes.select("node").distinct().join(reached, "node", "left_anti")


def mark_generated(files: DataFrame, messages: DataFrame, column: str = "generated_files") -> DataFrame:
    """``files`` (id, source, ...) with source ``generated`` where a message lists the file.

    The column holds a JSON array of objects with file_id, or a JSON string that holds such an array; ids of another
    form than a UUID's and other values are passed over.
    """
    array = F.from_json(F.concat(F.lit('{"x":'), F.col(column), F.lit("}")), "x string")["x"]
    array = F.when(F.ltrim(array).startswith("["), array)  # an object alone would be read as an array of one
    listed = messages.select(F.explode(F.from_json(array, "array<struct<file_id: string>>")).alias("entry"))
    ids = listed.select(F.lower("entry.file_id").alias("_id")).filter(F.col("_id").rlike("^[0-9a-f-]{36}$")).distinct()
    joined = files.join(ids, F.lower("id") == F.col("_id"), "left")
    return joined.withColumn("source", F.when(F.col("_id").isNotNull(), "generated").otherwise(F.col("source"))).drop("_id")
