"""Connected components of a link table, as joins and aggregates over shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch


def _roots(to: DataFrame, scratch: Scratch) -> DataFrame:
    """``to`` (id, component), every component an id and no larger than its id, followed up to the ids that name themselves.

    Each round halves the way to them.
    """
    while True:
        above = to.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = to.join(above, "component").select("id", F.col("further").alias("component"), (F.col("further") < F.col("component")).alias("moved"))
        after = scratch.keep(after, "roots")
        to = after.select("id", "component")
        if not after.filter("moved").limit(1).count():
            return to


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for each id that occurs in ``links`` (a, b) the smallest id it is connected to.

    Every round each id names the smallest among itself and its neighbours, and the ids of the trees that this makes become
    one. Only links between different ones are carried on, each once, so their number falls round by round, and that of
    the ids is halved at least. Labels and links stay in the cluster; only whether any are left reaches the driver.
    """
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = scratch.keep(links.filter("a != b").select(*ends("a", "b")).distinct(), "edges")
    labels = None
    while True:
        both = left.union(left.select("b", "a")).toDF("id", "near")
        to = scratch.keep(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("component")), "lower")
        to = _roots(to, scratch)
        if labels is None:
            labels = to
        else:
            step = to.select(F.col("id").alias("component"), F.col("component").alias("root"))
            labels = scratch.keep(labels.join(step, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        of = lambda end: to.select(F.col("id").alias(end), F.col("component").alias(f"to_{end}"))
        between = left.join(of("a"), "a").join(of("b"), "b").filter("to_a != to_b")
        left = scratch.keep(between.select(*ends("to_a", "to_b")).distinct(), "edges")
        if not left.limit(1).count():
            return labels
