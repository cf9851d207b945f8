"""Analysis of traces: steps are rows (trace_id, step_id, parent_id, type, status, duration, tokens, cost)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.lineage import cut
from quern.plans.shares import shares

#: Edges of a trace up to which one task walks it.
TOGETHER = 100_000


def rollup(steps: DataFrame) -> DataFrame:
    """By trace: steps, errors, success rate in percent, duration, tokens and cost."""
    failed = F.count_if(F.col("status") == "error")
    return steps.groupBy("trace_id").agg(
        F.count("*").alias("steps"), failed.alias("errors"), F.round(100.0 * (F.count("*") - failed) / F.count("*"), 2).alias("success_rate"),
        F.round(F.sum("duration"), 2).alias("duration"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"),
    )


def cost_by(steps: DataFrame, kind: str) -> DataFrame:
    """By type (or model): started steps, tokens, cost, and mean duration of those that ended."""
    ended = F.when(F.col("status") != "running", F.col("duration"))
    return steps.groupBy(kind).agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.avg(ended), 4).alias("mean_duration"))


def error_summary(steps: DataFrame) -> DataFrame:
    return steps.filter("status = 'error'").groupBy(F.coalesce("message", F.lit("unknown")).alias("message")).agg(F.count("*").alias("n"))


def bottlenecks(steps: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` longest steps of each trace and their share of the trace's duration in percent."""
    whole = Window.partitionBy("trace_id")
    shared = steps.withColumn("share", F.round(100 * F.col("duration") / F.sum("duration").over(whole), 1))
    return shared.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("duration"), "step_id"))).filter(F.col("rank") <= n).select("trace_id", "rank", "step_id", "duration", "share")


def critical_path(steps: DataFrame) -> DataFrame:
    """By trace the root with the longest chain below it: trace_id, root, duration, depth.

    A chain is the sum of durations from a step without children up to its root, the depth the number of
    levels. Steps on a cycle have no root and are left out.
    """
    rows = cut(steps.select("trace_id", "step_id", "parent_id", F.col("duration").cast("double").alias("chain")))
    parts = shares(steps)
    parents = rows.filter("parent_id is not null").select("trace_id", F.col("parent_id").alias("step_id")).repartition(parts, "trace_id", "step_id").distinct()
    leaves = _climbed(rows, parts, chain=lambda below, above: below + above).repartition(parts, "trace_id", "step_id").join(parents, ["trace_id", "step_id"], "left_anti")
    roots = leaves.groupBy("trace_id", "root").agg(F.max("chain").alias("chain"), F.max("hops").alias("depth"))
    best = F.max(F.struct(F.round("chain", 2).alias("d"), (-F.col("root")).alias("s"), "depth"))
    return roots.groupBy("trace_id").agg(best.alias("b")).select("trace_id", (-F.col("b.s")).alias("root"), F.col("b.d").alias("duration"), "b.depth")


def parallel_gain(steps: DataFrame) -> DataFrame:
    """For each root with several children the time that running them side by side would save."""
    roots = steps.filter("parent_id is null").select("trace_id", F.col("step_id").alias("parent_id"))
    told = steps.join(roots, ["trace_id", "parent_id"]).groupBy("trace_id", "parent_id").agg(F.count("*").alias("children"), F.round(F.sum("duration"), 2).alias("in_turn"), F.max("duration").alias("together"))
    return told.filter("children > 1 and in_turn > together").withColumn("saved", F.round(F.col("in_turn") - F.col("together"), 2))


def timeline(steps: DataFrame) -> DataFrame:
    """Each step with its depth and path of step ids from the root, by which a trace sorts in preorder."""
    rows = cut(steps.select("trace_id", "step_id", "parent_id", F.lpad(F.col("step_id").cast("string"), 12, "0").alias("path")))
    climbed = _climbed(rows, shares(steps), path=lambda below, above: F.concat_ws("/", above, below))
    return climbed.select("trace_id", "step_id", (F.col("hops") - 1).alias("depth"), "path")


def _climbed(rows: DataFrame, parts: int | None = None, **folded) -> DataFrame:
    """The steps that a root leads to: trace_id, step_id, root, hops (steps from the root to it) and the ``folded`` columns.

    Each round puts a step's stretch of ancestors and that of the stretch's upper end together, so stretches double and
    rounds are the logarithm of the depth. A stretch as long as its trace has steps goes round a cycle and is dropped, as
    is one whose upper end is missing. Rows are dealt over ``parts`` partitions, so that what a task sorts doesn't grow with them.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *on: df.repartition(parts, *on)
    rows = dealt(rows, "trace_id")
    size = rows.groupBy("trace_id").agg(F.count("*").alias("size"))
    rows = rows.join(size, "trace_id").select("trace_id", "step_id", F.col("parent_id").alias("up"), F.col("step_id").alias("root"), F.lit(1).alias("hops"), "size", *folded)
    while True:
        live = rows.filter("up is not null and hops < size")
        above = rows.select("trace_id", F.col("step_id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("hops").alias("_hops"), *[F.col(c).alias(f"_{c}") for c in folded])
        joined = dealt(live, "trace_id", "up").join(dealt(above, "trace_id", "up"), ["trace_id", "up"]).select(
            "trace_id", "step_id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("hops") + F.col("_hops")).alias("hops"), "size", *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in folded.items()]
        )
        rows = cut(rows.filter("up is null").unionByName(joined))
        if rows.filter("up is not null and hops < size").isEmpty():
            return rows.filter("up is null").drop("up", "size")


def cyclic_steps(steps: DataFrame) -> DataFrame:
    """Steps that no root leads to: those of cycles and what hangs below them."""
    parts = shares(steps)
    steps = cut(steps.select("trace_id", "step_id", "parent_id"))
    reached = _climbed(steps, parts).select("trace_id", "step_id")
    return steps.select("trace_id", "step_id").join(reached, ["trace_id", "step_id"], "left_anti")


def cycles(edges: DataFrame) -> DataFrame:
    """(trace_id, member, cycle, size) of steps that lie on cycles of ``edges`` (trace_id, source, target), where a step may have several sources.

    Steps of which each leads to each other are one cycle, named by its smallest member; a step that leads to itself is one of size 1. Null ends are
    left out. A trace of up to ``TOGETHER`` edges is walked by one task, larger ones are labelled in rounds over the table.
    """
    edges = cut(edges.select("trace_id", "source", "target").filter("source is not null and target is not null").distinct())
    size = edges.groupBy("trace_id").agg((F.count("*") <= TOGETHER).alias("_small"))
    sized = edges.join(size, "trace_id")
    kind = edges.schema["source"].dataType.simpleString()
    schema = f"trace_id {edges.schema['trace_id'].dataType.simpleString()}, member {kind}, cycle {kind}"

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        found = [(part["trace_id"].iloc[0], m, min(c)) for c in strong_components(part["source"].tolist(), part["target"].tolist()) for m in c]
        return pd.DataFrame(found, columns=["trace_id", "member", "cycle"]) if found else part.iloc[:0].set_axis(["trace_id", "member", "cycle"], axis=1)

    found = sized.filter("_small").drop("_small").groupBy("trace_id").applyInPandas(walk, schema)
    large = sized.filter("not _small").drop("_small")
    if not size.filter("not _small").isEmpty():
        found = found.unionByName(_labelled(large))
    found = cut(found)
    return found.join(found.groupBy("trace_id", "cycle").agg(F.count("*").alias("size")), ["trace_id", "cycle"]).select("trace_id", "member", "cycle", "size")


def strong_components(sources: list, targets: list) -> list[list]:
    """The sets of steps of which each leads to each other, and steps that lead to themselves: two walks, the second against the edges in the reverse order of leaving."""
    ahead, behind = {}, {}
    for a, b in zip(sources, targets, strict=True):
        ahead.setdefault(a, []).append(b)
        behind.setdefault(b, []).append(a)

    def walked(start, ways, seen) -> list:
        left, stack = [], [(start, iter(ways.get(start, ())))]
        seen.add(start)
        while stack:
            step = next((t for t in stack[-1][1] if t not in seen), None)
            if step is None:
                left.append(stack.pop()[0])
            else:
                seen.add(step)
                stack.append((step, iter(ways.get(step, ()))))
        return left

    seen, order, loops = set(), [], {a for a, b in zip(sources, targets, strict=True) if a == b}
    for step in ahead:
        if step not in seen:
            order += walked(step, ahead, seen)
    seen, out = set(), []
    for step in reversed(order):
        if step not in seen:
            out.append(walked(step, behind, seen))
    return [c for c in out if len(c) > 1 or c[0] in loops]


def _labelled(edges: DataFrame) -> DataFrame:
    """(trace_id, member, cycle) as ``cycles`` tells them, by rounds.

    Steps that nothing leads to, or that lead nowhere, are trimmed away. Of what is left each step gets the smallest step that leads to it and the smallest
    that it leads to; where both are the same step they and it are of one cycle, and edges between steps with other labels go.
    """
    left, done = cut(edges.filter("source != target")), edges.filter("source = target").select("trace_id", F.col("source").alias("member"), F.col("source").alias("cycle"))
    while not (left := _trimmed(left)).isEmpty():
        down, up = _smallest(left, "source", "target"), _smallest(left, "target", "source")
        labels = cut(down.withColumnRenamed("label", "from").join(up.withColumnRenamed("label", "to"), ["trace_id", "step"]))
        whole = labels.filter(F.col("from") == F.col("to")).select("trace_id", F.col("step").alias("member"), F.col("from").alias("cycle"))
        # a step alone with its label lies between cycles and on none
        several = whole.groupBy("trace_id", "cycle").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        done = done.unionByName(whole.join(several, ["trace_id", "cycle"], "left_semi").select("trace_id", "member", "cycle"))
        rest = labels.filter(F.col("from") != F.col("to"))
        side = lambda end, rest=rest: rest.select("trace_id", F.col("step").alias(end), F.struct("from", "to").alias(f"_{end}"))
        left = cut(left.join(side("source"), ["trace_id", "source"]).join(side("target"), ["trace_id", "target"]).filter("_source = _target").select("trace_id", "source", "target"))
    return done.groupBy("trace_id", "member").agg(F.min("cycle").alias("cycle"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those that no cycle can hold: from steps that nothing leads to, and to steps that lead nowhere, again and again."""
    n = edges.count()
    while n:
        into, out = edges.select("trace_id", F.col("target").alias("source")).distinct(), edges.select("trace_id", F.col("source").alias("target")).distinct()
        edges = cut(edges.join(into, ["trace_id", "source"], "left_semi").join(out, ["trace_id", "target"], "left_semi"))
        if (now := edges.count()) == n:
            break
        n = now
    return edges


def _smallest(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(trace_id, step, label): the smallest step from which ``step`` is reached along ``edges``, itself included.

    Besides its neighbours' labels a step takes the label of the step that its own label names, so that long ways shorten.
    """
    steps = edges.select("trace_id", F.col(source).alias("step")).union(edges.select("trace_id", target)).distinct()
    labels = cut(steps.withColumn("label", F.col("step")))
    while True:
        told = edges.join(labels.withColumnRenamed("step", source), ["trace_id", source]).select("trace_id", F.col(target).alias("step"), "label")
        named = labels.select("trace_id", "step", F.col("label").alias("via")).join(labels.select("trace_id", F.col("step").alias("via"), "label"), ["trace_id", "via"]).select("trace_id", "step", "label")
        after = labels.unionByName(told).unionByName(named).groupBy("trace_id", "step").agg(F.min("label").alias("label"))
        after = cut(after.join(labels.withColumnRenamed("label", "before"), ["trace_id", "step"]))
        labels = after.select("trace_id", "step", "label")
        if after.filter("label != before").isEmpty():
            return labels
