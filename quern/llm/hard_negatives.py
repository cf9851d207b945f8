"""Hard negatives by a k-nearest-neighbour join over Voronoi cells.

A row's vector x gets one more component, sqrt(M*M - x.x) with M the largest norm, and an anchor's gets 0: then the squared distance of
the two is a.a + M*M - 2 a.x, so the largest product is the smallest distance. Rows belong to the cell of their nearest pivot. Anchors of
one cell and label form groups; from the distances to the pivots follows, by the triangle inequality, how far the rows that a group needs may
lie at most, and so which rows of which cells can serve it. Only those are sent to it, in blocks, and compared exactly; the best of the blocks are
merged by anchor. The join runs twice: for the positives, whose reach follows from the cells' nearest rows of the label, and for the negatives,
whose reach follows from the positives' scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch
from quern.llm.vector_codes import matrix, whole_numbers

#: Whole numbers a unit, and the largest one; a hundred times the products of 256 such components fit int64.
SCALE, LARGEST = 256, 1 << 24
#: Anchors of a group; rows of a block; rows of a pivot, and bounds of the number of pivots.
GROUP, BLOCK, PER_PIVOT, PIVOTS = 256, 4096, 256, (8, 512)
#: Sums of distances in double precision are off by less than this share of the largest norm.
SLACK = 1e-6


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in another order: each is followed by the nearest of those left, so that near numbers are near cells."""
    left, order = list(range(1, len(pivots))), [0]
    while left:
        far = ((pivots[left] - pivots[order[-1]]) ** 2).sum(axis=1)
        order.append(left.pop(int(far.argmin())))
    return pivots[order]


def placed(rows: DataFrame, pivots: np.ndarray, longest: int, width: int) -> DataFrame:
    """``rows`` (vec_id, label, ints, is_anchor) as (vec_id, label, anchor, cell, apart, square, x).

    Each row is a candidate, and once more an anchor if ``is_anchor``; cell is the nearest pivot and apart the distance to it.
    """
    square = (pivots * pivots).sum(axis=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("ints"), width)
            own, blobs = (x * x).sum(axis=1), np.array([r.tobytes() for r in x.astype("<i4")], dtype=object)
            rest = np.sqrt((longest - own).astype(np.float64))
            anchors = np.flatnonzero(batch.column("is_anchor").to_numpy(zero_copy_only=False))
            for side, keep, more in ((False, np.arange(len(x)), rest), (True, anchors, np.zeros(len(x)))):
                if len(keep):
                    v = np.concatenate([x, more[:, None]], axis=1).astype(np.float64)[keep]
                    far = np.sqrt(np.maximum(0, (v * v).sum(axis=1)[:, None] - 2 * v @ pivots.T + square[None, :]))
                    cell = far.argmin(axis=1)
                    held = batch.select(["vec_id", "label"]).take(pa.array(keep)).columns
                    more = [[side] * len(v), cell.astype(np.int32), far[np.arange(len(v)), cell], own[keep].astype(np.float64), blobs[keep]]
                    yield pa.RecordBatch.from_arrays([*held, *map(pa.array, more)], names=["vec_id", "label", "anchor", "cell", "apart", "square", "x"])

    return rows.select("vec_id", "label", "ints", "is_anchor").mapInArrow(place, "vec_id long, label long, anchor boolean, cell int, apart double, square double, x binary")


def grouped(anchors: DataFrame, *by: str) -> DataFrame:
    """``anchors`` with group: under 2 * ``GROUP`` of them, of one value of ``by`` and of cells that follow each other; a full cell is dealt over several."""
    held = anchors.groupBy(*by, "cell").agg(F.count("*").alias("_n"))
    # a row for each cell, so at most PIVOTS[1] in a window
    before = F.sum("_n").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("cell")) - F.col("_n")
    held = held.select(*by, "cell", F.floor(before / GROUP).alias("_first"), F.ceil(F.col("_n") / GROUP).alias("_parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("_parts"))
    return anchors.join(held, [*by, "cell"]).withColumn("group", F.xxhash64(*by, "_first", part)).drop("_first", "_parts")


def reach_of_positives(anchors: DataFrame, rows: DataFrame, between: DataFrame, k: int) -> DataFrame:
    """(label, cell, radius, reach): no anchor of a label and cell has its k-th other row of the label farther than reach.

    A row of cell j is at most radius + |pivot, pivot j| + its own distance to pivot j away from an anchor, and each cell tells its k + 1
    nearest rows of each label (one may be the anchor itself). Where a label has fewer rows all of them serve.
    """
    order = Window.partitionBy("label", "cell").orderBy("apart")
    near = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).select("label", F.col("cell").alias("other"), F.col("apart").alias("near"))
    held = anchors.groupBy("label", "cell").agg(F.max("apart").alias("radius"))
    away = held.join(F.broadcast(between), "cell").join(near, ["label", "other"]).select("label", "cell", (F.col("radius") + F.col("between") + F.col("near")).alias("far"))
    kth = away.withColumn("_n", F.row_number().over(Window.partitionBy("label", "cell").orderBy("far"))).filter(F.col("_n") == k + 1).select("label", "cell", F.col("far").alias("reach"))
    return held.join(kth, ["label", "cell"], "left").select("label", "cell", "radius", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))


def routes(groups: DataFrame, between: DataFrame, cells: DataFrame, slack: float) -> DataFrame:
    """(group, cell, first, part, least) from ``groups`` (group, cell, radius, reach): the blocks with rows that may serve a group, those at least ``least`` away from their pivot.

    A row of cell j at distance d of its pivot is no nearer to an anchor than |pivot, pivot j| - radius - d.
    """
    pairs = groups.join(F.broadcast(between), "cell")
    least = pairs.groupBy("group", F.col("other").alias("cell")).agg((F.min(F.col("between") - F.col("radius") - F.col("reach")) - slack).alias("least"))
    ways = least.join(F.broadcast(cells), "cell").filter("farthest >= least")
    return ways.select("group", "cell", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "least")


def _side_by_side(anchors: DataFrame, blocks: DataFrame, ways: DataFrame, columns: list[str]) -> DataFrame:
    """Anchors and the rows that may serve them by (group, first, part); ``columns`` are of anchors alone, null in a row."""
    nothing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in columns]
    given = blocks.join(ways, ["cell", "part"]).filter("apart >= least").select("group", "first", "part", "vec_id", "label", "x", *nothing)
    asked = anchors.join(ways.select("group", "first", "part").distinct(), "group").select("group", "first", "part", "vec_id", "label", "x", *columns)
    return asked.unionByName(given).groupBy("group", "first", "part")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        kept = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
        return kept[np.lexsort((ids[kept], -score[kept]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _products(anchors: pd.Series, rows: pd.Series) -> np.ndarray:
    """Exact products, in double precision where they fit 53 bits."""
    a, x = (np.frombuffer(b"".join(s), dtype="<i4").reshape(len(s), -1) for s in (anchors, rows))
    most = lambda v: int(np.abs(v.astype(np.int64)).max(initial=0))
    if most(a) * most(x) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def _positives(k: int):
    def join(part: pd.DataFrame) -> pd.DataFrame:
        asked, rows = part[part["is_anchor"].notna()], part[part["is_anchor"].isna()]
        found = [np.zeros((3, 0), dtype=np.int64)]
        if len(asked) and len(rows):
            score, ids, label = _products(asked["x"], rows["x"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for i, (anchor, own) in enumerate(zip(asked["vec_id"], asked["label"], strict=True)):
                fit = np.flatnonzero((label == own) & (ids != anchor))
                best = fit[_best(score[i, fit], ids[fit], k)]
                found.append(np.stack([np.full(len(best), anchor), ids[best], score[i, best]]))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["anchor_id", "vec_id", "score"])

    return join


def _negatives(k: int, low: int):
    def join(part: pd.DataFrame) -> pd.DataFrame:
        asked, rows = part[part["scores"].notna()], part[part["scores"].isna()]
        found = [np.zeros((5, 0), dtype=np.int64)]
        if len(asked) and len(rows):
            score, ids, label = _products(asked["x"], rows["x"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for i, (anchor, own, positives, scores) in enumerate(zip(asked["vec_id"], asked["label"], asked["positives"], asked["scores"], strict=True)):
                near = np.flatnonzero((100 * score[i] >= low * min(scores)) & (score[i] <= max(scores)) & (label != own))
                mark, name = score[i, near], ids[near]
                for positive, most in zip(positives, scores, strict=True):
                    fit = np.flatnonzero((mark <= most) & (100 * mark >= low * most))
                    fit = fit[_best(mark[fit], name[fit], k)]
                    found.append(np.stack([np.full(len(fit), anchor), np.full(len(fit), positive), name[fit], np.full(len(fit), most), mark[fit]]))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return join


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score over ``vectors`` (vec_id, label, ints).

    Anchors are the rows whose vec_id is divisible by ``every``; scores are whole products. An anchor's positives are its first rows of
    the same label, its negatives for one of them the first rows of other labels whose score is at most the positive's and at least
    ``low`` hundredths of it. Fewer are returned where there are no more. A shorter vector counts as filled up with zeros.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "negatives")
    held, width = scratch.keep(vectors, "rows"), F.size("ints")
    square = F.aggregate("ints", F.lit(0).cast("long"), lambda t, c: t + c.cast("long") * c.cast("long"))
    n, widest, longest = held.agg(F.count("*"), F.max(width), F.max(square)).first()
    widest, longest = max(1, widest or 0), longest or 0
    padded = held.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0), F.lit(widest) - width)))
    few = max(PIVOTS[0], min(PIVOTS[1], n // PER_PIVOT))
    first = padded.select("ints").orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).collect()
    first = np.array([r["ints"] for r in first], dtype=np.int64).reshape(len(first), widest)
    rest = np.sqrt((longest - (first * first).sum(axis=1)).astype(np.float64))
    pivots = np.unique(np.concatenate([first.astype(np.float64), rest[:, None]], axis=1), axis=0)
    pivots = _chained(pivots) if len(pivots) else np.zeros((1, widest + 1))
    both = scratch.keep(placed(padded.withColumn("is_anchor", F.col("vec_id") % every == 0), pivots, longest, widest), "placed")
    apart = np.sqrt(((pivots[:, None, :] - pivots[None]) ** 2).sum(axis=2))
    a, b = (x.ravel() for x in np.indices(apart.shape))
    between = vectors.sparkSession.createDataFrame(pd.DataFrame({"cell": a, "other": b, "between": apart.ravel()}), "cell int, other int, between double")
    anchors, rows, slack = both.filter("anchor"), both.filter("not anchor"), SLACK * float(np.sqrt(longest))
    # blocks (first, part) are small cells that follow each other, or parts of a full one, so that no task has to hold it
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("cell")) - F.col("n")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("farthest"))
    cells = scratch.keep(cells.select("cell", "farthest", F.floor(before / BLOCK).alias("first"), F.ceil(F.col("n") / BLOCK).alias("parts")), "cells")
    blocks = rows.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("parts"))).drop("parts")

    def joined(asked: DataFrame, bounds: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        groups = grouped(asked, *by)
        ways = routes(groups.select("group", *by, "cell").distinct().join(bounds, [*by, "cell"]), between, cells, slack)
        return _side_by_side(groups, blocks, ways, columns)

    reach = reach_of_positives(anchors, rows, between, positives)
    near = joined(anchors.withColumn("is_anchor", F.lit(True)), reach, ["label"], ["is_anchor"]).applyInPandas(_positives(positives), "anchor_id long, vec_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives)
    told = best.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("_p"), F.min("score").alias("lowest"))
    told = scratch.keep(told.select(F.col("anchor_id").alias("vec_id"), F.col("_p.vec_id").alias("positives"), F.col("_p.score").alias("scores"), "lowest"), "positives")
    # a negative's score is low hundredths of the lowest positive's at least, and none is below 0
    served = anchors.join(told, "vec_id")
    square = F.col("square") + float(longest) - 2 * low / 100 * F.greatest(F.col("lowest"), F.lit(0))
    reach = served.groupBy("cell").agg(F.max("apart").alias("radius"), F.max(F.sqrt(F.greatest(square, F.lit(0.0)))).alias("reach"))
    found = joined(served, reach, [], ["positives", "scores"]).applyInPandas(_negatives(negatives, low), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, ints) of the rows of ``vectors`` (vec_id, embedding, label; others are not read) that take part; where vec_id is divisible by 7 the label is the next of ten.

    Rows without id or label, and vectors that are null or hold a null or non-finite component don't. Of rows that repeat a vec_id the one with the
    largest vector, then label, does. Components beyond 65,536 count as that.
    """
    rows = whole_numbers(vectors, SCALE, LARGEST, "label").filter("vec_id is not null and label is not null")
    rows = rows.groupBy("vec_id").agg(F.max(F.struct("ints", "label")).alias("_r")).select("vec_id", F.col("_r.label").cast("long").alias("label"), "_r.ints")
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
