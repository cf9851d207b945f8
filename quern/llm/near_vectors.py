"""Near-duplicate vectors by NN-descent.

Equal vectors are one point. Points start with the nearest ones of their leaf in a few orders by signs of random projections. In each round
every point meets the points that it lists and that list it, old neighbours and new ones sampled apart; two that meet there, one of them
new, are compared, and each takes the other into its list if it is nearer than what the list holds. A list holds the ``LIST`` nearest; one that
is full of points over the threshold grows up to ``FULL``. Rounds end when they find next to no new link and the links of a bounded sample of points,
compared with all, are found to ``RECALL``; otherwise another order is added and rounds go on.

Links are the listed pairs over the threshold, in double precision where float32 can't tell. Points of crowds, whose lists would be longer than
``FULL``, are counted exactly inside their component: by the angles to its mean where these prove that two are linked or aren't, else by products of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.ann import usable
from quern.llm.components import components
from quern.llm.scratch import Scratch

#: Entries of a list, and of one that is full of links; points that meet at a point, of old and of new ones each.
LIST, FULL, SAMPLE = 12, 64, 12
#: Orders to start from, signs of an order, points of a leaf.
ORDERS, SIGNS, LEAF = 4, 30, 96
#: Least and most rounds; share of new links that ends them; points of the audit, the recall asked for, and orders added for it at most.
ROUNDS, STILL, AUDIT, RECALL, MORE = (3, 12), 0.002, 1024, 0.99, 6
#: Buckets a radian of angles to the mean of a crowd, points of a block of a bucket.
BUCKETS, BLOCK = 64, 1024


def _floats(column: pd.Series) -> np.ndarray:
    """Rows of equally long float32 binaries."""
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(len(column), -1)


def _off(dims) -> float:
    """What a float32 product of two unit vectors, rounded to float32 first, is off by at most."""
    return (dims + 8) * 2.0**-23


def distinct_points(vectors: DataFrame) -> DataFrame:
    """(id, copies, dims, exact, unit): the distinct vectors by the smallest vec_id that has them, scaled by a power of two, and as float32 unit vectors."""
    held = vectors.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            exact = [x / 2.0 ** np.floor(np.log2(np.abs(x).max())) if 1e-290 < np.abs(x).max() < 1e290 else x / np.abs(x).max() for x in map(np.asarray, part["embedding"])]
            part["dims"] = [len(x) for x in exact]
            part["unit"] = [(x / np.sqrt(x @ x)).astype("<f4").tobytes() for x in exact]
            part["exact"] = [x.astype("<f8").tobytes() for x in exact]
            yield part[["id", "copies", "dims", "exact", "unit"]]

    return held.mapInPandas(shape, "id long, copies long, dims int, exact binary, unit binary")


def _leaves(points: DataFrame, first: int, orders: int) -> DataFrame:
    """(id, nbr, cos): the nearest in the leaves of ``orders`` orders. An order sorts points by the signs of random projections; leaves are runs of it."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for dims, own in part.groupby("dims"):
                unit = _floats(own["unit"])
                for order in range(first, first + orders):
                    planes = np.random.default_rng([order, int(dims)]).normal(size=(int(dims), SIGNS)).astype(np.float32)
                    code = (unit @ planes > 0) @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
                    yield pd.DataFrame({"dims": dims, "tree": order, "code": code, "id": own["id"], "unit": own["unit"]})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, own in part.groupby(["dims", "tree"], sort=False):
                ids, unit, out = own["id"].to_numpy(), _floats(own["unit"]), []
                for at in range(0, len(own), LEAF):
                    x, i = unit[at : at + LEAF], ids[at : at + LEAF]
                    if len(x) > 1:
                        cos = x @ x.T
                        np.fill_diagonal(cos, -2)
                        best = np.argsort(-cos, axis=1, kind="stable")[:, : min(LIST, len(x) - 1)]
                        out.append(pd.DataFrame({"id": np.repeat(i, best.shape[1]), "nbr": i[best].ravel(), "cos": np.take_along_axis(cos, best, axis=1).ravel()}))
                if out:
                    yield pd.concat(out)

    coded = points.select("id", "dims", "unit").mapInPandas(sign, "dims int, tree int, code long, id long, unit binary")
    dealt = coded.repartitionByRange("dims", "tree", "code", "id").sortWithinPartitions("dims", "tree", "code", "id")
    return dealt.mapInPandas(near, "id long, nbr long, cos float")


def _listed(found: DataFrame, threshold: float) -> DataFrame:
    """``found`` (id, nbr, cos, old) as lists: (id, nbr, cos, new, bar, full). bar is the cosine from which a list takes more; a full one holds links alone and no more go in."""
    told = found.repartition("id").groupBy("id", "nbr").agg(F.max("cos").alias("cos"), F.max("old").alias("old"))
    order = Window.partitionBy("id").orderBy(F.desc("cos"), "nbr")
    ranked = told.withColumn("_n", F.row_number().over(order)).filter((F.col("_n") <= LIST) | (F.col("cos") >= threshold) & (F.col("_n") <= FULL))
    whole = Window.partitionBy("id")
    kth, least, size = F.max(F.when(F.col("_n") == LIST, F.col("cos"))).over(whole), F.min("cos").over(whole), F.count("*").over(whole)
    bar = F.when(size >= FULL, least).otherwise(F.least(F.coalesce(kth, F.lit(-2.0)), F.lit(float(threshold)))).cast("float")
    return ranked.select("id", "nbr", "cos", (~F.col("old")).alias("new"), bar.alias("bar"), (size >= FULL).alias("full"))


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Proposals (id, nbr, cos) among the points that meet at a place; rows come sorted by place, at most 2 * SAMPLE each."""
    rest = None
    for part in batches:
        part = pd.concat([rest, part]) if rest is not None else part
        last = part["place"].to_numpy() == part["place"].iloc[-1]
        rest = part[last]
        yield from _compared(part[~last])
    if rest is not None:
        yield from _compared(rest)


def _compared(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, own in part.groupby(part["unit"].str.len(), sort=False):
        unit, place, ids, bar, new = _floats(own["unit"]), own["place"].to_numpy(), own["id"].to_numpy(), own["bar"].to_numpy(), own["new"].to_numpy()
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        many = np.diff(np.r_[first, len(place)])
        group, seat = np.repeat(np.arange(len(first)), many), np.arange(len(place)) - np.repeat(first, many)
        at = np.full((len(first), int(many.max())), -1)
        at[group, seat] = np.arange(len(place))
        for a in range(0, len(first), 512):
            held = at[a : a + 512]
            x = unit[held] * (held >= 0)[:, :, None]
            cos = x @ x.transpose(0, 2, 1)
            fresh = new[held]
            ok = (held >= 0)[:, :, None] & (held >= 0)[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (cos > bar[held][:, :, None])
            ok &= ~np.eye(held.shape[1], dtype=bool)[None]
            g, i, j = np.nonzero(ok)
            yield pd.DataFrame({"id": ids[held[g, i]], "nbr": ids[held[g, j]], "cos": cos[g, i, j]})


def _round(lists: DataFrame, points: DataFrame, threshold: float, turn: int) -> DataFrame:
    """The lists after a round over ``lists``."""
    pair = lambda a, b: lists.select(F.col(a).alias("place"), F.col(b).alias("id"), "new")
    both = pair("id", "nbr").union(pair("nbr", "id")).repartition("place").groupBy("place", "id").agg(F.max("new").alias("new"))
    order = Window.partitionBy("place", "new").orderBy(F.xxhash64("id", F.lit(turn)))
    met = both.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE).drop("_n")
    met = met.join(met.groupBy("place").agg(F.max("new").alias("any")).filter("any").select("place"), "place", "left_semi")
    bars = points.select("id", "unit").join(lists.groupBy("id").agg(F.first("bar").alias("bar")), "id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)).cast("float"))
    sent = met.join(bars, "id").repartition("place").sortWithinPartitions("place")
    found = sent.mapInPandas(_meetings, "id long, nbr long, cos float").withColumn("old", F.lit(False))
    return _listed(found.unionByName(lists.select("id", "nbr", "cos", F.lit(True).alias("old"))), threshold)


def _audited(points: DataFrame, least: float) -> DataFrame:
    """(id, nbr): all links of the ``AUDIT`` points whose ids hash lowest, compared with every point."""
    asked = points.select("id", "dims", "unit").orderBy(F.xxhash64("id"), "id").limit(AUDIT).toPandas()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for dims, own in part.groupby("dims"):
                wanted = asked[asked["dims"] == dims]
                if len(wanted):
                    i, j = np.nonzero(_floats(wanted["unit"]) @ _floats(own["unit"]).T >= least + _off(dims))
                    ids, near = wanted["id"].to_numpy()[i], own["id"].to_numpy()[j]
                    yield pd.DataFrame({"id": ids[ids != near], "nbr": near[ids != near]})

    return points.select("id", "dims", "unit").mapInPandas(compare, "id long, nbr long")


def neighbour_lists(points: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The lists that rounds end with."""
    truth = scratch.keep(_audited(points, threshold), "audit")
    lists, n_true = None, truth.count()
    for more in range(MORE + 1):
        found = _leaves(points, 0 if lists is None else ORDERS + more, ORDERS if lists is None else 1).withColumn("old", F.lit(False))
        if lists is not None:
            found = found.unionByName(lists.select("id", "nbr", "cos", F.lit(True).alias("old")))
        lists = scratch.keep(_listed(found, threshold), "lists")
        before = 0
        for turn in range(ROUNDS[1]):
            lists = scratch.keep(_round(lists, points, threshold, turn + 100 * more), "lists")
            links, fresh = lists.agg(F.count_if(F.col("cos") >= threshold), F.count_if("new")).first()
            if not fresh or turn + 1 >= ROUNDS[0] and links - before <= STILL * links:
                break
            before = links
        # links of crowded points are counted elsewhere
        crowded = lists.filter("full").select("id").distinct()
        held = lists.filter(F.col("cos") >= threshold - 0.01)
        held = held.select("id", "nbr").union(held.select("nbr", "id")).distinct().withColumn("hit", F.lit(1))
        open_ = truth.join(crowded, "id", "left_anti").join(held, ["id", "nbr"], "left").agg(F.count("*"), F.count("hit")).first() if n_true else (0, 0)
        if open_[1] >= RECALL * open_[0]:
            break
    return lists


def _links(lists: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: listed pairs over the threshold, by double precision where float32 can't tell."""
    pairs = lists.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    pairs = pairs.join(points.select(F.col("id").alias("a"), ((F.col("dims") + 8) * 2.0**-23).alias("off")), "a").filter(F.col("cos") >= threshold - F.col("off"))
    side = lambda c: points.select(F.col("id").alias(c), F.col("exact").alias(f"x_{c}"))
    near = pairs.filter(F.col("cos") < threshold + F.col("off")).join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([exact_cosine(np.frombuffer(x, dtype="<f8"), np.frombuffer(y, dtype="<f8")) >= threshold for x, y in zip(a, b, strict=True)], dtype=bool)

    return pairs.filter(F.col("cos") >= threshold + F.col("off")).select("a", "b").union(near.filter(linked("x_a", "x_b")).select("a", "b"))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y)))


def _crowd_counts(members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, n): copies of all points linked with each of ``members`` (component, id, copies, dims, exact), its own included, inside their component.

    With angles s and t to the component's mean two points are linked if s + t is at most the threshold's angle, and aren't if |s - t| is
    larger. Points are dealt to buckets of angles and these to blocks; pairs of buckets that the angles don't decide are multiplied block by block.
    """
    limit = float(np.arccos(threshold))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = [np.frombuffer(b, dtype="<f8") for b in part["exact"]]
            part["u"] = [v / np.sqrt(v @ v) for v in x]
            yield part[["component", "u"]]

    means = members.mapInPandas(unit, "component long, u array<double>").select("component", F.posexplode("u").alias("i", "v")).groupBy("component", "i").agg(F.sum("v").alias("v"))
    means = means.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_m")).select("component", F.col("_m.v").alias("mean"))

    def angle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            far = [np.arccos(np.clip(exact_cosine(np.frombuffer(x, dtype="<f8"), np.asarray(m)), -1, 1)) if np.any(m) else 0.0 for x, m in zip(part["exact"], part["mean"], strict=True)]
            part["bucket"] = np.floor(np.array(far) * BUCKETS).astype(np.int32)
            yield part[["component", "id", "copies", "exact", "bucket"]]

    placed = scratch.keep(members.join(means, "component").mapInPandas(angle, "component long, id long, copies long, exact binary, bucket int"), "placed")
    held = scratch.keep(placed.groupBy("component", "bucket").agg(F.sum("copies").alias("weight"), F.ceil(F.count("*") / BLOCK).alias("parts")), "buckets")
    other = held.select("component", F.col("bucket").alias("near"), "weight", F.col("parts").alias("near_parts"))
    pairs = held.select("component", "bucket", "parts").join(other, "component")  # a row for each two occupied buckets of a component, 202 * 202 at most
    slack = 1e-6
    sure = (F.col("bucket") + F.col("near") + 2) / BUCKETS <= limit - slack
    apart = (F.abs(F.col("bucket") - F.col("near")) - 1) / BUCKETS > limit + slack
    certain = pairs.filter(sure).groupBy("component", "bucket").agg(F.sum("weight").alias("n"))
    by_angle = placed.join(certain, ["component", "bucket"]).select("id", "n")
    told = pairs.filter(~sure & ~apart)
    blocked = placed.join(held.drop("weight"), ["component", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    tasks = told.select("*", upto("parts").alias("part")).select("component", "bucket", "part", "near", upto("near_parts").alias("near_part"))
    key = ["component", "bucket", "part", "near", "near_part"]
    left = blocked.join(tasks, ["component", "bucket", "part"]).select(*key, "id", "copies", "exact", F.lit(True).alias("own"))
    right = blocked.withColumnsRenamed({"bucket": "near", "part": "near_part"}).join(tasks, ["component", "near", "near_part"]).select(*key, "id", "copies", "exact", F.lit(False).alias("own"))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(part["exact"]), dtype="<f8").reshape(len(part), -1)
        norm, own = np.sqrt((x * x).sum(axis=1)), part["own"].to_numpy()
        cos = (x[own] @ x[~own].T) / (norm[own][:, None] * norm[~own][None, :])
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12), strict=True):
            cos[i, j] = exact_cosine(x[own][i], x[~own][j])
        return pd.DataFrame({"id": part["id"].to_numpy()[own], "n": (cos >= threshold) @ part["copies"].to_numpy()[~own]})

    by_product = left.unionByName(right).groupBy(*key).applyInPandas(count, "id long, n long")
    return by_angle.unionByName(by_product).groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """One row for each vec_id of ``vectors`` (vec_id, embedding; others are not read): vec_id, n_links, component_id, kept.

    Two vectors of as many components are linked if their cosine is at least ``threshold``; component_id is the smallest vec_id reachable over the
    links found, kept tells whether it's the row's own. Null, empty and zero vectors and those with null or non-finite components are linked with
    nothing. Of rows that repeat a vec_id the one with the largest array takes part; rows without one become one row that is linked with nothing and
    kept. An empty table gives no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "descent")
    rows = scratch.keep(usable(vectors).select("vec_id", "embedding"), "vectors")
    points = scratch.keep(distinct_points(rows), "points")
    lists = neighbour_lists(points, threshold, scratch)
    links = scratch.keep(_links(lists, points, threshold), "links")
    labels = components(links, scratch)
    both = links.union(links.select("b", "a")).toDF("id", "other")
    linked = both.join(points.select(F.col("id").alias("other"), F.col("copies").alias("n")), "other").groupBy("id").agg(F.sum("n").alias("listed"))
    crowded = labels.join(lists.filter("full").select("id").distinct(), "id").select("component").distinct()
    members = scratch.keep(labels.join(crowded, "component").join(points.drop("unit"), "id"), "crowds")
    counted = _crowd_counts(members, threshold, scratch).select("id", (F.col("n")).alias("whole"))
    told = points.select("id", "copies").join(labels, "id", "left").join(linked, "id", "left").join(counted, "id", "left")
    n = F.coalesce(F.col("whole") - 1, F.coalesce("listed", F.lit(0)) + F.col("copies") - 1)
    told = told.select("id", n.alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # equal vectors share their point's row
    of_point = points_of(rows, scratch)
    result = of_point.join(told, "id").select("vec_id", "n_links", "component_id")
    every = vectors.select("vec_id").distinct().join(result, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def points_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, id): the point of each vector."""
    held = rows.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    alone = held.filter("copies = 1").select(F.col("id").alias("vec_id"), "id")
    return alone.union(rows.join(held.filter("copies > 1").select("embedding", "id"), "embedding").select("vec_id", "id"))
