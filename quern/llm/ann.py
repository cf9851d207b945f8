"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt to shards by norm: a shard holds vectors of one number of components whose norms differ by ``BAND`` at
most, dealt on by a hash of their id where there are many. Among vectors of about one norm the largest inner product is
nearly the smallest angle, so each shard holds a graph over the directions of its distinct vectors: points are inserted in
batches, a greedy search proposes neighbours, and pruning with a relaxed distance keeps edges in diverse directions. A
search starts from a spread of points, walks the graph by inner product on the original vectors with a beam, and scores in double
precision. The queries stream past each shard's graph; the shards' best are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

#: Edges of a point, beam of the build and of the search, relaxation, points that a search starts from.
DEGREE, BUILD_BEAM, BEAM, ALPHA, SEEDS = 28, 48, 128, 1.2, 64
#: Vectors in a shard: a 64th of all within these bounds; ratio of the norms in a shard; queries that a graph is sent once for.
SHARD, BAND, ASKED = (4096, 16_384), 1.1, 32_768
#: Queries that advance together; tasks of the search, unless there are more shards.
BLOCK, TASKS = 512, 10_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dims, band) of the vectors that take part: not null, not zero, every component finite.

    band is the logarithm of the norm, to the base ``BAND`` and rounded. Of rows that repeat a vec_id the largest array takes part.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.coalesce(finite, F.lit(False))).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    v = v.withColumn("longest", F.array_max(F.transform("embedding", F.abs))).filter("longest > 0")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("longest")) * (x / F.col("longest")))
    band = F.floor((F.log("longest") + F.log(square) / 2) / float(np.log(BAND)) + 0.5).cast("int")
    return v.select("vec_id", "embedding", F.size("embedding").alias("dims"), band.alias("band"))


def _beam_search(points: np.ndarray, edges: np.ndarray, seeds: np.ndarray, queries: np.ndarray, beam: int, product: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` nearest points met by each query, nearest first; -1 where fewer were met.

    All queries advance together: each step expands the nearest point not yet expanded of each query, the best of the seeds
    first. Near is a small distance, or a large inner product if ``product``.
    """
    n, q = len(points), len(queries)
    square = np.zeros(n) if product else (points * points).sum(axis=1)
    seen = np.zeros((q, n), dtype=bool)
    ids, dist = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), np.inf)
    done = np.ones((q, beam), dtype=bool)
    far = square[seeds] - 2 * queries @ points[seeds].T
    best = np.argsort(far, axis=1, kind="stable")[:, :beam]
    many = best.shape[1]
    ids[:, :many], dist[:, :many], done[:, :many] = seeds[best], np.take_along_axis(far, best, axis=1), False
    seen[:, seeds] = True
    active = np.arange(q)
    while len(active):
        place = np.argmin(np.where(done[active], np.inf, dist[active]), axis=1)
        done[active, place] = True
        near = edges[ids[active, place]]
        ok = near >= 0
        safe = np.where(ok, near, 0)
        ok &= ~seen[active[:, None], safe]
        new_row, new_place = np.nonzero(ok)
        seen[active[new_row], near[new_row, new_place]] = True
        far = square[safe] - 2 * np.einsum("qrd,qd->qr", points[safe], queries[active])
        far[~ok] = np.inf
        all_dist = np.concatenate([dist[active], far], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(active))[:, None]
        dist[active] = all_dist[row, best]
        ids[active] = np.concatenate([ids[active], np.where(ok, near, -1)], axis=1)[row, best]
        done[active] = np.concatenate([done[active], ~ok], axis=1)[row, best]
        active = active[~done[active].all(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    row = np.arange(q)[:, None]
    ids, dist = ids[row, order], dist[row, order]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def _prune(points: np.ndarray, owner: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each owner at most ``degree`` of its candidates (-1: none): the nearest is kept and
    removes those that are nearer to it, by the factor alpha, than to the owner; and so on."""
    found = np.where(found == owner[:, None], -1, found)
    order = np.sort(found, axis=1)
    twice = np.zeros_like(found, dtype=bool)
    twice[:, 1:] = order[:, 1:] == order[:, :-1]
    found = np.where(twice, -1, order)
    held = points[np.maximum(found, 0)]
    own = ((held - points[owner][:, None, :]) ** 2).sum(axis=2)
    own[found < 0] = np.inf
    out, row = np.full((len(owner), degree), -1, dtype=np.int64), np.arange(len(owner))
    alive = np.isfinite(own)
    for k in range(degree):
        pick = np.argmin(np.where(alive, own, np.inf), axis=1)
        any_left = alive[row, pick]
        if not any_left.any():
            break
        out[:, k] = np.where(any_left, found[row, pick], -1)
        between = ((held - held[row, pick][:, None, :]) ** 2).sum(axis=2)
        alive &= ~(alpha * alpha * between <= own)
        alive[row, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges: points x degree, -1 for none; the points that searches start from) of distinct points."""
    n = len(points)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    seeds = order[:SEEDS]
    for turn in (1.0, alpha):
        at, size = 1 if turn == 1.0 else 0, 16
        while at < n:
            batch = order[at : at + size]
            met, _ = _beam_search(points, edges, seeds[: max(1, min(at, SEEDS))], points[batch], min(beam, n))
            at, size = at + size, min(size * 2, 512)
            edges[batch] = _prune(points, batch, np.concatenate([met, edges[batch]], axis=1), degree, turn)
            # every chosen neighbour gets an edge back; those with too many are pruned again
            to = edges[batch].ravel()
            back = np.repeat(batch, degree)[to >= 0]
            to = to[to >= 0]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            targets, first, many = np.unique(to, return_index=True, return_counts=True)
            for a in range(0, len(targets), 1024):
                t, m = targets[a : a + 1024], many[a : a + 1024]
                more = np.full((len(t), int(m.max())), -1, dtype=np.int64)
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                start = first[a]
                more[np.repeat(np.arange(len(t)), m), place] = back[start : start + m.sum()]
                both = np.concatenate([edges[t], more], axis=1)
                free = (edges[t] < 0).sum(axis=1) >= m
                edges[t] = _prune(points, t, both, degree, turn)
                if free.any():  # room for all of them: nothing is pruned
                    kept = np.sort(np.where(both[free] == t[free][:, None], -1, both[free]), axis=1)[:, ::-1]
                    kept[:, 1:][kept[:, 1:] == kept[:, :-1]] = -1
                    edges[t[free]] = np.sort(kept, axis=1)[:, ::-1][:, :degree]
    return edges, seeds


KEY = "dims int, band int, piece int"
GRAPH = f"{KEY}, ids binary, original binary, edges binary, seeds binary, point binary"


def _graphs(dealt: DataFrame) -> DataFrame:
    """One row for each shard of ``dealt`` (vec_id, embedding and the key): its ids and vectors as given, the graph over the distinct ones, and each vector's point."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        held = np.array(part["embedding"].tolist(), dtype=np.float64)
        distinct, point = np.unique(held, axis=0, return_inverse=True)
        unit = distinct / np.abs(distinct).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        edges, seeds = build_graph(unit)
        blob = lambda a, t: np.ascontiguousarray(a, dtype=t).tobytes()
        key = [int(part[c].iloc[0]) for c in ("dims", "band", "piece")]
        row = [*key, blob(part["vec_id"], "<i8"), blob(held, "<f8"), blob(edges, "<i4"), blob(seeds, "<i4"), blob(point.ravel(), "<i4")]
        return pd.DataFrame([row], columns=[c.split()[0] for c in GRAPH.split(", ")])

    return dealt.groupBy("dims", "band", "piece").applyInPandas(build, GRAPH)


class Shard:
    """A shard's graph as read back."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, dtype="<i8")
        held = np.frombuffer(row.original, dtype="<f8").reshape(len(self.ids), -1)
        point = np.frombuffer(row.point, dtype="<i4")
        self.by_point = np.argsort(point, kind="stable")  # ids ascend inside a point
        self.begin = np.searchsorted(point[self.by_point], np.arange(int(point.max()) + 2))
        self.distinct = held[self.by_point[self.begin[:-1]]]
        self.smallest = self.ids[self.by_point[self.begin[:-1]]]
        self.edges = np.frombuffer(row.edges, dtype="<i4").reshape(len(self.distinct), -1).astype(np.int64)
        self.seeds = np.frombuffer(row.seeds, dtype="<i4").astype(np.int64)
        self.scale = np.abs(self.distinct).max()  # keeps the walk clear of overflow; scores are of the vectors as given

    def search(self, asked: np.ndarray, wanted: np.ndarray, k: int) -> pd.DataFrame:
        """The ``k`` best for each query: query_id, vec_id, score."""
        n = len(self.edges)
        walk = wanted / np.abs(wanted).max(axis=1, keepdims=True)
        met, _ = _beam_search(self.distinct / self.scale, self.edges, self.seeds, walk, min(max(BEAM, 2 * k), n), product=True)
        score = np.einsum("qbd,qd->qb", self.distinct[np.maximum(met, 0)], wanted)
        lists = []
        for q, query in enumerate(asked):
            points, marks = met[q][met[q] >= 0], score[q][met[q] >= 0]
            best = np.lexsort((self.smallest[points], -marks))[: k + 1]  # one of them may be the query's own vector
            points, marks = points[best], marks[best]
            # equal vectors share a point: its smallest k + 1 ids are enough for the best k
            members = [self.by_point[self.begin[p] : min(self.begin[p + 1], self.begin[p] + k + 1)] for p in points]
            own, marks = self.ids[np.concatenate(members)], np.repeat(marks, [len(m) for m in members])
            marks, own = marks[own != query], own[own != query]
            best = np.lexsort((own, -marks))[:k]
            lists.append(pd.DataFrame({"query_id": np.full(len(best), query), "vec_id": own[best], "score": marks[best]}))
        return pd.concat(lists)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows of ``vectors`` (vec_id, embedding; others are not read) whose vec_id is divisible
    by ``every``, candidates all others; score is the inner product in double precision, ties go to the smaller
    vec_id. Null, zero and non-finite vectors, empty ones and null ids take no part. A vector is compared with those of as
    many components; with fewer candidates all are returned; an empty table gives no rows. Of rows that
    repeat a vec_id the one with the largest array, component by component, takes part.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "ann")
    held = scratch.keep(usable(vectors), "vectors")
    n, asked = held.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shard = shard or min(SHARD[1], max(SHARD[0], n // 64))
    sizes = held.groupBy("dims", "band").agg(F.ceil(F.count("*") / shard).cast("int").alias("pieces"))
    dealt = held.join(sizes, ["dims", "band"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).drop("pieces")
    # as many tasks as shards, however few bytes they are: a graph is much work
    shards = sizes.agg(F.sum("pieces")).first()[0] or 1
    graphs = scratch.keep(_graphs(dealt.repartition(2 * shards, "dims", "band", "piece")), "graph")
    # a graph goes once to each group of queries, and they stream past it
    key, groups = ["dims", "band", "piece", "part"], max(1, -(-(asked or 0) // ASKED))
    blobs = ["ids", "original", "edges", "seeds", "point"]
    shown = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*key, *blobs, F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    queries = held.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", "dims", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(groups)).cast("int").alias("part"))
    sent = queries.join(graphs.select("dims", "band", "piece"), "dims").select(*key, *[F.lit(None).cast("binary").alias(c) for c in blobs], "vec_id", "embedding")
    tasks = min(2 * shards * groups, max(2 * shards, TASKS))
    work = shown.unionByName(sent).repartition(tasks, *key).sortWithinPartitions(*key, F.col("vec_id").asc_nulls_first())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for part in batches:
            graph_rows = np.flatnonzero(part["vec_id"].isna())
            for at, to in zip([0, *graph_rows], [*graph_rows, len(part)], strict=True):
                piece = part.iloc[at:to]
                if len(piece) and pd.isna(piece["vec_id"].iloc[0]):
                    graph, piece = Shard(next(piece.itertuples(index=False))), piece.iloc[1:]
                for a in range(0, len(piece), BLOCK):
                    block = piece.iloc[a : a + BLOCK]
                    yield graph.search(block["vec_id"].to_numpy().astype(np.int64), np.array(block["embedding"].tolist(), dtype=np.float64), k)

    found = work.mapInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
