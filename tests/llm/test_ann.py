"""Graph search against an exact one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quern.llm import ann


def exact(ids, x, every=20, k=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def recall(got: pd.DataFrame, truth) -> float:
    hits = [len({v for v, _ in truth[q]} & set(part["vec_id"])) / len(truth[q]) for q, part in got.groupby("query_id")]
    return sum(hits) / len(truth)


def test_recall_ranks_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), dtype=np.float64)
    got = ann.nearest(table, 20, 20).toPandas()
    assert recall(got, exact(ids, x)) >= 0.97
    split = ann.nearest(table, 20, 20, shard=500).toPandas()
    assert recall(split, exact(ids, x)) >= 0.97
    at = {v: i for i, v in enumerate(ids)}
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part["vec_id"])
        true = np.array([x[at[v]] @ x[at[q]] for v in part["vec_id"]])
        assert np.allclose(part["score"], true, rtol=1e-12, atol=1e-12)
        assert sorted(zip(-part["score"], part["vec_id"], strict=True)) == list(zip(-part["score"], part["vec_id"], strict=True))


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "uneven norms"])
def test_recall_by_inner_product_off_the_sphere(spark, kind):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 64))
    if kind == "clustered":
        x = 3 * draw.normal(size=(20, 64))[draw.integers(0, 20, 3000)] + x / 2
    if kind == "uneven norms":
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(draw.normal(size=(3000, 1)) / 2)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(3000), "embedding": x.tolist()}))
    assert recall(ann.nearest(table, 20, 20).toPandas(), exact(np.arange(3000), x)) >= 0.95


def test_extreme_ragged_and_repeated_vectors(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e160, 0.0]), (2, [1e-200, 0.0]), (3, [5e-324, 0.0]), (4, [1.0, 2.0, 3.0]), (20, [1.0, 0.0, 0.0]), (5, []), (6, [0.0, 1.0]), (6, [0.0, 7.0]), (6, [0.0, 3.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 0] == [1, 6, 2, 3] and [r[2:] for r in got if r[0] == 20] == [(4, 1.0)]
    assert next(r[3] for r in got if r[2] == 6) == 7.0


def test_edges_go_in_diverse_directions():
    x = np.random.default_rng(2).normal(size=(400, 8))
    edges, seeds = ann.build_graph(x, degree=12)
    assert edges.shape == (400, 12) and len(set(seeds.tolist())) == ann.SEEDS
    for i in range(0, 400, 40):
        own = edges[i][edges[i] >= 0]
        assert i not in own and len(set(own)) == len(own)
    met, _ = ann._beam_search(x, edges, seeds, x, 20)
    assert (met[:, 0] == np.arange(400)).mean() > 0.98


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank")
    got = [tuple(r) for r in ann.nearest(df, 20, 20).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (0, 4, 8, -1.0)]
    assert [r[2] for r in got[4:]] == [8, 0, 1, 2]
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    many = ann.nearest(copies, 20, 100).filter("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in many] == list(range(20))
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 20")).count() == 0
