"""Hard negatives against every product worked out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives as op


def plain(rows, every=100, k=5):
    """rows: (vec_id, label, ints)."""
    out = []
    for anchor, own, a in rows:
        if anchor % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a, v, strict=False)), i, label) for i, label, v in rows if i != anchor]
        for ps, positive, _ in sorted(s for s in scores if s[2] == own)[:k]:
            fit = sorted(s for s in scores if s[2] != own and -80 * ps <= -100 * s[0] <= -100 * ps)[:k]
            out += [(anchor, positive, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fit)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["unit", "clustered", "one cell", "large"])
def test_same_as_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(op, "PER_PIVOT", 40)
    monkeypatch.setattr(op, "GROUP", 7)
    monkeypatch.setattr(op, "BLOCK", 50)
    draw = np.random.default_rng(9)
    x = draw.normal(size=(800, 8))
    if kind == "clustered":
        x = 20 * draw.normal(size=(12, 8))[draw.integers(0, 12, 800)] + x / 3
    if kind == "one cell":
        x[:500] = np.round(x[0] + x[:500] / 1000, 3)  # many equal scores
    if kind == "large":
        x = x * 50_000
    ints = np.floor(x * (40 if kind != "large" else 256)).clip(-(1 << 24), 1 << 24).astype(int)
    rows = [(int(i), int(draw.integers(0, 4)), [int(c) for c in v]) for i, v in enumerate(ints)]
    df = spark.createDataFrame(rows, "vec_id long, label long, ints array<int>").repartition(6)
    assert told(op.mine(df, every=20)) == plain(rows, every=20)


def test_cells_out_of_reach_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_PIVOT", 50)
    draw, seen = np.random.default_rng(3), []
    x = np.floor(200 * (30 * draw.normal(size=(10, 8))[np.arange(1000) % 10] + draw.normal(size=(1000, 8)))).astype(int)
    rows = [(int(i), int(i) % 3, [int(c) for c in v]) for i, v in enumerate(x)]
    inner = op.routes
    monkeypatch.setattr(op, "routes", lambda groups, between, cells, slack: seen.append((groups.select("group").distinct().count() * cells.count(), (w := inner(groups, between, cells, slack)).count())) or w)
    monkeypatch.setattr(op, "GROUP", 2)
    df = spark.createDataFrame(rows, "vec_id long, label long, ints array<int>")
    assert told(op.mine(df, every=25)) == plain(rows, every=25)
    assert all(sent < 0.7 * everything for everything, sent in seen), seen


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (7, [0.5, 0.5], 0), (100, [0.0, 0.0], 2), (3, [0.9, 0.1], 2), (4, [0.9, 0.1], 2), (4, [0.9, 0.1], 2), (5, None, 1), (6, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1)]
    rows += [(10, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (11, [-0.001, 3.0e38], 3), (200, [1.0, 0.0], 5), (12, [0.8], 1), (14, [0.25, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as ints", "2 as cell", "3 as rank")
    fit = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v):
            ints = [int(max(-(1 << 24), min(1 << 24, np.floor(256 * c)))) for c in map(float, np.float32(v))]
            fit[i] = (i, (label + 1) % 10 if i % 7 == 0 else label, ints)
    got = told(op.mine(op.usable(df)))
    assert got == plain(list(fit.values())) and got
    assert op.mine(op.usable(df.limit(0))).count() == 0 and op.mine(op.usable(df.filter("vec_id = 0"))).count() == 0
    assert op.usable(df).filter("vec_id = 0").first()["label"] == 2 and op.usable(df).filter("vec_id = 14").first()["label"] == 0


def test_a_full_cell_is_dealt_over_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 10)
    same = spark.range(100).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.lit(0).alias("cell"))
    held = [r["count"] for r in op.grouped(same, "label").groupBy("group").count().collect()]
    assert len(held) == 10 and max(held) < 30
    spread = spark.range(100).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.col("id").cast("int").alias("cell"))
    held = [r["count"] for r in op.grouped(spread).groupBy("group").count().collect()]
    assert held == [10] * 10
