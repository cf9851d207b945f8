"""NN-descent against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quern.llm import near_vectors as op
from quern.llm.scratch import Scratch


def plain(ids, x, threshold=0.9):
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = unit @ unit.T >= threshold
    root = dict(zip(ids.tolist(), ids.tolist(), strict=True))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = sorted((find(int(ids[i])), find(int(ids[j]))))
        root[b] = a
    return {int(i): (int(near[k].sum()) - 1, find(int(i))) for k, i in enumerate(ids)}


def told(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def groups(draw, sizes, dims=64, spread=0.08):
    """Vectors around random directions, as many as sizes say; the rest of the table is random."""
    x = [d[None, :] + spread * draw.normal(size=(n, dims)) for n, d in zip(sizes, draw.normal(size=(len(sizes), dims)), strict=True)]
    return np.concatenate(x)


@pytest.mark.parametrize("spread", [0.08, 0.2, 0.33])
def test_links_and_components_of_groups(spark, spread):
    """Pairs in groups have cosines of 0.99, 0.96 and around 0.9."""
    draw = np.random.default_rng(5)
    x = np.concatenate([groups(draw, [2] * 60 + [7] * 20 + [40, 150], spread=spread), draw.normal(size=(1500, 64))])
    ids = draw.permutation(len(x)) + 10
    truth = plain(ids, x)
    got = told(op.near_duplicates(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()})).repartition(5)))
    assert set(got) == set(truth)
    found, there = (sum(t[i][0] for i in t) for t in (got, truth))
    assert 0.99 * there <= found <= there and there > 500
    assert sum(got[i] == truth[i] for i in got) >= 0.99 * len(got)


def test_crowds_are_counted_exactly(spark, monkeypatch):
    """Lists stay short, so that counts come from the components."""
    monkeypatch.setattr(op, "FULL", 14)
    monkeypatch.setattr(op, "BLOCK", 50)
    draw = np.random.default_rng(8)
    x = np.concatenate([groups(draw, [200], spread=0.1), groups(draw, [200], spread=0.3), draw.normal(size=(300, 64))])
    x[10:30] = x[10]  # equal vectors
    ids = np.arange(len(x))
    truth, got = plain(ids, x), told(op.near_duplicates(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))))
    assert sum(got[i] != truth[i] for i in truth) <= 2
    assert all(got[i] == truth[i] for i in range(200))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    rows += [(10, [1e-300, 0.0]), (11, [2.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (12, [-1.0, 0.0]), (13, [1e200, 1e198]), (14, [9.0, float(np.sqrt(19.0)) + 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as nbr", "3 as cos")
    got = told(op.near_duplicates(df))
    alone = {i: (0, i) for i in (4, 5, 6, 7, 8, 9, 11, 12)}
    assert got == alone | {None: (0, None)} | {i: (4, 1) for i in (1, 3, 10)} | {2: (5, 1), 13: (5, 1), 14: (2, 1)}
    kept = {r["vec_id"]: r["kept"] for r in op.near_duplicates(df).collect()}
    assert kept[None] and kept[1] and kept[5] and not kept[2]
    assert op.near_duplicates(df.limit(0)).count() == 0 and told(op.near_duplicates(df.filter("vec_id = 4"))) == {4: (0, 4)}


def test_the_audit_asks_for_more_rounds(spark, monkeypatch):
    """With one order and no time for rounds links are missing; the audit adds orders until they are found."""
    draw = np.random.default_rng(2)
    x = np.concatenate([groups(draw, [2] * 150, spread=0.3), draw.normal(size=(300, 64))])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    for name, value in {"ORDERS": 1, "ROUNDS": (1, 1), "LIST": 3, "SAMPLE": 2, "LEAF": 16}.items():
        monkeypatch.setattr(op, name, value)
    truth = plain(np.arange(len(x)), x)
    calls, inner = [], op._leaves
    monkeypatch.setattr(op, "_leaves", lambda *a: calls.append(a[1:]) or inner(*a))
    got = told(op.near_duplicates(df, scratch=Scratch(spark, "audit")))
    assert len(calls) > 1 and sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in truth.values())
