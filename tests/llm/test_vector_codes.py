"""Codes of vectors against plain int64 arithmetic."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quern.llm import vector_codes as op


def plain(rows):
    """By vec_id: (code, error, label_error, sha) with every distance worked out."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(np.float64(c) * 1024)) for c in r[1]] for r in kept], dtype=np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()

    def assigned():
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return apart.argmin(axis=2), apart.min(axis=2).sum(axis=1)

    for _ in range(4):
        code, _ = assigned()
        for p in range(4):
            for e in range(books.shape[1]):
                if (own := x[code[:, p] == e, p]).size:
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, error = assigned()
    by = {}
    for r, e in zip(kept, error.tolist(), strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c:02x}" for c in cs), e, by[r[2]], sha) for r, cs, e in zip(kept, code.tolist(), error.tolist(), strict=True))


def told(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["units", "copies", "large", "five wide"])
def test_same_as_plain_arithmetic(spark, kind):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(700, 5 if kind == "five wide" else 16))
    if kind == "copies":
        x = np.round(x[draw.integers(0, 40, 700)], 1)
    if kind == "large":
        x = x * 3000 + 20_000  # products far beyond 24 bits
    rows = [(int(i), [float(c) for c in v.astype(np.float32)], int(i) % 3 or None) for i, v in enumerate(x)]
    assert told(op.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, None, 1), (2, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1)]
    rows += [(6, [-0.0001, 0.0, 0.0, 0.0], None), (6, [-0.0001, 0.0, 0.0, 0.0], None), (None, [0.5, 0.5, 0.5, 0.5], 2), (7, [0.0, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(op.compress(df.selectExpr("*", "1 as ints", "'x' as code", "2 as error"))) == plain(rows)
    assert op.compress(df.limit(0)).count() == 0 and op.compress(df.filter("vec_id = 1")).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0), (3, [], 0)], SCHEMA)
    assert len({r["codebooks_sha256"] for r in op.compress(two).collect()}) == 3


def test_the_best_entry_is_always_among_the_candidates():
    draw = np.random.default_rng(1)
    for width, size in ((16, 1000), (3, 1 << 26), (64, 1 << 20), (16, 3)):
        x, book = (draw.integers(-size, size + 1, (n, width)) for n in (500, 256))
        book[10] = book[200]
        x[:50] = book[draw.integers(0, 256, 50)] + draw.integers(-1, 2, (50, width))  # near ties
        apart = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        row, entry = op.candidates(x, book)
        assert set(zip(*np.nonzero(apart == apart.min(axis=1)[:, None]), strict=True)) <= set(zip(row, entry, strict=True))
        if size == 1000:
            assert len(row) < 2 * len(x)  # and few others are
        index, distance = op.nearest_entry(x, book)
        assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_codes_stand_for_near_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = op.whole_numbers(table, op.SCALE, op.LARGEST, "label").persist()
    books = op.train(rows, 64)
    coded = {r["vec_id"]: r for r in op.encode(rows, books, 64).collect()}
    for r in rows.limit(200).collect():
        got = coded[r["vec_id"]]
        assert ((op.decode(got["code"], books) - np.array(r["ints"])) ** 2).sum() == got["error"]
    first = np.mean([r["error"] for r in op.encode(rows, op._parts(np.array([r["ints"] for r in rows.orderBy("vec_id").limit(256).collect()])).transpose(1, 0, 2).copy(), 64).collect()])
    assert np.mean([r["error"] for r in coded.values()]) < first  # the rounds lower it
    rows.unpersist()
