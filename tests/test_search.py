"""Full-text search, many query vectors and callbacks on cases told by hand or by brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from quern.operators import callbacks, full_text, vector_join


def test_clauses_of_a_query():
    assert full_text.clauses_of('big "red  Fox" -slow') == [[(False, ["big"]), (False, ["red", "fox"]), (True, ["slow"])]]
    assert full_text.clauses_of('a or b c OR -"d e') == [[(False, ["a"])], [(False, ["b"]), (False, ["c"])], [(True, ["d", "e"])]]
    assert full_text.clauses_of("or !? -") == full_text.clauses_of(None) == full_text.clauses_of('""') == []
    assert full_text.clauses_of('"or" x') == [[(False, ["or"]), (False, ["x"])]]


def plain(docs, text):
    """By id: (covers, rank) with every stretch tried."""
    out = {}
    for i, t in docs:
        words, total, n, hit = (t or "").lower().split(), 0.0, 0, False
        for alternative in full_text.clauses_of(text):
            found = [(neg, len(c), [k for k in range(len(words)) if words[k : k + len(c)] == c]) for neg, c in alternative]
            if any(neg and at for neg, _, at in found) or any(not neg and not at for neg, _, at in found):
                continue
            hit, wanted = True, [(size, at) for neg, size, at in found if not neg]
            whole = {(a, b) for a, b in itertools.combinations_with_replacement(range(len(words)), 2) if all(any(a <= p and p + size - 1 <= b for p in at) for size, at in wanted)} if wanted else set()
            for a, b in whole:
                if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole):
                    n, total = n + 1, total + 0.4 / (1 + max(0, b - a + 1 - sum(size for size, _ in wanted)))
        if hit:
            out[i] = (n, round(total / (1 + total), 6))
    return out


@pytest.mark.parametrize("text", ["a b", '"a b" c', "a or b c", '"a a"', "a -b", "-a", 'a "b c" -d or d', "a b c d", "zz", "zz or a", ""])
def test_matches_by_trying_every_stretch(spark, text):
    draw = random.Random(3)
    docs = [(k, " ".join(draw.choice("abcdxyz") for _ in range(draw.randint(0, 14)))) for k in range(60)] + [(90, None), (91, "a b"), (92, "A a A a")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(7, text)], "query_id long, text string")
    got = {r["id"]: (r["covers"], r["rank"]) for r in full_text.matches(df, asked).collect()}
    assert got == plain(docs, text)
    if text == "a b":
        assert {r["id"] for r in full_text.matches(df, asked, full_text.postings(df)).collect()} == set(got)


def test_nearest_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "ROWS", 40)
    monkeypatch.setattr(vector_join, "ASKED", 7)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 6)).round(1)
    x[50:60], x[70] = x[50], 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (901, [float("nan")] * 6), (902, [1.0]), (903, [])], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 10 = 0 or vec_id > 899").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vector_join.similar_to_each(df, asked, 5, 0.2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
    norm = np.sqrt((x * x).sum(axis=1))
    for q in range(0, 200, 10):
        sim = np.divide(x @ x[q], norm * norm[q], out=np.zeros(200), where=norm * norm[q] > 0).round(6)
        want = [(int(i), float(sim[i])) for i in np.lexsort((np.arange(200), -sim)) if i != q and sim[i] > 0.2][:5]
        assert got.pop(q, []) == pytest.approx(want) if not want else [w[0] for w in want] == [g[0] for g in (got.get(q) or [])]
    assert not {900, 901, 903} & set(got) and 902 not in got
    alone = vector_join.similar_to_each(df, asked.filter("query_id = 902"), 5, own=True).collect()
    assert [(r["vec_id"], r["similarity"]) for r in alone] == [(902, 1.0)]
    assert vector_join.similar_to_each(df.limit(0), asked, 5).count() == 0


def test_reranking_contract(spark):
    rows = [(q, 10 * q + k, k + 1, f"text {k}") for q in range(4) for k in range(4)] + [(9, 99, 1, None)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, text string").repartition(3)
    asked = spark.createDataFrame([(0, "fine"), (1, "fails"), (2, "odd"), (3, "  "), (9, "fine")], "query_id long, text string")

    def setup():
        def score(query, texts):
            if query == "fails":
                raise RuntimeError("limit reached")
            if query == "odd":
                return [(3, 7.5), (0, float("nan")), (44, 1.0), (-1, 1.0), ("1", 1.0), (3, 0.1), (2, -3)]
            return [(k, (k + 1) / 10) for k in range(len(texts))]

        return score

    got = {}
    for r in callbacks.rerank(df, asked, setup, calibrated=False).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["rerank"]))
        assert r["calibrated"] is False
    assert got[0] == [(3, 0.4), (2, 0.3), (1, 0.2), (0, 0.1)]
    assert got[1] == [(10, None), (11, None), (12, None), (13, None)] and [i for i, _ in got[3]] == [30, 31, 32, 33]
    assert got[2] == [(23, 1.0), (20, 0.0), (22, 0.0), (21, None)] and got[9] == [(99, 0.1)]
    short = callbacks.rerank(df, asked, setup, calibrated=True, k=2, most=3).filter("query_id = 0").orderBy("rank").collect()
    assert [(r["id"], r["old_rank"]) for r in short] == [(2, 3), (1, 2)]
    assert callbacks.rerank(df.limit(0), asked, setup, True).count() == 0


def test_callbacks_over_batches(spark):
    df = spark.createDataFrame([(k, f"t{k}" if k != 5 else None) for k in range(20)], "id long, text string").coalesce(1)

    def setup():
        made = []

        def call(values):
            made.append(len(values))
            if "t9" in values:
                raise ValueError("no")
            return values[:-1] if "t12" in values else [[v or "", str(len(made))] for v in values]

        return call

    got = {r["id"]: r["out"] for r in callbacks.mapped(df, "text", setup, "out", "array<string>", batch=4).collect()}
    assert got[0] == ["t0", "1"] and got[5] == ["", "2"] and got[16] == ["t16", "5"]  # one setup for all batches of the task
    assert all(got[k] is None for k in range(8, 16))
