"""Sampled segmentations: lossless, repeatable, and drawn by the weights of whole paths."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import piece_sampling as ps

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return ps.Lattice(MODEL)


def paths(lattice, text: str) -> dict[tuple[int, ...], float]:
    """Every segmentation of a text with its log weight, by recursion over the whole text."""
    if not text:
        return {(): 0.0}
    out = {}
    edges = [(p, *lattice.pieces[p]) for k in range(1, len(text) + 1) if (p := text[:k]) in lattice.pieces]
    spelled = [int(lattice.byte[b]) for b in text[0].encode()]
    for piece, ids, weight in [*[(p, (i,), w) for p, i, w in edges], (text[0], tuple(spelled), lattice.byte_weight * len(spelled))]:
        for rest, more in paths(lattice, text[len(piece) :]).items():
            out[ids + rest] = np.logaddexp(out.get(ids + rest, -np.inf), weight + more)
    return out


@pytest.mark.parametrize("text", ["the cat", "aé", "in, on", "ab\nab"])
def test_draws_follow_the_weights_of_all_paths(lattice, text):
    exact = paths(lattice, (ps.MARK + text).replace(" ", ps.MARK))
    whole = np.logaddexp.reduce(list(exact.values()))
    n = 20_000
    seen = Counter(tuple(x.tolist()) for x in lattice.sample([text] * n, np.arange(n, dtype=np.uint64), 3))
    assert set(seen) <= set(exact)
    for path, weight in exact.items():
        p = math.exp(weight - whole)
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n


def test_documents_decode_to_themselves_and_repeat(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    first = {r["doc_id"]: r for r in ps.digests(docs, MODEL).collect()}
    again = {r["doc_id"]: r for r in ps.digests(docs.repartition(7), MODEL).collect()}
    assert first == again and all(r["lossless"] for r in first.values() if r["lossless"] is not None)
    crc = {r["doc_id"]: r["c"] for r in docs.select("doc_id", F.crc32("text").alias("c")).collect()}
    assert {d: r["decoded_crc32"] for d, r in first.items()} == crc
    other = {r["doc_id"]: r["ids_crc32"] for r in ps.digests(docs, MODEL, seed=18).collect()}
    assert sum(other[d] != first[d]["ids_crc32"] for d in first) > 0.9 * len(first)


def test_odd_rows(spark):
    texts = [None, "", " ", "  a  b ", "\n\n", f"x{ps.MARK}y {ps.MARK}", "日本 😀", "\t\u0000 q", "long " * 30_000, "same", "same"]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, pieces string")
    got = {r["doc_id"]: r for r in ps.segment(docs, MODEL).collect()}
    assert got[0]["pieces"] is None and got[0]["lossless"] is None
    assert all(r["lossless"] for d, r in got.items() if d != 0)
    assert ps.segment(docs.limit(0), MODEL).count() == 0
    twin = [r["pieces"] for r in ps.segment(docs.filter("text = 'same'").withColumn("doc_id", F.lit(9).cast("long")), MODEL).collect()]
    assert twin[0] == twin[1]
