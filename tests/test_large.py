"""Work that must not grow with a table or a group: upserts by bucket, trees of large groups."""

from __future__ import annotations

import math
import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cells, chunking, quantiles, retrieval
from quern.streaming import buckets

ROWS = "k string, v string, at long"


def size(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_a_batch_writes_the_buckets_of_its_keys(spark, tmp_path):
    out = f"{tmp_path}/out"
    table = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.sha1(F.col("id").cast("string")).alias("v"), F.lit(1).cast("long").alias("at"))
    assert buckets.read_buckets(spark, out) is None
    assert buckets.merge_batch(table, out, ["k"], "at", buckets=16) == list(range(16))
    small = spark.createDataFrame([("7", "old", 1), ("7", "new", 3), ("7", "between", 2), ("x", "added", None), (None, "no key", 1)], ROWS)
    touched = buckets.merge_batch(small, out, ["k"], "at")
    assert touched == sorted({r[0] for r in small.select(buckets.bucket_of(["k"], 16)).collect()}) and len(touched) <= 3
    assert size(f"{out}/data/version=1") < len(touched) / 10 * size(f"{out}/data/version=0")
    found = {r["k"]: r["v"] for r in buckets.read_buckets(spark, out).collect()}
    assert len(found) == 4002 and found["7"] == "new" and found["x"] == "added" and found[None] == "no key"
    # a repeated batch and an empty one change nothing
    buckets.merge_batch(small, out, ["k"], "at")
    assert buckets.merge_batch(small.limit(0), out, ["k"], "at") == []
    again = buckets.read_buckets(spark, out)
    assert again.columns == ["k", "v", "at"] and {r["k"]: r["v"] for r in again.collect()} == found
    # three batches, two manifests are left; of the first batch the buckets that are still named stay
    assert sorted(os.listdir(f"{out}/manifest")) == ["version=1", "version=2"]
    first = {int(x.split("=")[1]) for x in os.listdir(f"{out}/data/version=0") if "=" in x}
    assert first == set(range(16)) - set(touched)


def test_a_failed_batch_is_not_seen(spark, tmp_path):
    out = f"{tmp_path}/out"
    buckets.merge_batch(spark.createDataFrame([("a", "1", 1)], ROWS), out, ["k"], "at", buckets=2)
    spark.createDataFrame([("a", "lost", 9)], ROWS).write.parquet(f"{out}/data/version=1/{buckets.BUCKET}=0")  # data without manifest
    assert [r["v"] for r in buckets.read_buckets(spark, out).collect()] == ["1"]
    buckets.merge_batch(spark.createDataFrame([("b", "2", 1)], ROWS), out, ["k"], "at")
    assert sorted(r["v"] for r in buckets.read_buckets(spark, out).collect()) == ["1", "2"]


def test_stream_upserts_by_bucket(spark, tmp_path):
    for rows in ([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "2", 2)]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        buckets.upsert_buckets(stream, f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/check").awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in buckets.read_buckets(spark, f"{tmp_path}/out").collect()) == [("a", "2"), ("b", "1"), ("c", "2")]


def grouped(spark, sizes: dict[str, int], dims: int = 8):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(10, dims)) * 6
    rows = [(g, i, (centre[i % 10] + draw.normal(size=dims)).tolist()) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc string, id long, embedding array<double>")


def test_cells_stay_small_and_lose_no_row(spark):
    points = grouped(spark, {"a": 900, "b": 260}).withColumn("weight", F.lit(1.0))
    same = spark.range(500).select(F.lit("same").alias("doc"), F.lit(1).cast("long").alias("id"), F.array(*[F.lit(1.0)] * 8).alias("embedding"), F.lit(1.0).alias("weight"))
    found = cells.cells(points.union(same), "doc", most=100, ways=6, rounds=2)
    held = {(r["doc"], r["cell"]): r["n"] for r in found.groupBy("doc", "cell").agg(F.count("*").alias("n")).collect()}
    total = {g: sum(n for (d, _), n in held.items() if d == g) for g in ("a", "b", "same")}
    assert total == {"a": 900, "b": 260, "same": 500}
    assert max(n for (d, _), n in held.items() if d != "same") <= 100
    assert max(n for (d, _), n in held.items() if d == "same") <= 160  # equal vectors are dealt by hash
    assert found.groupBy("doc", "row").count().filter("count > 1").isEmpty()


def test_tree_of_a_large_group(spark, tmp_path):
    chunks = grouped(spark, {"big": 700, "small": 60, "few": 5})
    whole = chunking.summary_tree(chunks, "doc")
    cut = chunking.summary_tree(chunks, "doc", most=128, folder=f"{tmp_path}/tree")
    sums = lambda df: {(r["doc"], r["level"]): r["n"] for r in df.groupBy("doc", "level").agg(F.sum("n").alias("n")).collect()}
    assert sums(cut) == sums(whole) == {("big", 1): 700, ("big", 2): 700, ("small", 1): 60, ("small", 2): 60}
    # groups below the bound are the same ones
    small = lambda df: sorted(map(str, df.filter("doc = 'small'").collect()))
    assert small(cut) == small(whole)
    big = cut.filter("doc = 'big' and level = 1").toPandas().sort_values("node")
    assert big["node"].tolist() == list(range(len(big))) and abs(len(big) - 140) <= 15
    # as good as one task's: the mean cosine of a chunk to its closest node is about the same
    x = np.array([r["embedding"] for r in chunks.filter("doc = 'big'").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def fit(nodes):
        c = np.array(nodes["centroid"].tolist())
        return (x @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T).max(axis=1).mean()

    assert fit(big) > fit(whole.filter("doc = 'big' and level = 1").toPandas()) - 0.01
    # a second run reads the levels that are there
    stamp = os.stat(f"{tmp_path}/tree/level=1/_SUCCESS").st_mtime_ns
    again = chunking.summary_tree(chunks, "doc", most=128, folder=f"{tmp_path}/tree")
    assert again.count() == cut.count() and os.stat(f"{tmp_path}/tree/level=1/_SUCCESS").st_mtime_ns == stamp


@pytest.mark.parametrize("n", [0, 1])
def test_tree_of_nothing(spark, n):
    assert chunking.summary_tree(grouped(spark, {"a": n}), "doc").count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_by_sorting_and_by_buckets(spark, monkeypatch, keys):
    draw = random.Random(11)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 3.5, float(draw.randrange(30)), draw.gauss(0, 1e6)])) for _ in range(6000)] + [("one", 2.0), ("empty", None)]
    counted = quantiles.counted_values(spark.createDataFrame(rows, "k string, v double").repartition(3), keys)
    marks = quantiles.MARKS | quantiles.UPPER_MEDIAN
    sorted_by = lambda: sorted(map(str, quantiles.at_ranks(counted, keys, marks).collect()))
    monkeypatch.setattr(quantiles, "SORTED", 1 << 62)
    plain = sorted_by()
    monkeypatch.setattr(quantiles, "SORTED", -1)
    assert sorted_by() == plain and len(plain) == (4 if keys else 1)
    if not keys:
        values, row = sorted(v for _, v in rows if v is not None), quantiles.at_ranks(counted, keys, marks).first()
        assert [row[m] for m in quantiles.MARKS] == [values[math.ceil(len(values) * p) - 1] for p in (0.5, 0.95, 0.99)] and row["median"] == values[len(values) // 2]
        assert quantiles.at_ranks(counted.limit(0), keys, marks).collect() == [(None,) * 4]


def test_names_by_their_rarest_run(spark):
    draw = random.Random(2)
    words = ["the", "theory", "then", "bath", "at", "Ab", "c-3", "ölen", "x y"]
    questions = [(k, " ".join(draw.choices(words, k=5))) for k in range(60)] + [(60, None), (61, ""), (62, "th")]
    entities = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 3)))) for k in range(40)] + [(40, None), (41, "th"), (42, "absent"), (43, "the"), (44, "THE.")]
    ask, named = spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame(entities, "entity long, name string")
    plain = lambda df, c, k: {r[k]: r["n"] for r in df.select(k, retrieval.normalize_name(F.col(c)).alias("n")).collect()}
    q, e = plain(ask, "text", "query_id"), plain(named, "name", "entity")
    want = sorted((a, b) for a, text in q.items() for b, n in e.items() if len(n) >= 3 and n in text)
    assert sorted(map(tuple, retrieval.named_entities(ask, named).collect())) == want and len(want) > 100
