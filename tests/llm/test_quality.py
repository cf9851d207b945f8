"""Bradley-Terry quality scores on held-out labels, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from quern.llm import quality, registry


def test_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    got = registry.op1_quality(spark, at)
    labels = spark.read.parquet(f"{at}/labels.parquet").filter("quality is not null")
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"].to_numpy(), rows[rows["quality"] == 0]["score"].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert len(rows) > 300 and auc > 0.95
    assert (rows["predicted"] == rows["quality"]).mean() > 0.9


def test_columns_and_the_held_out_rule(spark, tiny):
    got = registry.op1_quality(spark, tiny).collect()
    assert len(got) == spark.read.parquet(f"{tiny}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_labels_are_not_learned_from(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels).weights, quality.fit(docs, turned).weights)


def test_pairs_recover_a_linear_order():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    label = (x @ np.array([2.0, -1.0, 0.0]) > 0).astype(int)
    model = quality.fit_pairs(x, label)
    assert ((model.score(x) >= quality.CUT_SCORE) == (label == 1)).mean() > 0.97
    assert model.weights[0] > 0 > model.weights[1] and abs(model.weights[2]) < 0.3 * model.weights[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "some text", 0.5), (4, "word " * 40_000, 0.5), (4, "word", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and all(r["predicted"] == 1 for r in got)
    unclear = spark.createDataFrame([(1, None), (2, 1), (2, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    rows = {(r["doc_id"], r["score"]) for r in quality.classify(docs, unclear).collect()}
    assert len({s for d, s in rows if d in (1, 2)}) == 1
    assert quality.classify(docs.limit(0), unclear).count() == 0
    assert quality.drop_rejected(docs, none).columns == docs.columns
