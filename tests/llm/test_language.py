"""Output-code language identification on held-out rows, and odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.llm import language, registry


def test_held_out_languages(spark):
    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang")
    got = registry.op2_language(spark, at).filter("held_out and lang_pred != 'und'").join(docs, "doc_id").filter("lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 1000 and right > 0.97


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 6, 20):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4) and set(np.unique(code)) == {-1.0, 1.0}


def test_decoding_forgives_a_wrong_bit():
    code = language.codewords(4)
    model = language.OutputCode(["a", "b", "c", "d"], code, np.zeros((1, code.shape[1])), np.ones(code.shape) / code.shape[1])
    for k in range(4):
        for bit in range(code.shape[1]):
            margins = 2 * code[k]
            margins[bit] *= -0.2
            assert model.losses(margins).argmin() == k


def test_odd_rows(spark, tiny):
    learned = language.fit(spark.read.parquet(f"{tiny}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (None, "the house and the garden of the old man"), (5, "the river and the town " * 20_000), (5, "été")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = language.identify(docs, learned).collect()
    by = {(r["doc_id"], r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3)}
    assert by == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} and len(got) == 6
    assert all(0 <= r["score"] <= 1 for r in got)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    assert language.identify(unlabelled.limit(0)).count() == 0
