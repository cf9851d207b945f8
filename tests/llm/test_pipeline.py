"""The stages of the pipeline, each held against plain Python on what the stage before it kept."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quern.llm import mixing, quality
from test_near_dedup import by_hand


def test_stages_take_effect(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    whole = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    scored = quality.classify(whole, spark.read.parquet(f"{tiny}/labels.parquet"))
    good = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    first = rows(kept["quality"])
    assert first == [r for r in rows(whole) if r[0] in good] and 0 < len(first) < whole.count()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    last = {lower(t): d for d, t in first}
    second = rows(kept["exact_dedup"])
    assert [d for d, _ in second] == sorted(last.values())
    third = rows(kept["near_dedup"])
    assert [d for d, _ in third] == sorted(d for d, (_, c) in by_hand(second, 5, 80).items() if d == c)
    mixed = Counter(d for d, _ in rows(kept["mixing"]))
    assert set(mixed) <= {d for d, _ in third} and max(mixed.values()) == 2
    pieces = kept["sentencepiece"].filter("text is not null").select("text", "lossless", "decoded_crc32", F.size("pieces").alias("n")).collect()
    assert all(r["lossless"] and r["decoded_crc32"] == zlib.crc32(r["text"].encode()) for r in pieces) and sum(mixed.values()) == kept["sentencepiece"].count()


def test_run_gives_the_last_stage(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"] and out.count() > 0


def test_odd_rows_pass_all_stages(spark, tiny, tmp_path):
    long = "word " * 60_000
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "A b c d e f.", None, None, 12), (4, "a b c d e F.", "en", "s", 12), (4, "a b c d e F.", "en", "s", 12), (None, "x y z", "en", "t", 5), (6, long, "en", "t", len(long))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, sha string, mix_key string, no_id boolean, sample_key long"
    docs = spark.createDataFrame([(*r, 0.5, "z", "k", False, 3) for r in rows], schema)
    for name, table in (("some", docs), ("none", docs.limit(0))):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, tiny).write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns
        assert (now.count() == 0) == (name == "none")
        if name == "some":
            kept = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/some1").collect()]
            assert len(kept) == len(set(kept)) and 3 not in kept


def test_mixed_rows_tell_rows_of_one_id_and_size_apart(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "c d", "s"), (1, "c d", "s"), (2, "e f g", "t"), (3, None, "t")], "doc_id long, text string, source string")
    told = mixing.mix_words(docs).agg(F.sum("taken").alias("n")).first()["n"]
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.agg(F.sum(mixing.words(F.col("text"))).alias("n")).first()["n"] == told
