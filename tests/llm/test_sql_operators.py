"""Mixing, licence scan and exact dedup against their SQL, and odd rows."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import difference

from quern.llm import exact_dedup, licence_texts, licences, mixing, registry
from quern.llm.scratch import Scratch

ODD = [(1, None, "a"), (2, "", "a"), (3, "One two", None), (4, "one TWO", "a"), (5, "ÉA", "b"), (6, "Éa", "b"), (7, "w " * 50_000, "b"), (7, "w", "b"), (7, "w w w", "b"), (None, "one two", "c")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with a table of odd rows and one with an empty one."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string").toPandas().astype({"doc_id": "Int64"})
    for name, rows in (("some", docs), ("none", docs.head(0))):
        Path(at, name).mkdir()
        rows.to_parquet(f"{at}/{name}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["op5_mixing", "op6_licences", "op8_exact_dedup"])
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_as_sql(spark, name, folder):
    assert difference(registry.QUERIES[name](spark, folder), registry.ORACLES[name], folder) is None


@pytest.mark.parametrize("name", ["op5_mixing", "op6_licences", "op8_exact_dedup"])
def test_odd_rows_same_as_sql(spark, odd, name):
    assert difference(registry.QUERIES[name](spark, f"{odd}/some"), registry.ORACLES[name], f"{odd}/some") is None
    assert registry.QUERIES[name](spark, f"{odd}/none").count() == 0


def test_directory_doubles_and_chains_hold_collisions(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    cells, depth = exact_dedup.directory(keys, capacity=20, depth=2, step=1)
    rows = cells.collect()
    assert depth > 6 and max(r["local_depth"] for r in rows) <= depth
    held = keys.withColumn("cell", exact_dedup._cell(keys["key"], depth)).join(cells, "cell").groupBy("local_depth", "bucket").count().collect()
    assert sum(r["count"] for r in held) == 5000 and max(r["count"] for r in held) <= 20
    one = spark.createDataFrame([(5, "x")], "key long, t string").select("key")
    assert exact_dedup.directory(one, capacity=0)[1] == exact_dedup.DEEPEST  # equal keys cannot be split


def test_buckets_split_and_rows_are_found_by_the_directory_alone(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    index = exact_dedup.build_index(docs, capacity=4)
    held = index.chains.groupBy("bucket").agg(F.countDistinct("key").alias("n")).collect()
    assert len(held) > 20 and max(r["n"] for r in held) <= 4
    right = exact_dedup.lookup(index)
    assert right.count() == docs.count()
    rows = [tuple(r) for r in index.cells.orderBy("cell").collect()]  # cell, local_depth, bucket
    wrong = [(c, d, b) for (c, d, _), (_, _, b) in zip(rows, rows[1:] + rows[:1], strict=True)]
    cells = spark.createDataFrame(wrong, index.cells.schema)
    assert exact_dedup.lookup(exact_dedup.ExactIndex(index.rows, cells, index.chains, index.depth)).count() < docs.count()


def test_survivors_of_rows_that_repeat_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "A", 2), (2, "b", 3), (None, None, 4), (None, "", 5), (3, "b", 6)], "doc_id long, text string, sha long")
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(((r["doc_id"] or 0), (r["text"] or "").lower()) for r in left.collect()) == [(0, ""), (1, "a"), (3, "b")]


def test_lookup_tells_texts_of_one_chain_apart(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.build_index(docs)
    same_key = lambda df: df.withColumn("key", df["key"] * 0)
    chains = same_key(index.chains).withColumn("chain_length", index.chains["chain_length"] + 1)
    cells = index.cells.limit(1).withColumn("cell", F.lit(0).cast("bigint")).withColumn("bucket", F.lit(0).cast("bigint"))
    forced = exact_dedup.ExactIndex(same_key(index.rows), cells, chains.withColumn("bucket", F.lit(0).cast("bigint")), index.depth)
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.lookup(forced).collect()} == {(1, 2), (2, 2), (3, 3)}


def test_exact_survivors_keep_their_columns(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, kept string")
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in left.collect()) == [(2, ""), (4, "one TWO"), (6, "Éa"), (7, "w"), (7, "w w w"), (7, "w w w w w")]


def test_mix_is_near_its_targets_in_virtual_time_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs, scratch=Scratch(spark, "t")).toPandas()
    assert mixed["finish"].is_monotonic_increasing and (mixed.groupby(["doc_id", "pass"]).size() == 1).all()
    told = mixing.mix_words(docs).toPandas()
    largest = told["size"].max()
    for _, part in told.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 2 * largest
    assert (told["taken"] <= 2 * told["size"]).all()
    assert mixed["size"].sum() == told["taken"].sum() <= 1.5 * told["size"].sum()


def test_targets_reshare_what_sources_cannot_take(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, 1.5, 2).collect()}
    assert got["a"] == 20 and abs(got["b"] - 2 * got["c"]) < 1e-6 and abs(sum(got.values()) - 3015) < 1e-6


def test_repeated_rows_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(7, "w", "b")] * 3 + [(1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix_words(docs).count() == 4
    assert [r["group_size"] for r in exact_dedup.exact_duplicates(docs).filter("doc_id = 7").collect()] == [3, 3, 3]


def test_mixed_rows_repeat_whole_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.filter("text is null or text = ''").count() == 0


def test_licences_by_header_file_and_ancestor(spark):
    files = [
        ("p/LICENSE", dict(licence_texts.STATEMENTS)["MIT"]), ("p/a.py", "x = 1"), ("p/q/LICENSE", "This work is licensed under the GNU General Public License, version 3"), ("p/q/r/b.py", None),
        ("p/q/c.py", "# Licensed under the Apache License, Version 2.0\ny"), ("p/r/d.py", "# a licence of my own"), ("z.py", ""), (None, "x"), ("p/a.py", "x = 1"), ("e/long.py", "word " * 50_000 + "\n# Released under the MIT License"),
    ]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "'x' as licence")
    got = {r["path"]: (r["licence"], r["basis"], r["licence_dir"]) for r in licences.scan(df).collect()}
    assert got["p/a.py"] == ("MIT", "inherited", "p") and got["p/q/r/b.py"] == ("GPL-3.0", "inherited", "p/q")
    assert got["p/q/c.py"] == ("Apache-2.0", "own", None) and got["p/r/d.py"][0] == "MIT" and got["z.py"] == (None, "none", None)
    assert got["e/long.py"][:2] == ("MIT", "own") and len(got) == 8
    assert licences.scan(df.limit(0)).count() == 0


def _cosine(body, templates):
    """The best template of a text and its cosine, in plain Python."""
    words = [Counter(re.findall(licences.TERM, t.lower())) for _, t in templates]
    held = Counter(w for c in words for w in c)
    weigh = lambda c: {w: (1 + math.log(n)) * (math.log((1 + len(words)) / (1 + held[w])) + 1) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    mine, all_of = weigh(Counter(re.findall(licences.TERM, body.lower()))), [weigh(c) for c in words]
    return max((round(sum(x * v.get(w, 0) for w, x in mine.items()) / norm(mine) / norm(v), 9), -i) for i, v in enumerate(all_of))


def test_whole_texts_and_notices_in_comments(spark):
    texts = licence_texts.TEXTS
    split = lambda t: re.sub(r"\n(?=[0-9]\.|THIS|The above|Unless|Anyone)", "\n\n", t)
    files = [(f"f{i}/LICENSE", f"Copyright (c) 2020 Some One\n\n{split(t)}\n") for i, (_, t) in enumerate(texts)]
    files += [(f"c{i}.c", "int a;\n\n/*\n * " + split(t).replace("\n", "\n * ") + "\n */\n\nint main() { return 0; }\n") for i, (_, t) in enumerate(texts)]
    appendix = "word " * 3000 + "\n\n" + dict(texts)["GPL-3.0"] + "\n\n" + "other " * 3000
    files += [("long/COPYING", appendix), ("long/src/deep/x.c", "y"), ("prose.txt", "A licence to print money, and a warrant for it.\n\nNo more.")]
    got = {r["path"]: r for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for i, (name, _) in enumerate(texts):
        assert got[f"f{i}/LICENSE"]["own_licence"] == name and got[f"c{i}.c"]["own_licence"] == name, name
    assert got["long/COPYING"]["own_licence"] == "GPL-3.0" and got["prose.txt"]["basis"] == "none"
    assert (got["long/src/deep/x.c"]["licence"], got["long/src/deep/x.c"]["licence_dir"]) == ("GPL-3.0", "long")
    score, at = _cosine(files[0][1], licences.TEMPLATES)  # a header inside can only do better
    assert got["f0/LICENSE"]["own_score"] >= score > 0.9 and licences.TEMPLATES[-at][0] == texts[0][0]
    assert all(re.search(licences.CUE, t.lower()) for _, t in licences.TEMPLATES)
