"""Full-text search with phrases, OR and minus over positional postings.

A query is alternatives, joined by ``or``; an alternative is words and "quoted phrases" that all occur, and others after a minus that
don't. Words are those of ``rank_tokens``; nothing is stemmed and no word is left out. Postings are restricted to the words asked for before they
move, and lie by document, so that phrases, alternatives and ranks are told where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import RANK_TOKEN, rank_tokens
from quern.plans.lineage import cut

#: Weight of words of a text; words of all queries up to which they are sent to all tasks.
WEIGHT, FEW = 0.4, 100_000
CLAUSES = "query_id long, alternative int, clause int, negated boolean, size int, place int, word string"


def clauses_of(text: str | None) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (whether it is negated, words); an alternative without words is left out."""
    out, now = [], []
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', (text or "").lower()):
        if not minus and bare == "or":
            out.append(now)
            now = []
        elif words := re.findall(RANK_TOKEN, quoted or bare):
            now.append((bool(minus), words))
    return [a for a in [*out, now] if a]


def clauses(queries: DataFrame) -> DataFrame:
    """A row for each word of each clause of ``queries`` (query_id, text)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [
                (q, a, c, negated, len(words), p, w)
                for q, text in zip(part["query_id"], part["text"], strict=True)
                for a, held in enumerate(clauses_of(text))
                for c, (negated, words) in enumerate(held)
                for p, w in enumerate(words)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CLAUSES.split(", ")])

    return queries.select("query_id", "text").mapInPandas(parse, CLAUSES)


def postings(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(id, word, pos) of every word of ``docs`` (id, text), or of ``words`` (word) alone. Written as a table it is the index of a corpus."""
    told = docs.select("id", F.posexplode(rank_tokens(F.col("text"))).alias("pos", "word"))
    return told.join(words, "word", "left_semi") if words is not None else told


def matches(docs: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, id, covers, rank) of the documents (id, text) that match each query (query_id, text).

    A cover is a shortest stretch that holds an occurrence of every word and phrase of an alternative; covers is their number and rank r / (1 + r), where r
    adds ``WEIGHT`` / (1 + other words in it) for each. An alternative of negated clauses alone matches all other documents, with rank 0. A query without words
    matches nothing. ``index`` is the written postings of ``docs``, if there are any.
    """
    asked = cut(clauses(queries))
    sent = F.broadcast if asked.limit(FEW + 1).count() <= FEW else (lambda df: df)
    words, key = sent(asked.select("word").distinct()), ["query_id", "alternative"]
    # words that nobody asks for go before anything is moved
    held = index.join(words, "word", "left_semi") if index is not None else postings(docs, words)
    at = held.repartition("id").join(sent(asked), "word")
    occurs = at.groupBy("id", *key, "clause", "negated", "size", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).filter("n = size")
    wanted = asked.groupBy(*key).agg(F.countDistinct(F.when(~F.col("negated"), F.col("clause"))).alias("wanted"), F.count_if("negated").alias("minus"))
    hits = occurs.groupBy("id", *key).agg(F.countDistinct(F.when(~F.col("negated"), F.col("clause"))).alias("has"), F.count_if("negated").alias("bad"))
    full = hits.filter("bad = 0").join(wanted, key).filter("has = wanted").select("id", *key, "wanted")
    places = occurs.filter("not negated").join(full, ["id", *key]).withColumn("end", F.col("start") + F.col("size") - 1)
    # the latest start of each clause up to an end: the earliest of them begins the stretch, and of those that begin there the first end is the shortest
    each = places.withColumn("of", F.explode(F.sequence(F.lit(0), F.col("wanted").cast("int") - 1)))
    ordinal = places.select("id", *key, "clause").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("id", *key).orderBy("clause")) - 1)
    each = each.join(ordinal, ["id", *key, "clause"])
    upto = Window.partitionBy("id", *key, "of").orderBy("end", "start", "clause").rowsBetween(Window.unboundedPreceding, 0)
    last = each.withColumn("_last", F.max(F.when(F.col("nth") == F.col("of"), F.struct("start", "size"))).over(upto))
    stretch = last.groupBy("id", *key, "clause", "start", "end", "wanted").agg(F.min("_last.start").alias("begin"), F.sum("_last.size").alias("held"), F.count("_last").alias("complete"))
    covers = stretch.filter("complete = wanted").groupBy("id", *key, "begin").agg(F.min(F.struct("end", "held")).alias("c"))
    noise = F.greatest(F.lit(0), F.col("c.end") - F.col("begin") + 1 - F.col("c.held"))
    told = covers.groupBy("query_id", "id").agg(F.count("*").alias("covers"), F.sum(WEIGHT / (1 + noise)).alias("r"))
    bare = wanted.filter("wanted = 0 and minus > 0").select(*key)
    all_others = docs.select("id").join(F.broadcast(bare)).join(hits.filter("bad > 0").select("id", *key), ["id", *key], "left_anti") if not bare.isEmpty() else None
    if all_others is not None:
        told = told.unionByName(all_others.select("query_id", "id", F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("r"))).groupBy("query_id", "id").agg(F.sum("covers").alias("covers"), F.sum("r").alias("r"))
    return told.select("query_id", "id", "covers", F.round(F.col("r") / (1 + F.col("r")), 6).alias("rank"))

