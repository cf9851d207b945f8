"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams
predicts from the whole text whether the bit is set. Decoding sums, over the bits, the logistic loss
of the prediction against each codeword, weighted by how well that bit's classifier did on training
rows of that language; the codeword with the least loss wins, and a close runner-up marks the row as
ambiguous.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.quality import held_out

#: Expected number of training documents of a language (taken by a hash of doc_id), and n-gram buckets.
ROWS_PER_LANGUAGE, BUCKET_BITS = 600, 16
#: Runner-up within this share of the best loss: ambiguous.
CLOSE = 0.15
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = 1 << 16


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the lower-cased letters and single spaces of a whole text, in blocks."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    for at in range(0, max(1, len(raw) - 2), _BLOCK):
        b = np.frombuffer(raw[at : at + _BLOCK + 2], dtype=np.uint8).astype(np.uint32)
        if len(b) > 2:
            yield ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits of up to 6 languages, else the best spread of seeded draws."""
    if n <= 6:
        splits = np.arange(1, max(2, 2 ** (n - 1)))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits, draw = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    tries = [np.where(draw.random((n, bits)) < 0.5, -1.0, 1.0) for _ in range(50)]
    return max(tries, key=lambda c: -np.max(np.abs(c @ c.T) - bits * np.eye(n)))


@dataclass(frozen=True)
class OutputCode:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, text: str) -> np.ndarray:
        """What each bit's classifier says of a whole text; positive: the bit is set."""
        total, n = np.zeros(self.code.shape[1]), 0
        for grams in ngrams(text):
            total += self.weights[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total / max(n, 1) * min(n, 400) ** 0.5

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return (self.trust * np.logaddexp(0, -self.code * margins)).sum(axis=1)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of a text."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        loss = self.losses(self.margins(text))
        likely = np.exp(-4 * (loss - loss.min()))
        best, order = int(loss.argmin()), np.sort(loss)
        close = len(order) > 1 and order[1] - order[0] < CLOSE * order[1]
        return self.languages[best], float(likely[best] / likely.sum()), bool(close)


def _sample(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """(lang, text) of about ``rows_per_language`` training documents of each language, dealt over 8 tasks."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").count().collect()  # a row for each language
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], rows_per_language / r["count"]) for r in sizes], F.lit(0.0))
    return usable.filter(place < share).select("lang", "text").repartition(8)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> OutputCode:
    """Learns from rows that aren't held out and have a lang; counts and losses are gathered by Spark.

    What reaches the driver is a row for each language and n-gram bucket, and one for each language and bit.
    """
    sample = _sample(docs, rows_per_language).cache()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, dtype=np.int64))
        for part in batches:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                for grams in ngrams(text):
                    held[lang] += np.bincount(grams, minlength=1 << BUCKET_BITS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counts = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        sample.unpersist()
        return OutputCode([], np.zeros((0, 1)), np.zeros((1 << BUCKET_BITS, 1)), np.zeros((0, 1)))
    code = codewords(len(languages))
    share = np.zeros((len(languages), 1 << BUCKET_BITS))
    share[counts["lang"].map({x: i for i, x in enumerate(languages)}), counts["bucket"]] = counts["n"]
    share = (share + 0.02) / (share + 0.02).sum(axis=1, keepdims=True)
    on = code > 0
    weights = np.zeros((1 << BUCKET_BITS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):  # naive Bayes: log of the mean share in languages with the bit over that without
        if on[:, bit].any() and not on[:, bit].all():
            weights[:, bit] = np.log(share[on[:, bit]].mean(axis=0)) - np.log(share[~on[:, bit]].mean(axis=0))
    first = OutputCode(languages, code, weights, np.ones(code.shape))

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                if lang in first.languages and has_letter(text):
                    hits = first.margins(text) * code[first.languages.index(lang)] > 0
                    yield pd.DataFrame({"lang": lang, "bit": np.arange(code.shape[1]), "hit": hits.astype(float)})

    hits = sample.mapInPandas(right, "lang string, bit int, hit double").groupBy("lang", "bit").agg(F.avg("hit").alias("hit")).toPandas()
    sample.unpersist()
    trust = np.full(code.shape, 0.5)
    for lang, bit, hit in hits.itertuples(index=False):
        trust[languages.index(lang), bit] = max(hit, 0.01)
    return OutputCode(languages, code, weights, trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: OutputCode | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, ambiguous.

    lang is read for learning alone. Null texts and texts without a letter get ``und``, score 0 and
    ambiguous; so does every row when no row has a lang to learn from. Of languages with the same loss the first
    by name wins, as ambiguous. Repeated rows are each told, texts of any length are read whole, in blocks, and an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    @F.pandas_udf(schema)
    def decoded(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decode(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), decoded("text").alias("d")).select("doc_id", "held_out", "d.*")
