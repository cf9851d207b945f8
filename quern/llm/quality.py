"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of surface features of its whole text: counts and shares, no word is a
feature. Preference pairs
(a document labelled 1 over one labelled 0) are drawn from a bounded sample of labelled rows and the
weights minimise the logistic loss of the pairs' feature differences. The cut between the classes is
the quantile of the sample's scores at the share of label 0; the score given out is calibrated so that
this cut lies at ``CUT_SCORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.scratch import unused

#: Bounds of the fit: labelled rows, and preference pairs drawn from them.
SAMPLE_ROWS, PAIRS = 16_000, 40_000
#: The score at the cut: a document is predicted good from here on.
CUT_SCORE = 0.3
FEATURES = 13
_COMMON = np.zeros(256, dtype=bool)
_COMMON[[ord(c) for c in " .,;:'\"()-\n\r\t"]] = True


def text_features(text: str | None) -> list[float]:
    """Surface features of a whole text; null and empty texts have a fixed row of their own."""
    raw = (text or "").encode("utf-8", "replace")
    tokens = raw.split()
    if not tokens:
        return [0.0] * (FEATURES - 1) + [1.0]
    n, k = len(raw), len(tokens)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    marks = count[33:127].sum() - upper - lower - digits
    odd = marks - count[33:127][_COMMON[33:127]].sum()
    distinct = len(set(tokens))
    lines = raw.split(b"\n")
    near = lambda share: float(np.log(share + 0.002))
    long, many = n + 40, k + 8  # a few characters say little of a short text
    return [
        near(odd / long), near(upper / long), near(digits / long), near(marks / long), near(count[124] / many), near(count[46] / many),
        near(sum(map(eq, tokens, tokens[1:])) / many), near(distinct / k), float(np.log(distinct + 1) / np.log(k + 2)),
        (n + 6 * 8) / many / 10, near(1 - len(set(lines)) / len(lines)), float(np.log1p(k)) / 10, 0.0,
    ]


def held_out(doc_id: Column) -> Column:
    """True for the rows that labels are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class BradleyTerry:
    """Weights on standardised features, and the calibration of the raw score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights
        at_cut = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) / self.spread + at_cut, -40, 40)))


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 11) -> BradleyTerry:
    """Newton steps on the logistic loss of (preferred - other) feature differences.

    Without both labels there is no preference: the weights are zero and every score lies above the cut.
    """
    dims = x.shape[1] if x.size else FEATURES
    if not x.size or label.min() == label.max():
        return BradleyTerry(np.zeros(dims), np.ones(dims), np.zeros(dims), -1.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z, draw = (x - mean) / scale, np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    diff = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(dims)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        gradient = diff.T @ p - ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(dims), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = np.sort(z @ w)
    at = min(max(len(bad), 1), len(raw) - 1)
    return BradleyTerry(mean, scale, w, float((raw[at - 1] + raw[at]) / 2), max(1.0, float(raw.std()) / 4))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BradleyTerry:
    """Learns from at most ``sample_rows`` labelled rows that aren't held out, taken in the order of a hash of doc_id.

    Where labels contradict each other the lower one counts; null labels are left out.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # a doc_id that repeats is learned from once, so that the bound holds
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality"))
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"quality": part["quality"], "x": [text_features(t) for t in part["text"]]})

    got = rows.select("quality", "text").mapInPandas(measure, schema).toPandas()
    got["order"] = [tuple(v) for v in got["x"]]
    got = got.sort_values(["order", "quality"])  # the fit is the same however rows arrive
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, FEATURES)
    return fit_pairs(x, got["quality"].to_numpy())


def with_quality(docs: DataFrame, model: BradleyTerry, score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text in column ``score``."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], dtype=float).reshape(-1, FEATURES)
        return pd.Series(model.score(x))

    return docs.withColumn(score, scored("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.3 on).

    Null texts count as empty; empty texts are scored by the model like any other. Other columns of
    ``docs`` are not read. Without usable labels every row is predicted 1. Repeated rows are each told, with one
    score; texts of any length are measured whole; an empty table gives no rows.
    """
    scored = with_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted")
    )


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that are predicted good, with all their columns.

    Null and empty texts are scored by the model like any other; repeated rows share a decision. Without usable
    labels all rows stay. An empty table stays empty.
    """
    (score,) = unused(docs, "score")
    return with_quality(docs, fit(docs, labels), score).filter(F.col(score) >= CUT_SCORE).select(*docs.columns)
