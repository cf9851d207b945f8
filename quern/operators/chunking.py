"""Splitting of texts into chunks, and clustering of chunk vectors. Each splitter is a small helper over one text; Spark deals the texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import cosine


#: Characters of chunks that are handed on at once.
TOGETHER = 1 << 20


def tokens(text: str) -> int:
    """The estimate of functions.text.token_estimate for one text."""
    bare = text.strip()
    if not bare:
        return 0
    sample = bare[:4000]
    dense = len(re.sub(r"[A-Za-z0-9 \t\n\r]", "", sample)) / len(sample) > 0.15
    return max(ceil(len(bare) / (3 if dense else 4)), -(-len(bare.split()) * 13 // 10))


def by_size(text: str, size: int = 1000, overlap: int = 150) -> list[str]:
    """Chunks of about ``size`` characters that end at a line or sentence past 60 % of it and overlap; those of 20 characters or less go."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            line, sentence = text.rfind("\n", 0, end + 1), text.rfind(". ", 0, end + 1)
            at = max(line, sentence)
            if at > start + 0.6 * size:
                end = at + (1 if line >= sentence else 2)
        if len(text[start:end].strip()) > 20:
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def by_lines(text: str, most: int = 50, budget: int = 500) -> list[str]:
    """Whole lines, at most ``most`` and about ``budget`` tokens in a chunk."""
    out, held, used = [], [], 0
    for line in text.split("\n") if text else []:
        cost = tokens(line)
        if held and (used + cost > budget or len(held) >= most):
            out.append("\n".join(held))
            held, used = [], 0
        held.append(line)
        used += cost
    return [*out, "\n".join(held)] if held else out


def _parts(text: str, budget: int, separators: tuple[str, ...]) -> Iterator[str]:
    if tokens(text) <= budget:
        yield text
    elif separators:
        pieces = text.split(separators[0])
        for k, piece in enumerate(pieces):
            whole = piece + (separators[0] if k < len(pieces) - 1 else "")
            if whole:
                yield from _parts(whole, budget, separators[1:])
    else:
        for at in range(0, len(text), 3 * budget):
            yield text[at : at + 3 * budget]


def by_separators(text: str, budget: int = 500, overlap: int = 50) -> list[str]:
    """Parts at paragraphs, else lines, sentences, words, else characters, packed up to a budget; each chunk opens with the end of the one before."""
    out, held, used = [], "", 0
    for part in _parts(text, budget, ("\n\n", "\n", ". ", " ")):
        cost = tokens(part)
        if held and used + cost > budget:
            out.append(held.strip())
            tail = out[-1][-4 * overlap :] if overlap else ""
            held = tail[tail.find(" ") + 1 :] + " " if " " in tail else tail
            used = tokens(held)
        held += part
        used += cost
    return [x for x in [*out, held.strip()] if x]


def by_sentences(text: str, budget: int = 500) -> list[str]:
    """Whole sentences packed up to a budget."""
    out, held, used = [], [], 0
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        cost = tokens(sentence)
        if held and used + cost > budget:
            out.append(" ".join(held))
            held, used = [], 0
        held.append(sentence)
        used += cost
    return [x for x in [*out, " ".join(held)] if x]


def by_words(text: str, size: int = 200, step: int = 150) -> list[str]:
    """Windows of ``size`` words every ``step`` words; the last window ends with the text."""
    words = text.split()
    starts = range(0, max(1, len(words) - size + step), max(1, step))
    return [" ".join(words[s : s + size]) for s in starts if words[s : s + size]]


SPLITTERS: dict[str, Callable[..., list[str]]] = {
    "parent_child": by_size, "line": by_lines, "code": by_lines, "log": by_lines, "recursive": by_separators, "text": by_separators, "semantic": by_sentences, "sliding": by_words,
}


def chunk(docs: DataFrame, strategy: str = "recursive", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, chunk_index, chunk) of every whole text; an unknown strategy is an error, null and empty texts have no chunk."""
    split = SPLITTERS[strategy]

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, chunks, held = [], [], [], 0
            for row, text in enumerate(batch.column(1)):
                own = split(text.as_py(), **options) if len(text.as_buffer()) else []
                at += [row] * len(own)
                places += range(len(own))
                chunks += own
                held += sum(map(len, own))
                if held > TOGETHER or row == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], ["k", "chunk_index", "chunk"])
                    at, places, chunks, held = [], [], [], 0

    return docs.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(run, f"k {kind}, chunk_index int, chunk string").withColumnRenamed("k", key)


def hard_split(text: Column, n: int) -> Column:
    """A text in ``n`` parts of equal length (the last may be shorter)."""
    size = F.ceil(F.length(text) / n).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(text, k.cast("int") * size + 1, size)), lambda p: F.length(p) > 0)


def assign(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """``vectors`` (embedding) with the cluster of the highest cosine (to 6 places), the first among ties; the centroids are few and stand in the plan."""
    scores = F.array(*[F.struct(F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in c])), 6).alias("s"), F.lit(-k).alias("k")) for k, c in enumerate(centroids)])
    return vectors.withColumn("_b", F.array_max(scores)).withColumn("cluster", -F.col("_b.k")).withColumn("similarity", F.col("_b.s")).drop("_b")


def kmeans(x: np.ndarray, k: int, most: int = 25, seed: int = 42) -> np.ndarray:
    """Clusters by cosine: seeded k-means++ starts, at most ``most`` rounds, numbered from 0 without gaps."""
    n = len(x)
    if k <= 1:
        return np.zeros(n, dtype=int)
    if k >= n:
        return np.arange(n)
    state = seed

    def draw() -> float:
        nonlocal state
        state = (state * 1664525 + 1013904223) % 2**32  # fixed values of a common generator
        return state / 2**32

    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    chosen = [int(draw() * n)]
    close = unit @ unit[chosen[0]]  # cosine to the closest start so far
    while len(chosen) < k:
        far = np.maximum(0, 1 - close)
        if far.sum() <= 1e-12:
            chosen.append(int(draw() * n))
        else:
            chosen.append(int(min(np.searchsorted(np.cumsum(far), draw() * far.sum(), side="right"), n - 1)))
        close = np.maximum(close, unit @ unit[chosen[-1]])
    centre, found = x[chosen].astype(float), np.full(n, -1)
    for _ in range(most):
        length = np.maximum(np.linalg.norm(centre, axis=1), 1e-12)
        after = (unit @ (centre / length[:, None]).T).argmax(axis=1)
        if (after == found).all():
            break
        found = after
        for j in range(k):
            if (found == j).any():
                centre[j] = x[found == j].mean(axis=0)
    return np.unique(found, return_inverse=True)[1]


def summary_tree(chunks: DataFrame, group: str, levels: int = 2, least: int = 8, fan: int = 5, most: int = 2048, folder: str | None = None) -> DataFrame:
    """(group, level, node, n, centroid): each group's chunks (group, id, embedding) clustered in ceil(n / fan) nodes, the nodes clustered again.

    A group of up to ``most`` chunks is clustered by one task; larger ones are cut into cells first, see ``operators.cells``, whose
    levels are written below ``folder`` where one is given, so that a run which is started again goes on after its last whole level.
    Groups under ``least`` chunks have no tree; rows without group or vector are left out.
    """
    from quern.operators.cells import large_tree, split_by

    rows = chunks.select(group, "id", "embedding").filter(F.col(group).isNotNull() & F.col("embedding").isNotNull())

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, n, found_rows = np.array(part["embedding"].tolist(), dtype=float), np.ones(len(part)), []
        for level in range(1, levels + 1):
            if len(x) < (least if level == 1 else 2):
                break
            found = kmeans(x, ceil(len(x) / fan))
            n = np.bincount(found, weights=n)
            x = np.stack([x[found == j].mean(axis=0) for j in range(found.max() + 1)])
            found_rows += [(part[group].iloc[0], level, j, int(n[j]), x[j].tolist()) for j in range(len(x))]
        return pd.DataFrame(found_rows, columns=[group, "level", "node", "n", "centroid"])

    kind = chunks.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, level int, node int, n long, centroid array<double>"
    large, small = split_by(rows, rows.groupBy(group).count().filter(F.col("count") > most), [group])
    trees = small.groupBy(group).applyInPandas(build, schema)
    return trees if large is None else trees.unionByName(large_tree(large, group, levels, least, fan, most, folder))


def build_graph(found: DataFrame, kinds: list[str], most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of extracted (chunk, source, source_kind, target, target_kind, relation) rows.

    Names are normalised, unknown kinds are other, relations to oneself go, each chunk gives at most ``most``.
    """
    from pyspark.sql import Window

    from quern.functions.text import normalize_name

    kind = lambda c: F.when(F.lower(c).isin(kinds), F.lower(c)).otherwise("other")
    rows = found.select("chunk", normalize_name(F.col("source")).alias("source"), kind("source_kind").alias("source_kind"), normalize_name(F.col("target")).alias("target"), kind("target_kind").alias("target_kind"), "relation")
    rows = rows.filter("source != target and source != '' and target != ''").distinct()
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("chunk").orderBy("source", "target", "relation"))).filter(F.col("_r") <= most)
    sides = rows.select(F.col("source").alias("name"), F.col("source_kind").alias("kind"), "chunk").union(rows.select("target", "target_kind", "chunk"))
    entities = sides.groupBy("name").agg(F.min("kind").alias("kind"), F.countDistinct("chunk").alias("mentions"))
    return entities, rows.groupBy("source", "target", "relation").agg(F.count("*").alias("weight"))
