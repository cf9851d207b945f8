"""Codes of vectors: each of 4 parts is told by the nearest of up to 256 codebook entries, in exact integer arithmetic.

Components are whole numbers. To find the nearest entry of a part one float32 matrix product scores all entries of the
codebook; each score is within a bound of its true value that follows from the rounding of float32, whatever the order of the
additions. Only entries whose interval overlaps that of the best are compared again in int64, and equal distances go to the
smaller index. Codebooks are bounded (4 x 256 entries) and go to all tasks; a round's sums come back by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, unused

#: Parts of a vector, entries of a codebook, rounds, whole numbers a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest whole number of a component; distances of up to 512 components then fit int64.
LARGEST = 1 << 26
#: Rows that are scored together.
BLOCK = 1024


def whole_numbers(vectors: DataFrame, scale: int, largest: int, *more: str) -> DataFrame:
    """(vec_id, ``more``, ints): floor(``scale`` * component) of the rows whose vector is there with every component finite.

    Numbers beyond ``largest`` count as it, on either side.
    """
    (name,) = unused(vectors, "ints")
    held = vectors.select("vec_id", *more, F.col("embedding").cast("array<double>").alias(name))
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    near = lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-float(largest))), F.lit(float(largest)))).cast("int")
    return held.filter(F.coalesce(finite, F.lit(False))).select("vec_id", *more, F.transform(name, near).alias("ints"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all ``width`` long, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def candidates(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries), in order, of every entry that may be the nearest to a row of ``x``, by float32 products.

    The nearest entry has the largest x.c - c.c/2. A float32 dot product of n terms, its inputs rounded to float32 first, is off by
    at most g*|x|*|c| with g = (n + 2)u / (1 - (n + 2)u) and u = 2**-24; the rest is done in double precision, whose own rounding is
    covered by the second term.
    """
    unit = (x.shape[1] + 2) * 2.0**-24
    norm = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))
    half = (book * book).sum(axis=1) / 2.0
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    off = 1.001 * unit / (1 - unit) * norm(x)[:, None] * norm(book)[None, :] + 2.0**-48 * (np.abs(product) + half[None, :])
    score = product - half[None, :]
    return np.nonzero(score + off >= (score - off).max(axis=1)[:, None])


def nearest_entry(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest to each row of ``x``, the smaller index of equal ones."""
    index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), BLOCK):
        piece = x[at : at + BLOCK]
        row, entry = candidates(piece, book)
        apart = ((piece[row] - book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(apart, np.searchsorted(row, np.arange(len(piece))))
        best = np.flatnonzero(apart == least[row])
        first = best[np.unique(row[best], return_index=True)[1]]
        index[at : at + BLOCK], distance[at : at + BLOCK] = entry[first], least
    return index, distance


def _parts(ints: np.ndarray) -> np.ndarray:
    """rows x PARTS x components of a part; zeros are put after vectors that don't divide."""
    more = -ints.shape[1] % PARTS
    padded = np.pad(ints, ((0, 0), (0, more)))
    return padded.reshape(len(ints), PARTS, padded.shape[1] // PARTS)


def _round_sums(rows: DataFrame, books: np.ndarray, width: int) -> list:
    """(part, entry, count, sum of each component) of the parts assigned to each entry; a task adds up its own rows first."""
    long = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            held = _parts(matrix(batch.column("ints"), width))
            for p in range(PARTS):
                index, _ = nearest_entry(held[:, p], books[p])
                np.add.at(total[p], index, held[:, p])
                count[p] += np.bincount(index, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": count[part, entry], **{f"s{i}": total[part, entry, i] for i in range(long)}})

    schema = "part long, entry long, n long" + "".join(f", s{i} long" for i in range(long))
    told = rows.select("ints").mapInArrow(assign, schema)
    # sums of sums: decimals can't overflow
    return told.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in told.columns[2:]]).collect()


def train(rows: DataFrame, width: int) -> np.ndarray:
    """The codebooks, PARTS x entries x components, after ``ROUNDS`` rounds over all ``rows`` (vec_id, ints of ``width`` components)."""
    first = rows.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).collect()
    books = _parts(np.array([r["ints"] for r in first], dtype=np.int64).reshape(len(first), width)).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for part, entry, n, *sums in _round_sums(rows, books, width):
            books[part, entry] = [int(s) // int(n) for s in sums]
    return books


def encode(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error) of every row: two hex digits for each part, and the squared distances to the entries."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _parts(matrix(batch.column("ints"), width))
            told = [nearest_entry(held[:, p], books[p]) for p in range(PARTS)]
            codes = np.stack([index for index, _ in told], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in told)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return rows.select("vec_id", "label", "ints").mapInArrow(assign, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The whole numbers that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(PARTS)])


def compress(vectors: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label; others are not read) that takes part: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component don't take part. label_error adds up error over the rows
    of a label, null being one. Repeated rows count as often as they are there; equal vec_ids, and null ones, which come last, are ordered by their
    vectors. Components beyond 65,536 count as that. Vectors of another length have codebooks of their own, so the lengths
    should be few; a length that 4 doesn't divide is filled up with zeros. With under 256 rows a codebook has as many entries. An
    empty table gives no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "codes")
    held = scratch.keep(whole_numbers(vectors, SCALE, LARGEST, "label"), "ints")
    told = None
    for width in sorted(r[0] for r in held.select(F.size("ints")).distinct().collect()):
        rows = held.filter(F.size("ints") == width)
        books = train(rows, width)
        coded = encode(rows, books, width).withColumn("codebooks_sha256", F.lit(digest(books)))
        told = coded if told is None else told.unionByName(coded)
    if told is None:
        told = held.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    told = scratch.keep(told, "coded")
    sums = told.groupBy("label").agg(F.sum("error").alias("label_error"))
    known = lambda df: df.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit(0)))
    out = known(told).join(known(sums).drop("label"), ["_none", "_label"])
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
