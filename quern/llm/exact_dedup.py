"""Exact duplicate removal over an extendible-hash index kept on shared files.

Texts are equal when they are identical after lower-casing A-Z. The 64-bit hash of the normalised text is the index key;
its leading bits name a cell of the directory, and a cell names the bucket that holds its keys. The directory doubles
while a cell has more than ``capacity`` keys, and a bucket is the shortest prefix with no more than that. Every row is
routed by the directory to its bucket, copies being folded on the way; a bucket's owner task, one to a range of buckets,
chains the different texts of a key after comparing their bytes, and writes them. Rows then find their
entry by directory, bucket and key.

Everything here is DataFrame code, so it runs inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _cell(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


#: Bits of the directory at most: its table, which is broadcast, has a row of 24 bytes for each of at most so many cells.
DEEPEST = 20


def directory(keys: DataFrame, capacity: int, depth: int = 8, step: int = 2) -> tuple[DataFrame, int]:
    """(directory, global depth) for distinct ``keys`` (column key).

    The directory has a row for each occupied cell of the global depth: cell, local_depth, bucket (the first key of the
    bucket's range). While a cell of the global depth is overfull the directory is doubled ``step`` times, up to ``DEEPEST``
    bits; buckets may then hold more.
    """
    while True:
        cells = keys.groupBy(_cell(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"))
        if depth >= DEEPEST or (cells.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth = min(depth + step, DEEPEST)
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - local_depth)"))
    full = levels.groupBy("local_depth", "prefix").agg(F.sum("n").alias("held"))
    fits = (F.col("held") <= capacity) | (F.col("local_depth") == depth)
    chosen = levels.join(full.filter(fits), ["local_depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("local_depth", "prefix")).alias("b"))
    start = F.when(F.col("b.local_depth") == 0, F.lit(0)).otherwise(F.expr("shiftleft(b.prefix, 64 - b.local_depth)")).cast("bigint")
    return chosen.select("cell", F.col("b.local_depth").alias("local_depth"), start.alias("bucket")), depth


@dataclass
class ExactIndex:
    """rows: (doc_id, key, text_sha256) of each input row; cells: the directory, of ``depth`` bits; chains: the index files."""

    rows: DataFrame
    cells: DataFrame
    chains: DataFrame
    depth: int


def _routed(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """``rows`` (with key) and the bucket that the directory names for the key's cell."""
    return rows.withColumn("cell", _cell(F.col("key"), depth)).join(F.broadcast(cells.select("cell", "bucket")), "cell").drop("cell")


def build_index(docs: DataFrame, capacity: int = 65_536, scratch: Scratch | None = None) -> ExactIndex:
    """Indexes every row of ``docs`` (doc_id, text; other columns are ignored).

    Index row: bucket, key, chain (1, 2, ... when different texts share a key, by text), chain_length, keep_id
    (largest doc_id), group_size, text_sha256. Owner tasks write ranges of buckets, sorted.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    normal = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    rows = scratch.keep(normal.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "rows")
    cells, depth = directory(rows.select("key").distinct(), capacity)
    cells = scratch.keep(cells, "directory")
    # equal bytes in a bucket are one entry; tasks fold their copies before they are sent
    texts = _routed(normal, cells, depth).groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = scratch.keep(texts.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    chain = Window.partitionBy("bucket", "key")
    owned = entries.repartitionByRange("bucket", "key").withColumn("chain", F.row_number().over(chain.orderBy("text_sha256")))
    index = owned.withColumn("chain_length", F.count("*").over(chain)).sortWithinPartitions("bucket", "key", "chain")
    return ExactIndex(rows, cells, scratch.keep(index, "index"), depth)


#: A text that holds this part of all rows or more is hot; there are at most so many of them.
HOT_PARTS = 1024


def lookup(index: ExactIndex) -> DataFrame:
    """One row per input row that the directory leads to its entry: doc_id, keep_id, group_size, kept, text_sha256.

    A key with one entry is decided by the key, since its owner has compared the bytes of all its texts; only within
    a longer chain does the digest of the text choose the entry. Entries of hot texts, at most ``HOT_PARTS`` rows, are sent to
    the rows, so that no key of the shuffled join has more than that part of the rows.
    """
    entry = index.chains.select("bucket", "key", "chain_length", "keep_id", "group_size", F.col("text_sha256").alias("entry_sha"))
    rows = _routed(index.rows, index.cells, index.depth)
    hot = F.broadcast(entry.filter(F.col("group_size") * HOT_PARTS >= index.rows.count()).drop("chain_length").withColumnRenamed("entry_sha", "text_sha256"))
    own = ["bucket", "key", "text_sha256"]
    rest = rows.join(hot, own, "left_anti").join(entry, ["bucket", "key"]).filter((F.col("chain_length") == 1) | (F.col("text_sha256") == F.col("entry_sha")))
    found = rows.join(hot, own).unionByName(rest.drop("chain_length", "entry_sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, capacity: int = 65_536) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null text counts as empty, so empty and null
    texts are one group. A null doc_id counts as smaller than any other. Rows that repeat both doc_id
    and text are counted in group_size and share one decision. An empty table gives no rows. Very long texts are read whole.
    """
    return lookup(build_index(docs, capacity))


def drop_exact_duplicates(docs: DataFrame, capacity: int = 65_536) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stay, one of each text, with all their columns.

    The row with the largest doc_id stays; null text counts as empty. Where rows repeat both doc_id and text one of them
    stays, whichever comes first. An empty table stays empty.
    """
    # one text has one digest, and a doc_id that its text keeps: the three columns name the row
    none, known, sha, place = unused(docs, "no_id", "known_id", "sha", "place")
    kept = exact_duplicates(docs, capacity).filter("kept").select(
        F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias(known), F.col("text_sha256").alias(sha)
    )
    named = docs.withColumn(none, F.col("doc_id").isNull()).withColumn(known, F.coalesce("doc_id", F.lit(0)).cast("bigint"))
    named = named.withColumn(sha, F.sha2(ascii_lower(F.col("text")), 256)).join(kept.distinct(), [none, known, sha], "left_semi")
    first = Window.partitionBy(none, known, sha).orderBy(none, known, sha)
    return named.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)
