"""Mixing of sources to target weights by weighted fair queueing, in DataFrame code only.

Each source is a queue of its documents in a shuffled order, followed by the same order again up to
``max_repeats`` passes. A copy's virtual finish time is the words its source has sent up to and
including it, divided by the source's target. The copies of all sources are served in the order of
that time and the mix ends when the next copy would pass the total budget.

``mix`` sorts the copies globally by range and is cut at the last copy within the budget; that copy is found first, by a
histogram of finish times, since a running sum over the sorted copies would be one task. So what the cut takes is what the
sorted mix, truncated, holds, and a document's copies can be told without sorting texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, unused

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Cells of a level of the search for the cut, and the rows below which it is made exactly.
CELLS, EXACT_ROWS = 4096, 5_000
#: Ranges of the shuffle key by source, and the rows that a range should hold.
MAX_RANGES, RANGE_ROWS = 1 << 16, 256


def words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of seed and doc_id, the same in every engine and run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, share: float, max_repeats: int, weights=WEIGHTS) -> DataFrame:
    """sources(source, source_size) with target: ``share`` of all words dealt by weight.

    Weights repeat over the sources by code point, null last. A target stops at ``max_repeats`` times its
    source's size and the excess goes to the others by weight until none is above. The table has a row
    for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
    # sources fill up in the order of their room; the first that does not fixes the level for all after it
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    table = table.withColumn("level", level)
    table = table.withColumn("place", F.row_number().over(by_room))
    stays = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(stays, F.struct("place", "level"))).over(everything)["level"]
    return table.withColumn("target", F.least("cap", F.coalesce(first * F.col("weight"), F.col("cap")))).select(
        "source", "source_size", "target", "budget"
    )


def _served(docs: DataFrame, share: float, max_repeats: int, seed: int, scratch: Scratch) -> DataFrame:
    """doc_id, source, size, key, source_size, target, budget, through: words of its source up to it in a pass."""
    sized = scratch.keep(docs.select("doc_id", "source", words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    largest = sources.agg(F.max("n")).first()[0] or 0
    bits = min(MAX_RANGES, max(1, largest // RANGE_ROWS)).bit_length()
    sized = sized.withColumn("range", F.shiftright("key", 60 - bits))
    targets = source_targets(sources.select("source", "source_size"), share, max_repeats).withColumnRenamed("source", "s")
    # a source's running sum is the sum of the ranges before plus the running sum inside the range
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("earlier"))
    ranges = ranges.join(targets, ranges["s"].eqNullSafe(targets["s"])).drop(targets["s"])
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    local = sized.withColumn("local", F.sum("size").over(inside))
    joined = local.join(ranges, local["source"].eqNullSafe(ranges["s"]) & (local["range"] == ranges["r"]))
    return joined.select("doc_id", "source", "size", "key", "source_size", "target", "budget", (F.col("earlier") + F.col("local")).alias("through"))


def _cut(copies: DataFrame, budget: float) -> tuple[float, int, int] | None:
    """The last (finish, key, pass) served within ``budget``; None when every copy is.

    A histogram of finish times is refined around the cut until few rows are left; each step brings
    one row to the driver.
    """
    low, high = 0.0, copies.agg(F.max("finish")).first()[0]
    if high is None:
        return None
    spent, high = 0.0, high * (1 + 1e-12) + 1e-300
    while True:
        inside = copies.filter((F.col("finish") >= low) & (F.col("finish") < high))
        width = (high - low) / CELLS
        cells = inside.groupBy(F.least(F.floor((F.col("finish") - low) / width), F.lit(CELLS - 1)).alias("cell")).agg(
            F.sum("size").alias("held"), F.count("*").alias("n"), F.min("finish").alias("first"), F.max("finish").alias("last")
        )
        total = F.sum("held").over(Window.orderBy("cell"))
        over = cells.withColumn("total", total).filter(F.col("total") + spent > budget).orderBy("cell").first()
        if over is None:
            return None
        spent, last = spent + over["total"] - over["held"], (low, high)
        low, high = over["first"], over["last"] * (1 + 1e-15) + 1e-300
        if over["n"] <= EXACT_ROWS or over["first"] == over["last"] or (low, high) == last:
            break
    edge = copies.filter((F.col("finish") >= low) & (F.col("finish") < high))
    order = Window.orderBy("finish", "key", "pass", "doc_id", "size")
    first_out = edge.withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("total") + spent > budget)
    row = first_out.orderBy("finish", "key", "pass").first()
    return (row["finish"], row["key"], row["pass"]) if row else None


def _passes(served: DataFrame, max_repeats: int) -> DataFrame:
    """A row for each copy: ``served`` with pass and finish; without a target (no words) it is served at once."""
    finish = (F.col("through") + F.col("pass") * F.col("source_size")) / F.col("target")
    copies = served.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    return copies.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(0.0))


def plan(docs: DataFrame, share: float, max_repeats: int, seed: int, scratch: Scratch) -> tuple[DataFrame, tuple | None]:
    """(narrow rows of all documents, the last copy that is not served any more or None)."""
    served = scratch.keep(_served(docs, share, max_repeats, seed, scratch), "served")
    budget = served.agg(F.max("budget")).first()[0]
    # copies without words take nothing; of the others only those of different sources can share a finish time
    return served, _cut(_passes(served, max_repeats).filter("size > 0"), budget or 0.0)


def _in_mix(finish: Column, key: Column, number: Column, cut: tuple | None) -> Column:
    if cut is None:
        return F.lit(True)
    first_out = F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).cast("bigint").alias("k"), F.lit(cut[2]).cast("int").alias("p"))
    return F.struct(finish.alias("f"), key.alias("k"), number.cast("int").alias("p")) < first_out


def mix(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """The mix in the order in which it is served: doc_id, source, size, pass, finish; a document may come ``max_repeats`` times.

    ``docs`` needs doc_id, source and text; other columns are ignored. Null sources are one source, ordered
    last. Null and empty texts have no words and take nothing. Rows that repeat a doc_id are separate rows.
    An empty table gives no rows. Reruns give the same mix.
    """
    served, cut = plan(docs, share, max_repeats, seed, scratch or Scratch(docs.sparkSession, "mix"))
    copies = _passes(served, max_repeats).filter((F.col("size") > 0) & _in_mix(F.col("finish"), F.col("key"), F.col("pass"), cut))
    ordered = copies.repartitionByRange("finish", "key", "pass").sortWithinPartitions("finish", "key", "pass")
    return ordered.select("doc_id", "source", "size", "pass", "finish")


def mix_words(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies (in the mix), taken (their words).

    The same mix as that of ``mix``, told by document.
    """
    served, cut = plan(docs, share, max_repeats, seed, scratch or Scratch(docs.sparkSession, "mix"))
    copies = F.lit(0)
    for number in range(max_repeats):
        finish = (F.col("through") + number * F.col("source_size")) / F.col("target")
        copies = copies + F.when(_in_mix(finish, F.col("key"), F.lit(number), cut), 1).otherwise(0)
    told = served.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return told.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others) with all their columns, each as often as the mix takes it.

    Null and empty texts have no words and go. Rows that repeat doc_id, source and number of words are told apart by their
    text and then arbitrarily. An empty table stays empty.
    """
    key, place, copies, number = unused(docs, "mix_key", "mix_place", "mix_copies", "mix_pass")
    of = lambda size: F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), size.alias("n"))
    # a key without nulls, so that both sides are dealt and sorted by it once
    named = lambda df, size: df.withColumn(key, F.to_json(of(size)))
    numbered = lambda df, *order: df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    decided = mix_words(docs, **options).select("doc_id", "source", "size", F.col("copies").alias(copies))
    decided = numbered(named(decided, F.col("size")), F.desc(copies)).filter(F.col(copies) > 0).select(key, place, copies)
    rows = numbered(named(docs, words(F.col("text"))), "doc_id", "text").join(decided, [key, place])
    return rows.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
