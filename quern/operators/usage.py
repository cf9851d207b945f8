"""Usage analytics: model counts, days, commonest queries, rates, statistics by collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import token_estimate


def model_counts(usage: DataFrame) -> DataFrame:
    """Rows by model, unnamed models left out."""
    return usage.filter("model is not null").groupBy("model").agg(F.count("*").alias("queries"))


def daily_last(usage: DataFrame, days: int = 7) -> DataFrame:
    """By UTC day of the last ``days`` days before the latest row: queries, tokens, anonymous queries."""
    latest = usage.agg(F.max("created_at").alias("latest"))
    recent = usage.crossJoin(F.broadcast(latest)).filter(F.col("created_at") > F.col("latest") - F.expr(f"interval {days} days"))
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("queries"), F.sum("tokens").alias("tokens"), F.count_if(F.col("user_id").isNull()).alias("anonymous")
    )


def daily_buckets(usage: DataFrame, buckets: int = 30) -> DataFrame:
    """The latest ``buckets`` days that have rows, oldest first: queries and tokens."""
    by_day = usage.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("queries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return by_day.orderBy(F.desc("day")).limit(buckets).orderBy("day")


def top_queries(usage: DataFrame, n: int = 10) -> DataFrame:
    """The commonest non-empty queries; ties by text."""
    counted = usage.filter("query is not null and query != ''").groupBy("query").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "query").limit(n)


def summary(usage: DataFrame) -> DataFrame:
    """One row of totals and rates (percent to one place, 0 without rows)."""
    rate = lambda hits: F.round(F.when(F.count("*") > 0, 100.0 * hits / F.count("*")).otherwise(0.0), 1)
    hit = F.count_if("cache_hit")
    return usage.agg(
        F.count("*").alias("queries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), hit.alias("cache_hits"), rate(hit).alias("hit_rate"),
        F.countDistinct("user_id").alias("users"), F.round(F.avg("response_ms"), 2).alias("avg_ms"), rate(F.count_if(F.col("response_ms") > 1000)).alias("slow_rate"),
    )


def collection_stats(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Every collection (collection) with its documents' count, chunks, bytes and indexed count; 0 where it has none."""
    stats = documents.groupBy("collection").agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == "indexed").alias("indexed")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("documents", "chunks", "bytes", "indexed")]
    return collections.join(stats, "collection", "left").select("collection", *zero)


def counts_object(usage: DataFrame, key: str) -> DataFrame:
    """One row with a JSON object of counts by ``key``, keys in order."""
    counted = usage.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("n").alias("v"))))
    return counted.agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def top_cached(cache: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` cached queries (id, query, hits, model, last_hit) that were hit most; ties go to the smaller id."""
    return cache.orderBy(F.desc("hits"), "id").limit(n)


def page(rows: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    """``limit`` rows from place ``offset`` on in an order that leaves no ties."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def billable_tokens(reported: Column, prompt: Column, reply: Column, *added: Column) -> Column:
    """What a call counts for: the tokens that the provider reports, or else those of prompt and reply, and the ``added`` ones; nulls are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = F.when(zero(reported) > 0, reported).otherwise(zero(prompt) + token_estimate(reply))
    return reduce(lambda a, b: a + zero(b), added, own).cast("bigint")
