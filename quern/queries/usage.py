"""Queries of usage analytics; events stand for recorded chat turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import usage as op
from quern.queries.conversation import BARE, ESTIMATE
from quern.queries.registry import query
from quern.sources.tables import table

USAGE = """WITH u AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, event_type AS model, round(value)::BIGINT AS tokens, ts AS created_at,
event_type = 'view' AS cache_hit, value AS response_ms, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'question ' || (event_id % 37) END AS query FROM events) """


def _usage(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), F.col("event_type").alias("model"), F.round("value").cast("bigint").alias("tokens"),
        F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "view").alias("cache_hit"), F.col("value").alias("response_ms"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("question "), (F.col("event_id") % 37).cast("string"))).alias("query"),
    )


@query(USAGE + "SELECT model, count(*) AS queries FROM u WHERE model IS NOT NULL GROUP BY model")
def model_counts(spark, d):
    return op.model_counts(_usage(spark, d))


@query(USAGE + """SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS queries, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE user_id IS NULL) AS anonymous
FROM u WHERE created_at > (SELECT max(created_at) FROM u) - INTERVAL 7 DAY GROUP BY day""")
def daily_usage_v1(spark, d):
    return op.daily_last(_usage(spark, d))


@query(USAGE + """SELECT * FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS queries, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM u GROUP BY day
ORDER BY day DESC LIMIT 30) ORDER BY day""")
def daily_usage_v2(spark, d):
    return op.daily_buckets(_usage(spark, d))


@query(USAGE + "SELECT query, count(*) AS n FROM u WHERE query IS NOT NULL AND query != '' GROUP BY query ORDER BY n DESC, query LIMIT 10")
def top_queries(spark, d):
    return op.top_queries(_usage(spark, d))


@query(USAGE + """SELECT count(*) AS queries, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(*) FILTER (WHERE cache_hit) AS cache_hits,
round(100.0 * count(*) FILTER (WHERE cache_hit) / count(*), 1)::DOUBLE AS hit_rate, count(DISTINCT user_id) AS users, round(avg(response_ms), 2) AS avg_ms,
round(100.0 * count(*) FILTER (WHERE response_ms > 1000) / count(*), 1)::DOUBLE AS slow_rate FROM u""")
def usage_summary(spark, d):
    return op.summary(_usage(spark, d))


@query(USAGE + "SELECT '{' || string_agg('\"' || model || '\":' || n, ',' ORDER BY model) || '}' AS counts FROM (SELECT model, count(*) AS n FROM u WHERE model IS NOT NULL GROUP BY model)")
def model_counts_object(spark, d):
    return op.counts_object(_usage(spark, d), "model")


@query("""WITH c AS (SELECT DISTINCT source AS collection FROM documents UNION ALL SELECT 'empty'),
s AS (SELECT source AS collection, count(*) AS documents, sum(ceil(n_chars / 1000.0))::BIGINT AS chunks, sum(n_chars)::BIGINT AS bytes, count(l.doc_id) AS indexed
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source)
SELECT collection, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(bytes, 0) AS bytes, coalesce(indexed, 0) AS indexed FROM c LEFT JOIN s USING (collection)""")
def collection_stats(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct().withColumn("status", F.lit("indexed"))
    shaped = docs.select("doc_id", F.col("source").alias("collection"), F.ceil(F.col("n_chars") / 1000).cast("bigint").alias("chunks"), F.col("n_chars").alias("bytes"))
    names = docs.select(F.col("source").alias("collection")).distinct().union(spark.createDataFrame([("empty",)], "collection string"))
    return op.collection_stats(names, shaped.join(labels, "doc_id", "left"))


@query("""SELECT c_custkey AS id, c_name AS query, count(o_orderkey) AS hits, c_mktsegment AS model, strftime(max(o_orderdate), '%Y-%m-%d') AS last_hit FROM customer JOIN orders ON c_custkey = o_custkey
GROUP BY ALL ORDER BY hits DESC, id LIMIT 20""")
def top_cached_v1(spark, d):
    hits = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("hits"), F.max("o_orderdate").alias("at"))
    cache = table(spark, d, "customer").join(hits, "c_custkey")
    return op.top_cached(cache.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("query"), "hits", F.col("c_mktsegment").alias("model"), F.date_format("at", "yyyy-MM-dd").alias("last_hit")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 75")
def offset_page(spark, d):
    return op.page(table(spark, d, "documents").select("doc_id", "n_chars"), 75, 50, F.desc("n_chars"), "doc_id")


@query(f"""SELECT conv_id, turn, CASE WHEN reported > 0 THEN reported ELSE 20 + ({ESTIMATE}) END + turn + 7 AS billable FROM (SELECT conv_id, turn, {BARE} AS b, CASE WHEN turn % 2 = 0 THEN turn * 10 END AS reported FROM conversations)""")
def billable(spark, d):
    talk = table(spark, d, "conversations")
    reported = F.when(F.col("turn") % 2 == 0, F.col("turn") * 10)
    return talk.select("conv_id", "turn", op.billable_tokens(reported, F.lit(20), F.col("text"), F.col("turn"), F.lit(None).cast("bigint"), F.lit(7)).alias("billable"))
