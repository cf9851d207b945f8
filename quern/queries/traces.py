"""Queries over traces; an order is the root step of a trace and its lines are the steps below."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import traces as op
from quern.plans.shares import shares
from quern.queries.registry import query
from quern.sources.tables import table

STEPS = """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
s AS (SELECT o_orderkey AS trace_id, 0::BIGINT AS step_id, NULL::BIGINT AS parent_id, 'order' AS type, 'ok' AS status, 1.0::DOUBLE AS duration, 0::BIGINT AS tokens, 0.0::DOUBLE AS cost FROM (SELECT DISTINCT o_orderkey FROM orders)
UNION ALL SELECT l_orderkey, k, CASE WHEN k <= 2 THEN 0 ELSE k - 2 END, 'line-' || l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END, l_quantity, l_linenumber, l_extendedprice FROM l JOIN (SELECT DISTINCT o_orderkey FROM orders) ON l_orderkey = o_orderkey) """


def _steps(spark, d):
    lines = table(spark, d, "lineitem")
    parts = shares(lines)  # a task sorts one share of the lines, however many there are
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id")).repartition(parts, "trace_id").distinct()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = lines.repartition(parts, "l_orderkey").withColumn("k", F.row_number().over(order).cast("bigint"))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("trace_id"), "left_semi").select(
        F.col("l_orderkey").alias("trace_id"), F.col("k").alias("step_id"), F.when(F.col("k") <= 2, 0).otherwise(F.col("k") - 2).cast("bigint").alias("parent_id"),
        F.concat(F.lit("line-"), "l_returnflag").alias("type"), F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        F.col("l_quantity").alias("duration"), F.col("l_linenumber").cast("bigint").alias("tokens"), F.col("l_extendedprice").alias("cost"),
    )
    roots = orders.selectExpr("trace_id", "0L as step_id", "cast(null as bigint) as parent_id", "'order' as type", "'ok' as status", "1.0D as duration", "0L as tokens", "0.0D as cost")
    return roots.unionByName(lines)


@query(STEPS + """SELECT trace_id, count(*) AS steps, count(*) FILTER (WHERE status = 'error') AS errors, round(100.0 * count(*) FILTER (WHERE status != 'error') / count(*), 2)::DOUBLE AS success_rate, round(sum(duration), 2) AS duration,
sum(tokens)::BIGINT AS tokens, round(sum(cost), 4) AS cost FROM s GROUP BY trace_id""")
def trace_rollup(spark, d):
    return op.rollup(_steps(spark, d))


@query(STEPS + "SELECT type, count(*) AS steps, sum(tokens)::BIGINT AS tokens, round(sum(cost), 2) AS cost, round(avg(duration), 4) AS mean_duration FROM s GROUP BY type")
def cost_breakdown(spark, d):
    return op.cost_by(_steps(spark, d), "type")


@query(STEPS + "SELECT CASE WHEN trace_id % 10 = 0 THEN 'unknown' ELSE 'returned ' || (trace_id % 3) END AS message, count(*) AS n FROM s WHERE status = 'error' GROUP BY message")
def error_summary(spark, d):
    said = F.when(F.col("trace_id") % 10 != 0, F.concat(F.lit("returned "), (F.col("trace_id") % 3).cast("string")))
    return op.error_summary(_steps(spark, d).withColumn("message", said))


@query(STEPS + """SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY duration DESC, step_id) AS rank, step_id, duration, round(100 * duration / sum(duration) OVER (PARTITION BY trace_id), 1) AS share FROM s QUALIFY rank <= 2""")
def trace_bottlenecks(spark, d):
    return op.bottlenecks(_steps(spark, d), 2)


@query(STEPS.replace("WITH l", "WITH RECURSIVE l", 1) + """, c AS (SELECT trace_id, step_id, parent_id, duration AS chain, 1 AS depth FROM s UNION ALL SELECT s.trace_id, s.step_id, s.parent_id, s.duration + c.chain, c.depth + 1 FROM c JOIN s ON s.trace_id = c.trace_id AND s.step_id = c.parent_id),
r AS (SELECT trace_id, max(chain) AS m, max(depth) AS depth FROM c WHERE parent_id IS NULL GROUP BY trace_id) SELECT trace_id, 0::BIGINT AS root, round(m, 2) AS duration, depth FROM r""")
def critical_path(spark, d):
    return op.critical_path(_steps(spark, d))


@query(STEPS + """SELECT trace_id, parent_id, count(*) AS children, round(sum(duration), 2) AS in_turn, max(duration) AS together, round(sum(duration) - max(duration), 2) AS saved FROM s WHERE parent_id = 0 GROUP BY ALL HAVING count(*) > 1""")
def parallel_gain(spark, d):
    return op.parallel_gain(_steps(spark, d))


@query(STEPS.replace("WITH l", "WITH RECURSIVE l", 1) + """, c AS (SELECT trace_id, step_id, 0 AS depth, lpad(step_id::VARCHAR, 12, '0') AS path FROM s WHERE parent_id IS NULL
UNION ALL SELECT s.trace_id, s.step_id, c.depth + 1, c.path || '/' || lpad(s.step_id::VARCHAR, 12, '0') FROM c JOIN s ON s.trace_id = c.trace_id AND s.parent_id = c.step_id) SELECT * FROM c""")
def trace_timeline(spark, d):
    return op.timeline(_steps(spark, d))


@query("SELECT event_id // 10 AS trace_id, event_id AS step_id FROM events WHERE event_id % 10 IN (7, 8, 9)")
def cyclic_steps(spark, d):
    k, e = F.col("event_id") % 10, F.col("event_id")
    parent = F.when(k == 0, None).when(k == 7, e + 2).otherwise(e - 1)
    return op.cyclic_steps(table(spark, d, "events").select(F.floor(e / 10).alias("trace_id"), e.alias("step_id"), parent.alias("parent_id")))


EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT event_id // 20 AS trace_id, event_id AS source, event_id // 20 * 20 + (event_id * 7 + k * (event_id % 5) + user_id) % 20 AS target FROM events, (VALUES (1), (3)) v(k) WHERE event_id % 20 < 12 OR k = 1)"""


@query(EDGES + """, r AS (SELECT trace_id, source, target FROM e UNION SELECT r.trace_id, r.source, e.target FROM r JOIN e ON e.trace_id = r.trace_id AND e.source = r.target),
m AS (SELECT a.trace_id, a.source AS member, min(a.target) AS cycle FROM r a JOIN r b ON a.trace_id = b.trace_id AND a.source = b.target AND a.target = b.source GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY trace_id, cycle) AS size FROM m""")
def step_cycles(spark, d):
    """Steps of twenty events, each with one or two that follow it."""
    e, k = F.col("event_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("k")
    rows = table(spark, d, "events").select("event_id", "user_id", k).filter((e % 20 < 12) | (F.col("k") == 1))
    trace = F.floor(e / 20)
    return op.cycles(rows.select(trace.alias("trace_id"), e.alias("source"), (trace * 20 + (e * 7 + F.col("k") * (e % 5) + F.col("user_id")) % 20).alias("target")))
