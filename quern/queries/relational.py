"""Queries of row-level upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import relational as op
from quern.queries.registry import query
from quern.sources.tables import table


@query("""WITH a AS (SELECT user_id, event_id, value, 0 AS new FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_id, value, 1 FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT user_id, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY new DESC, event_id DESC) = 1""")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return op.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 and user_id % 3 = 0"), ["user_id"], "event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark, d):
    return op.pending(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND event_id % 5 < 2")
def retention_sweep(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("hits", F.col("event_id") % 5)
    return op.expired(e, "ts", F.lit("2024-01-31").cast("timestamp"), 20, "hits").select("event_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, event_id % 7 AS hits FROM events) ORDER BY ts DESC, hits DESC, event_id LIMIT 100")
def lru_kept(spark, d):
    return op.keep_most_used(table(spark, d, "events").withColumn("hits", F.col("event_id") % 7), 100, "ts", "hits", "event_id").select("event_id", "user_id")


@query("""SELECT doc_id, last_doc FROM documents d LEFT JOIN (SELECT source, lang, max(doc_id) AS last_doc FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) l ON d.source IS NOT DISTINCT FROM l.source AND d.lang IS NOT DISTINCT FROM l.lang""")
def null_safe_scope(spark, d):
    docs = table(spark, d, "documents")
    other = docs.filter("doc_id % 2 = 0").select("source", "lang", F.col("doc_id").alias("last_doc"))
    return op.latest_match(docs, other, ["source", "lang"], "last_doc", "last_doc").select("doc_id", "last_doc")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_cascade(spark, d):
    gone = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return op.delete_cascade(gone, {"orders": table(spark, d, "orders")}, "o_custkey")["orders"].select("o_orderkey")


@query("""WITH r AS (SELECT DISTINCT o_custkey AS source, o_orderkey % 97 AS target FROM orders) SELECT * FROM r WHERE source IN (SELECT s_suppkey FROM supplier) OR target IN (SELECT s_suppkey FROM supplier)""")
def either_side_join(spark, d):
    rel = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 97).alias("target"))
    return op.either_side(rel, table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")))


@query("""WITH b AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 5 != 0), a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 3 != 0)
SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change, b.v AS old, a.v AS new FROM b FULL JOIN a USING (k) WHERE b.v IS NULL OR a.v IS NULL OR a.v != b.v""")
def state_diff(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    after = p.filter("k % 3 != 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return op.changes(p.filter("k % 5 != 0"), after, "k", "v")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'space-a' WHEN 'click' THEN 'space-b' ELSE 'legacy-' || event_type END AS space FROM events")
def backfill_space(spark, d):
    return table(spark, d, "events").select("event_id", op.mapped(F.col("event_type"), {"view": "space-a", "click": "space-b"}, F.concat(F.lit("legacy-"), "event_type")).alias("space"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT > 50")
def json_property(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k > 50")


@query("""SELECT o_orderkey, sum(l_quantity)::DOUBLE AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name LIKE '%A%' AND l_discount > 0.05 GROUP BY o_orderkey HAVING sum(l_quantity) > 60""")
def star_join(spark, d):
    lines = table(spark, d, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity")).filter("quantity > 60")
    nations = table(spark, d, "nation").filter("n_name like '%A%'").select(F.col("n_nationkey").alias("c_nationkey"))
    buyers = table(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"))
    # order lines are summed by order before any join; o_orderkey may repeat in orders only if the data says so
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(buyers, "o_custkey", "left_semi").join(lines, "o_orderkey").select("o_orderkey", "quantity")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 7 = 0),
n AS (SELECT source AS node FROM e UNION SELECT target FROM e), r AS (SELECT 'r0' AS node UNION SELECT e.target FROM e JOIN r ON e.source = r.node) SELECT node FROM n WHERE node NOT IN (SELECT node FROM r)""")
def unreachable_nodes(spark, d):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    edges = nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target")))
    edges = edges.unionByName(customer.filter("c_custkey % 7 = 0").select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target")))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    return op.unreachable(nodes, edges, "r0")


@query(f"""SELECT doc_id, CASE WHEN doc_id IN (SELECT conv_id % 40 FROM conversations WHERE turn IN (1, 2)) THEN 'generated' ELSE source END AS source FROM documents""")
def generated_files(spark, d):
    """Arrays, arrays inside a JSON string, other values and ids that aren't UUIDs, by turn."""
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("conv_id") % 40).cast("string"), 12, "0"))
    array = F.concat(F.lit('[{"file_id":"'), uuid, F.lit('","file_name":"a \\" b"},{"file_id":"no"}]'))
    escaped = F.concat(F.lit('"'), F.replace(F.replace(array, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    column = F.when(F.col("turn") == 1, array).when(F.col("turn") == 2, escaped).when(F.col("turn") == 3, '{"file_id": 1}').when(F.col("turn") == 4, "5")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), "source")
    return op.mark_generated(files, table(spark, d, "conversations").select(column.alias("generated_files"))).select("doc_id", "source")
