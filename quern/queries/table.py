"""Queries over tables with columns chosen by the caller."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import table as op
from quern.queries.registry import query
from quern.sources.tables import table

STATS = "count(v) AS n, round(sum(v), 2) AS total, round(avg(v), 4) AS avg, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, max(v) AS max"


@query(f"SELECT {STATS} FROM (SELECT l_extendedprice AS v FROM lineitem)")
def analyze_table_value(spark, d):
    return op.analyze_value(table(spark, d, "lineitem"), "l_extendedprice")


@query("""SELECT l_returnflag AS group_key, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice) / count(*), 4) AS avg,
max(l_extendedprice) AS max FROM lineitem WHERE contains(lower(l_linestatus), 'o') AND l_extendedprice >= 1000 GROUP BY l_returnflag""")
def analyze_table_group(spark, d):
    return op.analyze_group(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", where=("l_linestatus", "O"), low=1000)


@query("""SELECT l_extendedprice AS value, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
ORDER BY value DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10""")
def analyze_table_topn(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return op.top_rows(table(spark, d, "lineitem"), "l_extendedprice", 10, keys).select("value", *keys)


@query(f"SELECT {STATS} FROM (SELECT p_retailprice AS v FROM part WHERE contains(lower(p_type), 'a') AND p_retailprice BETWEEN 950 AND 1500)")
def analyze_table_filtered(spark, d):
    return op.analyze_value(table(spark, d, "part"), 6, where=("p_type", "a"), low=950, high=1500)


CENSUS = """WITH cells AS ({cells}), c AS (SELECT column_name, cell, count(*) AS n, try_cast(cell AS DOUBLE) AS v, regexp_matches(cell, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS dated FROM cells WHERE trim(cell) != '' GROUP BY ALL),
u AS (SELECT column_name, v, sum(n) OVER (PARTITION BY column_name ORDER BY v) AS upto, floor(sum(n) OVER (PARTITION BY column_name) / 2) AS place FROM c WHERE v IS NOT NULL),
m AS (SELECT column_name, min(v) FILTER (WHERE upto > place) AS median FROM u GROUP BY column_name),
t AS (SELECT column_name, sum(n)::BIGINT AS non_empty, count(*) AS distinct_cells, coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) >= 0.8 * sum(n) AS num, min(v) AS lo, max(v) AS hi,
round(sum(v * n), 2) AS s, round(sum(length(cell) * n) / sum(n), 4) AS avg_length, coalesce(sum(n) FILTER (WHERE dated), 0) >= least(sum(n), greatest(5, sum(n) / 4)) AS day FROM c GROUP BY column_name),
p AS (SELECT column_name, string_agg(cell, ' | ' ORDER BY cell) AS samples FROM (SELECT column_name, cell FROM c QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY cell) <= 3) GROUP BY column_name),
q AS (SELECT column_name, string_agg(cell || '=' || n, ', ' ORDER BY n DESC, cell) AS listed FROM c GROUP BY column_name HAVING count(*) <= 12)
SELECT column_name, non_empty, distinct_cells, CASE WHEN num THEN 'number' WHEN day THEN 'datetime' ELSE 'text' END AS kind, CASE WHEN num THEN lo END AS min, CASE WHEN num THEN hi END AS max,
CASE WHEN num THEN s END AS sum, CASE WHEN num THEN median END AS median, avg_length, samples, CASE WHEN NOT num AND NOT day THEN listed END AS value_counts
FROM t LEFT JOIN m USING (column_name) LEFT JOIN p USING (column_name) LEFT JOIN q USING (column_name)"""


def _cells(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS cell FROM {name}" for c in columns)


PART, CUSTOMER = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(CENSUS.format(cells=_cells("part", PART)))
def column_census(spark, d):
    return op.census(table(spark, d, "part").select(*PART))


@query(CENSUS.format(cells=_cells("customer", CUSTOMER)))
def column_census_customer(spark, d):
    return op.census(table(spark, d, "customer").select(*CUSTOMER))


@query(CENSUS.format(cells=_cells("orders", ORDERS)))
def column_census_orders(spark, d):
    return op.census(table(spark, d, "orders").select(*ORDERS))


@query(f"SELECT event_type, {STATS} FROM (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def percentile_summary(spark, d):
    return op.summarize_by(table(spark, d, "events"), "event_type", "value")


@query("""SELECT o_orderstatus AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders
WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus ORDER BY n DESC, status LIMIT 12""")
def status_breakdown(spark, d):
    return op.status_breakdown(table(spark, d, "orders"), "o_orderstatus")


@query("""WITH m AS (SELECT count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders WHERE o_orderdate IS NOT NULL)
SELECT n, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_at, (SELECT min(o_orderkey) FROM orders WHERE o_orderdate = a) AS first_key, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_at,
(SELECT min(o_orderkey) FROM orders WHERE o_orderdate = b) AS last_key, date_diff('second', a, b) AS span_s FROM m""")
def time_window_covered(spark, d):
    return op.time_window(table(spark, d, "orders"), "o_orderdate", "o_orderkey")


@query("""SELECT event_id, value, p50, round(value / p50, 4) AS times_p50 FROM events, (SELECT quantile_disc(value, 0.5) AS p50 FROM events)
WHERE value > 2.0 * p50 ORDER BY value DESC, event_id LIMIT 10""")
def slow_row_outliers(spark, d):
    return op.slow_rows(table(spark, d, "events"), "value", "event_id")


def _statements(spark, d):
    """Statements of four shapes and a few more, written from order lines; the quantity stands for the duration."""
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 7
    sql = (
        F.when(n == 0, F.concat(F.lit("SELECT * FROM orders WHERE id = "), k))
        .when(n == 1, F.concat(F.lit("select a, b from t1 where name like '%x"), k, F.lit("' or id in (1, 2, "), k, F.lit(")")))
        .when(n == 2, F.concat(F.lit("SELECT total FROM orders_2025_01 WHERE UPPER(name) = 'n"), k, F.lit("' -- note")))
        .when(n == 3, F.concat(F.lit("INSERT INTO t2 VALUES ("), k, F.lit(", 'x'), (2, NULL)")))
        .when(n == 4, F.lit("SELECT x FROM a, b ORDER BY x"))
        .when(n == 5, F.concat(F.lit("SELECT x FROM a WHERE id NOT IN (SELECT id FROM b WHERE k = 0x1F"), k, F.lit(")")))
        .otherwise(F.concat(F.lit("USE db"), k))
    )
    return table(spark, d, "lineitem").select(sql.alias("sql"), F.col("l_quantity").alias("ms"))


SHAPES = """WITH s AS (SELECT l_linenumber % 7 AS k, l_quantity AS ms FROM lineitem), g AS (SELECT CASE k
WHEN 0 THEN 'SELECT * FROM ORDERS WHERE ID = ?' WHEN 1 THEN 'SELECT A, B FROM T1 WHERE NAME LIKE ''%?'' OR ID IN (?)' WHEN 2 THEN 'SELECT TOTAL FROM ORDERS_?_? WHERE UPPER(NAME) = ?'
WHEN 3 THEN 'INSERT INTO T2 VALUES (?)' WHEN 4 THEN 'SELECT X FROM A, B ORDER BY X' WHEN 5 THEN 'SELECT X FROM A WHERE ID NOT IN (SELECT ID FROM B WHERE K = ?)' ELSE 'USE ?' END AS shape, ms FROM s),
f AS (SELECT shape, count(*) AS calls, round(sum(ms), 2) AS total_ms, max(ms) AS max_ms, round(round(sum(ms), 2) / count(*), 4) AS mean_ms FROM g GROUP BY shape)"""


@query(SHAPES + " SELECT * FROM f")
def sql_fingerprint_groups(spark, d):
    return op.statement_groups(_statements(spark, d), "sql", "ms")


@query(SHAPES + " SELECT * FROM f WHERE calls >= 100 AND mean_ms < 50")
def nplus1_flags(spark, d):
    return op.n_plus_one(op.statement_groups(_statements(spark, d), "sql", "ms"))


@query(
    SHAPES
    + """, r(rule, confidence, shape) AS (SELECT 'select-star', 'high', shape FROM f WHERE shape LIKE 'SELECT *%' UNION ALL SELECT 'no-where', 'high', shape FROM f WHERE shape LIKE 'SELECT%FROM%' AND shape NOT LIKE '%WHERE%'
UNION ALL SELECT 'leading-wildcard', 'high', shape FROM f WHERE contains(shape, 'LIKE ''%') UNION ALL SELECT 'function-on-column', 'high', shape FROM f WHERE regexp_matches(shape, 'WHERE (UPPER|LOWER)[(][A-Z]+[)] =')
UNION ALL SELECT 'not-in', 'low', shape FROM f WHERE contains(shape, 'NOT IN') UNION ALL SELECT 'or-filter', 'low', shape FROM f WHERE regexp_matches(shape, 'WHERE.* OR ')
UNION ALL SELECT 'cartesian', 'high', shape FROM f WHERE contains(shape, 'FROM A, B') UNION ALL SELECT 'order-by-unbounded', 'high', shape FROM f WHERE contains(shape, 'ORDER BY'))
SELECT rule, confidence, count(*) AS shapes, sum(calls)::BIGINT AS calls, round(sum(total_ms), 2) AS total_ms FROM r JOIN f USING (shape) GROUP BY rule, confidence"""
)
def anti_patterns(spark, d):
    return op.anti_patterns(op.statement_groups(_statements(spark, d), "sql", "ms"))


@query("""WITH v AS (SELECT event_id AS pos, unnest([{'c': 'event_id', 'v': event_id::DOUBLE}, {'c': 'user_id', 'v': user_id::DOUBLE}, {'c': 'value', 'v': value}], recursive := true) FROM events),
f AS (SELECT c AS column_name, v, v < lag(v) OVER (PARTITION BY c ORDER BY pos) AS fell, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY c) AS k FROM v WHERE v >= 0),
s AS (SELECT column_name, count(*) AS n, max(v) AS hi, avg(v) AS mean, min(v) FILTER (WHERE r = k // 2) AS median, count(DISTINCT v) AS ndv, count(*) FILTER (WHERE fell) AS falls, bool_and(v = floor(v)) AS whole FROM f GROUP BY column_name)
SELECT column_name, n, round(hi / mean, 4) AS spread, n >= 10 AND falls > 0 AND NOT (whole AND ndv > 0.95 * n) AND median > 0 AND mean >= 1.2 * median AND hi > 10 * mean AS guessed_duration, 'spread' AS basis FROM s""")
def duration_guess(spark, d):
    return op.guessed_duration(table(spark, d, "events").orderBy("event_id"), ["event_id", "user_id", "value"])


@query("""WITH t AS (SELECT event_id, event_id % 4 AS k, (event_id * 37) % 10000 AS n FROM events)
SELECT event_id, CASE k WHEN 0 THEN n * 1.0 WHEN 1 THEN n * 10.0 + 5 WHEN 2 THEN NULL ELSE 0.5 END::DOUBLE AS number FROM t""")
def parse_numbers(spark, d):
    n = ((F.col("event_id") * 37) % 10000).cast("string")
    k = F.col("event_id") % 4
    cell = F.when(k == 0, F.concat(n, F.lit(" ms"))).when(k == 1, F.concat(n, F.lit(",5 sec."))).when(k == 2, F.concat(n, F.lit("."))).otherwise(F.lit(" .5 "))
    return table(spark, d, "events").select("event_id", text.to_number(cell).alias("number"))
