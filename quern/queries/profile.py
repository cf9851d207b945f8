"""Queries of column roles, profiles and timings in log text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import normalize_header
from quern.operators import profile as op
from quern.queries.registry import query
from quern.queries.table import SHAPES, _statements
from quern.sources.tables import table

HEADERS = ["Dauer (ms)", "Duração [s]", "wait us", "Nanos", "Minutes/step", "Status-Code!", "ms or s", "Größe"]
PLAIN = ["Dauer (ms)", "Duracao [s]", "wait us", "Nanos", "Minutes/step", "Status-Code", "ms or s", "Gro e"]


@query(f"""WITH h AS (SELECT doc_id, {PLAIN!r}[doc_id % 8 + 1] AS header FROM documents)
SELECT doc_id, header, CASE WHEN doc_id % 8 IN (0, 5, 6, 7) THEN 'ms' ELSE ['s', 'us', 'ns', 'min'][doc_id % 8] END AS unit,
CASE WHEN doc_id % 8 IN (0, 5, 6, 7) THEN 1.0 ELSE [1000.0, 0.001, 0.000001, 60000.0][doc_id % 8] END::DOUBLE AS to_ms, doc_id % 8 NOT IN (5, 7) AS stated FROM h""")
def header_units(spark, d):
    given = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.col("doc_id") % 8 + 1).cast("int"))
    said = table(spark, d, "documents").select("doc_id", normalize_header(given).alias("header"))
    return said.withColumn("u", op.unit(F.col("header"))).select("doc_id", "header", F.col("u.label").alias("unit"), F.col("u.to_ms").alias("to_ms"), F.col("u.stated").alias("stated"))


def _roles(name: str, columns: dict[str, str]) -> str:
    """SQL of named roles over a table's columns (no guess): header -> column."""
    cells = " UNION ALL ".join(f"SELECT {i} AS place, '{h}' AS column_name, {c}::VARCHAR AS cell FROM {name}" for i, (h, c) in enumerate(columns.items(), 1))
    said = lambda k: f"regexp_matches(column_name, '{op.words(op.HEADER_WORDS[k])}')"
    timed = r"regexp_matches(column_name, '(?i)\b(s|sec|secs|second|seconds)\b')"
    return f"""WITH cells AS ({cells}), t AS (SELECT place, column_name, avg((try_cast(cell AS DOUBLE) IS NOT NULL)::INT) AS num, avg(regexp_matches(cell, '{op.STATEMENT}')::INT) AS sql, avg(length(cell)) AS len
FROM cells WHERE trim(cell) != '' GROUP BY ALL), r AS (SELECT *, CASE WHEN sql >= 0.4 THEN ['statement', 'values'] WHEN {said("statement")} AND len > 20 AND num < 0.3 THEN ['statement', 'header']
WHEN num >= 0.8 AND {said("duration")} THEN ['duration', 'header and values'] WHEN num >= 0.8 AND {said("count")} THEN ['count', 'header and values'] WHEN num >= 0.8 THEN ['numeric', 'values']
WHEN {said("timestamp")} THEN ['timestamp', 'header'] WHEN {said("status")} THEN ['status', 'header'] ELSE ['text', 'no match'] END AS r FROM t)
SELECT place, column_name, r[1] AS role, r[2] AS basis, CASE WHEN {timed} THEN 's' ELSE 'ms' END AS unit, CASE WHEN {timed} THEN 1000.0 ELSE 1.0 END::DOUBLE AS to_ms, {timed} AS unit_stated,
r[1] = 'count' AND regexp_matches(column_name, '{op.words(op.EXECUTION_WORDS)}') AS executions FROM r"""


EVENTS = {"Vorgang": "event_id", "calls": "user_id", "Typ": "event_type", "Datum": "ts", "Dauer [s]": "value", "props": "props"}


@query(_roles("events", EVENTS))
def column_roles(spark, d):
    return op.column_roles(table(spark, d, "events").select(*[F.col(c).alias(h) for h, c in EVENTS.items()]))


FIXED = "SELECT unnest(['sql: statement (values)', 'Dauer (s): duration (header and values)']) AS item, unnest([1, 2]) AS n"


@query(
    SHAPES.replace("l_quantity AS ms", "l_quantity * 1000 AS ms")
    + f""", v AS (SELECT l_quantity * 1000 AS ms FROM lineitem), m AS (SELECT count(*) AS n, round(sum(ms), 2) AS total, round(avg(ms), 4) AS avg, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95,
quantile_disc(ms, 0.99) AS p99, max(ms) AS max FROM v), r(rule, shape) AS (SELECT 'select-star', shape FROM f WHERE shape LIKE 'SELECT *%' UNION ALL SELECT 'no-where', shape FROM f WHERE shape LIKE 'SELECT%FROM%' AND shape NOT LIKE '%WHERE%'
UNION ALL SELECT 'leading-wildcard', shape FROM f WHERE contains(shape, 'LIKE ''%') UNION ALL SELECT 'function-on-column', shape FROM f WHERE regexp_matches(shape, 'WHERE (UPPER|LOWER)[(][A-Z]+[)] =')
UNION ALL SELECT 'not-in', shape FROM f WHERE contains(shape, 'NOT IN') UNION ALL SELECT 'or-filter', shape FROM f WHERE regexp_matches(shape, 'WHERE.* OR ')
UNION ALL SELECT 'cartesian', shape FROM f WHERE contains(shape, 'FROM A, B') UNION ALL SELECT 'order-by-unbounded', shape FROM f WHERE contains(shape, 'ORDER BY'))
SELECT 'columns' AS section, item, n::BIGINT AS n, NULL::DOUBLE AS ms FROM ({FIXED})
UNION ALL SELECT 'timing', unnest(['total', 'avg', 'p50', 'p95', 'p99', 'max']), n, unnest([total, avg, p50, p95, p99, max]) FROM m
UNION ALL SELECT 'statement', shape, calls, total_ms FROM f UNION ALL SELECT 'anti-pattern', rule, sum(calls)::BIGINT, round(sum(total_ms), 2) FROM r JOIN f USING (shape) GROUP BY rule"""
)
def table_profile(spark, d):
    # which of many equally slow rows are named depends on their texts; the test looks at those
    return op.profile(_statements(spark, d).withColumnRenamed("ms", "Dauer (s)")).filter("section != 'slowest'")


LOG = """WITH t AS (SELECT event_id AS line_no, CASE WHEN event_id % 8 = 0 THEN 1000.0 ELSE 1.0 END * (user_id % 50) AS ms, event_id % 12 AS kind, user_id FROM events WHERE event_id % 4 = 0)
, s AS (SELECT line_no, ms::DOUBLE AS ms, CASE WHEN kind != 0 THEN 'SELECT a, b FROM t WHERE id = ' || (line_no + 2) END AS statement FROM t)"""


def _log(spark, d):
    """Lines of one file: a timing, its statement over two lines (none at every third timing), an empty line."""
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    said = F.concat(F.lit("2024-01-01 INFO took "), F.col("user_id") % 50, F.when(F.col("event_id") % 8 == 0, " sec").otherwise(" ms"))
    bare = F.floor(F.col("event_id") / 4) % 3 == 0
    second = F.when(bare, "").otherwise("SELECT a, b")
    third = F.when(bare, "").otherwise(F.concat(F.lit("  FROM t WHERE id = "), F.col("event_id")))
    raw = F.when(k == 0, said).when(k == 1, second).when(k == 2, third).otherwise("")
    return e.select(F.lit("a.log").alias("file"), F.col("event_id").alias("line_no"), raw.alias("raw"))


@query(LOG + " SELECT line_no, ms, statement FROM s")
def inline_timings(spark, d):
    return op.inline_timings(_log(spark, d)).select("line_no", "ms", "statement")


@query(LOG + " SELECT 'SELECT A, B FROM T WHERE ID = ?' AS shape, count(*) AS calls, round(sum(ms), 2) AS total_ms, max(ms) AS max_ms, round(round(sum(ms), 2) / count(*), 4) AS mean_ms FROM s WHERE statement IS NOT NULL")
def timed_statements(spark, d):
    return op.timed_statements(op.inline_timings(_log(spark, d)))
