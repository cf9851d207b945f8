"""Queries over log lines, written from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import MASKS
from quern.operators import digest as digest_op
from quern.operators import logs as op
from quern.queries.registry import query
from quern.sources.tables import table


def _masks() -> str:
    """The masks applied in SQL to a raw line."""
    out = "raw"
    for pattern, kind in MASKS:
        out = "regexp_replace(%s, '%s', '%s', 'g')" % (out, pattern.replace("'", "''"), kind)
    return f"trim({out})"


LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END"
AT = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
LINES = f"""WITH r AS (SELECT event_id + 1 AS line_no, ts, {LEVEL} AS severity,
{AT} || ' ' || {LEVEL} || ' user=' || user_id || ' ' || event_type || CASE WHEN event_id % 4000 = 17 THEN ' rare path /var/lib/x.log' ELSE ' took ' || round("value", 1) || ' ms' END AS raw FROM events),
l AS (SELECT line_no, ts, severity, {_masks()} AS masked FROM r) """
#: A log whose events begin with their type, so that it has several templates.
EVENTS = f"""WITH r AS (SELECT event_id + 1 AS line_no, {LEVEL} AS severity, event_type,
{AT} || ' ' || event_type || ' ' || {LEVEL} || ' from 10.0.' || user_id % 250 || '.1 user=' || user_id || CASE WHEN event_id % 4000 = 17 THEN ' rare path /var/lib/' || event_id || '/x.log' ELSE ' took ' || round("value", 1) || ' ms' END AS raw FROM events),
l AS (SELECT line_no, severity, event_type, {_masks()} AS masked FROM r) """
#: Lines of a leaf of these logs are alike enough to be one template: the places where all agree. w is the lines with their tokens and leaf.
MINED = """, s AS (SELECT *, string_split(masked, ' ') AS t FROM l), w AS (SELECT *, len(t) AS size, CASE WHEN regexp_matches(t[1], '<[A-Z]+>|[0-9]') THEN '<*>' ELSE t[1] END AS a, CASE WHEN regexp_matches(t[2], '<[A-Z]+>|[0-9]') THEN '<*>' ELSE t[2] END AS b FROM s),
p AS (SELECT size, a, b, k, CASE WHEN count(DISTINCT word) = 1 THEN min(word) ELSE '<*>' END AS word FROM (SELECT size, a, b, unnest(t) AS word, unnest(range(len(t))) AS k FROM w) GROUP BY ALL),
t AS (SELECT size, a, b, string_agg(word, ' ' ORDER BY k) AS template FROM p GROUP BY ALL),
m AS (SELECT template, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line, arg_min(severity, line_no) AS severity FROM w JOIN t USING (size, a, b) GROUP BY template)"""


def _written(spark, d, first, second):
    """A log written from events; ``first`` and ``second`` make the beginning and the end of an event from level and place."""
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    took = F.concat(F.lit(" took "), F.round("value", 1).cast("string"), F.lit(" ms"))
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), first(level), F.when(F.col("event_id") % 4000 == 17, second).otherwise(took))
    return op.annotate(e.select((F.col("event_id") + 1).alias("line_no"), "event_type", raw.alias("raw")))


def _lines(spark, d):
    return _written(spark, d, lambda level: F.concat(level, F.lit(" user="), F.col("user_id"), F.lit(" "), F.col("event_type")), F.lit(" rare path /var/lib/x.log"))


def _events(spark, d):
    said = lambda level: F.concat(F.col("event_type"), F.lit(" "), level, F.lit(" from 10.0."), F.col("user_id") % 250, F.lit(".1 user="), F.col("user_id"))
    return _written(spark, d, said, F.concat(F.lit(" rare path /var/lib/"), F.col("event_id"), F.lit("/x.log")))


@query(LINES + "SELECT masked, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line, min(severity) AS severity FROM l GROUP BY masked")
def log_masking(spark, d):
    return op.masked_counts(_lines(spark, d)).select("masked", "n", "first_line", "last_line", "severity")


@query(LINES + "SELECT severity, count(*) AS n FROM l GROUP BY severity")
def severity_mix(spark, d):
    return op.severity_mix(_lines(spark, d))


@query(EVENTS + MINED + " SELECT * FROM m WHERE n <= greatest(2, floor((SELECT sum(n) FROM m) * 0.0005)) ORDER BY n, first_line LIMIT 12")
def rare_events(spark, d):
    return op.rare_events(op.mine_templates(_events(spark, d)))


@query(LINES + MINED + " SELECT * FROM m")
def template_counts(spark, d):
    return op.mine_templates(_lines(spark, d))


@query(EVENTS + MINED + " SELECT * FROM m WHERE severity = 'ERROR' ORDER BY n DESC, first_line LIMIT 10")
def error_templates(spark, d):
    return op.error_templates(op.mine_templates(_events(spark, d)))


@query(EVENTS + MINED.replace("FROM l)", "FROM l WHERE line_no % 2 = 0 AND event_type != 'click')") + """, x AS (SELECT *, string_split(masked, ' ') AS u FROM l WHERE line_no % 2 = 1)
SELECT masked, count(*) AS n, min(line_no) AS first_line, any_value(template) AS template FROM x LEFT JOIN t ON size = len(u) AND b = u[2] GROUP BY masked""")
def matched_templates(spark, d):
    """The odd lines of a log against the templates of its even ones, of which none is a click."""
    lines = _events(spark, d)
    model = op.template_model(lines.filter((F.col("line_no") % 2 == 0) & (F.col("event_type") != "click")))
    return op.match_templates(model, lines.filter(F.col("line_no") % 2 == 1)).select("masked", "n", "first_line", "template")


@query(LINES + """, b AS (SELECT date_trunc('hour', date_trunc('second', ts)) AS "at", count(*) AS n, count(*) FILTER (WHERE severity = 'ERROR') AS errors FROM l GROUP BY "at"),
m AS (SELECT -quantile_disc(-n, 0.5) AS median FROM b), d AS (SELECT greatest(-quantile_disc(-abs(n - median), 0.5), 0) AS mad FROM b, m)
SELECT strftime("at", '%Y-%m-%d %H:%M:%S') AS "at", n, errors, median::BIGINT AS median, CASE WHEN mad = 0 THEN 1 ELSE mad END::DOUBLE AS mad FROM b, m, d
WHERE n > median + 4 * CASE WHEN mad = 0 THEN 1 ELSE mad END AND n > 1.5 * median ORDER BY n DESC, "at" LIMIT 5""")
def rate_bursts(spark, d):
    return op.bursts(_lines(spark, d), bucket_s=3600).select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "n", "errors", F.col("median").cast("bigint").alias("median"), F.col("mad").cast("double").alias("mad"))


@query(LINES + "SELECT line_no, severity, masked FROM l WHERE line_no BETWEEN 4000 AND 4200 ORDER BY line_no LIMIT 150")
def read_rows_range(spark, d):
    return op.read_rows(_lines(spark, d), 4000, 4200).select("line_no", "severity", "masked")


@query(LINES + """SELECT line_no, severity FROM l WHERE abs(epoch(date_trunc('second', ts))::BIGINT - epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT) <= 1800 ORDER BY line_no LIMIT 150""")
def read_rows_around(spark, d):
    return op.read_around(_lines(spark, d), "2024-01-15 12:00:00", 1800).select("line_no", "severity")


@query(EVENTS.replace("FROM r)", "FROM r WHERE CASE WHEN line_no % 3 = 0 THEN event_type != 'signup' AND NOT (event_type = 'click' AND line_no % 5 != 0) ELSE event_type != 'purchase' END)") + MINED + """,
k AS (SELECT template, count(*) FILTER (WHERE line_no % 3 != 0) AS before, count(*) FILTER (WHERE line_no % 3 = 0) AS after FROM w JOIN t USING (size, a, b) GROUP BY template),
r2 AS (SELECT *, CASE WHEN before > 0 AND after > 0 THEN (after / sum(after) OVER ()) / (before / sum(before) OVER ()) END AS ratio FROM k)
SELECT template, before, after, round(ratio, 4) AS ratio, CASE WHEN before = 0 THEN 'appeared' WHEN after = 0 THEN 'vanished' WHEN ratio >= 3 THEN 'more' ELSE 'less' END AS change FROM r2
WHERE before = 0 OR after = 0 OR ratio >= 3 OR ratio <= 1 / 3.0""")
def compare_logs(spark, d):
    """Every third line makes the current log, without sign-ups and with a fifth of the clicks; purchases are missing from the baseline."""
    lines, third, kind = _events(spark, d), F.col("line_no") % 3 == 0, F.col("event_type")
    current = lines.filter(third & (kind != "signup") & ~((kind == "click") & (F.col("line_no") % 5 != 0)))
    return op.compare(lines.filter(~third & (kind != "purchase")), current)


@query(LINES + """, e AS (SELECT DISTINCT unnest(generate_series(line_no - 3, line_no + 4)) AS line_no FROM l WHERE severity IN ('ERROR', 'FATAL')),
n AS (SELECT line_no, CASE WHEN line_no - lag(line_no, 1, -10) OVER (ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS new, coalesce(severity IN ('ERROR', 'FATAL'), false) AS incident FROM l JOIN e USING (line_no))
SELECT (sum(new) OVER (ORDER BY line_no))::BIGINT AS cluster, line_no, incident FROM n""")
def incident_context(spark, d):
    return op.incident_context(_lines(spark, d))


@query("SELECT line_no FROM (SELECT event_id + 1 AS line_no, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events) WHERE p IN (SELECT floor(i * n / 50)::BIGINT FROM range(50) r(i), (SELECT count(*) AS n FROM events))")
def even_sample(spark, d):
    return op.sampled(table(spark, d, "events").select((F.col("event_id") + 1).alias("line_no")), 50)


@query(EVENTS + MINED + " SELECT template, n, first_line, last_line, severity, round(n / sum(n) OVER (), 4) AS share FROM m")
def mine_report(spark, d):
    return op.mine_report(_events(spark, d))


#: A log with bursts of errors and, in places, fatal events.
TOLD = """WITH RECURSIVE r AS (SELECT event_id + 1 AS line_no, CASE WHEN event_id % 300 IN (7, 9, 15) THEN 'worker crashed' WHEN event_type = 'error' OR (event_id // 50) % 4 = 1 THEN 'request failed: timeout' ELSE 'served ' || event_type END || ' for user ' || user_id AS raw FROM events),
k AS (SELECT *, raw LIKE 'worker crashed%' AS fatal, raw LIKE 'request failed%' AS bad, max(line_no) OVER () AS last FROM r),
size AS (SELECT count(*) <= 1200 AND sum(length(raw)) + count(*) <= 250000 AS short FROM r),
fs AS MATERIALIZED (SELECT line_no, min(line_no) OVER (ORDER BY line_no RANGE BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM k WHERE fatal),
f AS (SELECT min(line_no) AS place, 1 AS c FROM fs UNION ALL SELECT next, c + 1 FROM f JOIN fs ON line_no = place WHERE c < 25 AND next IS NOT NULL),
g AS MATERIALIZED (SELECT line_no, min(line_no) OVER (ORDER BY line_no RANGE BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM k WHERE bad AND line_no NOT IN (SELECT unnest(range(place - 3, place + 5)) FROM f)),
p AS (SELECT min(line_no) AS place FROM g UNION ALL SELECT next FROM p JOIN g ON line_no = place WHERE next IS NOT NULL),
n AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS number, count(*) OVER () AS many FROM p), room AS (SELECT 35 - count(*) AS room FROM f WHERE place IS NOT NULL),
w AS (SELECT DISTINCT least(many - 1, floor(s * (many / room))::BIGINT) AS number FROM room, (SELECT max(many) AS many FROM n), range(35) t(s) WHERE many > room AND s < room UNION SELECT number FROM n, room WHERE many <= room),
chosen AS (SELECT place, true AS fatal FROM f WHERE place IS NOT NULL UNION ALL SELECT place, false FROM n JOIN w USING (number)), c AS (SELECT *, row_number() OVER (ORDER BY place)::INTEGER AS cluster FROM chosen)
SELECT u.* FROM (SELECT 'head' AS section, NULL::INTEGER AS cluster, NULL::BOOLEAN AS fatal, line_no, raw FROM k WHERE line_no <= 120 UNION ALL SELECT 'tail', NULL, NULL, line_no, raw FROM k WHERE line_no > last - 150
UNION ALL SELECT 'incident', cluster, c.fatal, line_no, raw FROM k JOIN (SELECT cluster, fatal, unnest(range(place - 3, place + 5)) AS line_no FROM c) c USING (line_no)) u, size WHERE NOT short UNION ALL SELECT 'whole', NULL, NULL, line_no, raw FROM k, size WHERE short"""


@query(TOLD)
def incident_digest(spark, d):
    e = F.col("event_id")
    said = F.when((e % 300).isin(7, 9, 15), "worker crashed").when((F.col("event_type") == "error") | (F.floor(e / 50) % 4 == 1), "request failed: timeout").otherwise(F.concat(F.lit("served "), "event_type"))
    return digest_op.digest(table(spark, d, "events").select((e + 1).alias("line_no"), F.concat(said, F.lit(" for user "), F.col("user_id")).alias("raw")))
