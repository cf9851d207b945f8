"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import conversation as op
from quern.operators import prompt
from quern.queries.registry import query
from quern.sources.tables import table

ESTIMATE = """CASE WHEN length(b) = 0 THEN 0 ELSE greatest(ceil(length(b) / CASE WHEN length(regexp_replace(left(b, 4000), '[A-Za-z0-9 \\t\\n\\r]', '', 'g')) / length(left(b, 4000)) > 0.15 THEN 3.0 ELSE 4.0 END),
ceil(len(regexp_split_to_array(b, '\\s+')) * 13 / 10)) END::BIGINT"""
BARE = r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')"


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def buffer_memory(spark, d):
    return op.buffer_window(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role")


@query(f"""WITH s AS (SELECT conv_id, turn, {ESTIMATE} AS tokens FROM (SELECT *, {BARE} AS b FROM conversations)),
k AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS kept_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM s)
SELECT conv_id, turn, tokens, kept_tokens FROM k WHERE kept_tokens <= 300 OR r = 1""")
def token_buffer(spark, d):
    return op.token_buffer(table(spark, d, "conversations"), 300).select("conv_id", "turn", "tokens", "kept_tokens")


@query("""WITH p AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
f AS (SELECT *, sum(ceil(length(text) / 4.0) + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
FROM p WHERE a > greatest(0, n - 4) // 2 * 2),
k AS (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u FROM f WHERE s <= 0.95 * 400 OR r <= 2) SELECT conv_id, turn, role FROM k WHERE turn >= u""")
def history_window(spark, d):
    return op.history_window(table(spark, d, "conversations"), budget=400, step=2, most=4).select("conv_id", "turn", "role")


@query("""SELECT conv_id, count(*) FILTER (WHERE r <= 3) AS kept, count(*) FILTER (WHERE r > 3) AS folded,
coalesce(string_agg(regexp_extract(text, '^([^.!?]*[.!?]?)', 1), ' ' ORDER BY turn) FILTER (WHERE r > 3), '') AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY conv_id""")
def window_memory(spark, d):
    return op.window_memory(table(spark, d, "conversations"), 3)


@query("""SELECT conv_id, turn, role FROM (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END AS role FROM conversations)) WHERE turn >= u""")
def leading_user(spark, d):
    # the roles change places, so that conversations open with the assistant
    turned = table(spark, d, "conversations").replace({"user": "assistant", "assistant": "user"}, subset=["role"])
    return op.history_window(turned, budget=10**9, most=10**6).select("conv_id", "turn", "role")


@query("""WITH m AS (SELECT conv_id, turn, role, TIMESTAMP '2024-01-01' + to_minutes(turn // 2) AS t FROM conversations),
k AS (SELECT *, count(*) OVER w = 2 AND count(*) FILTER (WHERE role = 'user') OVER w = 1 AND count(*) FILTER (WHERE role = 'assistant') OVER w = 1 AND role = 'assistant' AS moved FROM m WINDOW w AS (PARTITION BY conv_id, t))
SELECT conv_id, turn, moved, epoch_ms(t) + CASE WHEN moved THEN 1 ELSE 0 END AS at_ms FROM k""")
def tie_repair(spark, d):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.floor(F.col("turn") / 2) * 60)
    fixed = op.repair_ties(table(spark, d, "conversations").withColumn("created_at", at))
    return fixed.select("conv_id", "turn", "moved", F.unix_millis("created_at").alias("at_ms"))


@query("""SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), lag(text) OVER w, text, lead(text) OVER w)) AS parent_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def parent_windows(spark, d):
    return op.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("parent").alias("parent_md5"))


@query(r"""WITH c AS (SELECT text FROM conversations), e AS (SELECT 'person' AS kind, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+ (?:[A-Z][a-z]+)*\b'))) AS entity FROM c
UNION ALL SELECT 'date', unnest(list_distinct(regexp_extract_all(text, '\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}|\d{4}\b'))) FROM c
UNION ALL SELECT 'number', unnest(list_distinct(regexp_extract_all(text, '\b\d+(?:,\d{3})*(?:\.\d+)?\b'))) FROM c)
SELECT kind, entity, count(*) AS messages FROM e GROUP BY ALL""")
def entity_mentions(spark, d):
    return op.entity_mentions(table(spark, d, "conversations"))


@query(r"""WITH t AS (SELECT role, unnest(regexp_extract_all(text, '\b(?:[A-Z][a-zA-Z0-9_-]{2,}|[A-Z]{2,}|\d[\d.,%-]*|[a-z][a-z0-9_-]{4,})\b')) AS term FROM conversations),
c AS (SELECT role, term, count(*) AS n FROM t WHERE lower(term) NOT IN ('there','their','about','would','could','should','after','before','where','which','while','using','please','thanks','summary','conversation') GROUP BY ALL)
SELECT * FROM (SELECT role, term, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, length(term) DESC, term) AS rank FROM c) WHERE rank <= 10""")
def important_terms(spark, d):
    return op.important_terms(table(spark, d, "conversations"), "role")


@query(r"""WITH b AS (SELECT conv_id, turn, text, 'conversation ' || conv_id AS title, split_part(text, ' ', CASE WHEN turn % 2 = 0 THEN 1 ELSE 60 END) AS section FROM conversations)
SELECT conv_id, turn, md5(concat_ws(' > ', title, CASE WHEN section != '' AND strpos(left(text, 200), section) = 0 THEN section END) || chr(10) || chr(10) || text) AS embed_md5 FROM b""")
def embedding_text(spark, d):
    place = F.when(F.col("turn") % 2 == 0, 1).otherwise(60)
    named = table(spark, d, "conversations").withColumn("title", F.concat(F.lit("conversation "), F.col("conv_id"))).withColumn("section", F.coalesce(F.get(F.split("text", " "), place - 1), F.lit("")))
    return op.embedding_text(named, "title", "section", "text").select("conv_id", "turn", F.md5("embed_text").alias("embed_md5"))


@query(f"""WITH s AS (SELECT conv_id, turn, role, {ESTIMATE} + 4 AS tokens FROM (SELECT *, {BARE} AS b FROM conversations)),
p AS (SELECT *, sum(tokens) OVER w AS whole, turn = max(turn) OVER w AS last, NOT bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spoke FROM s WINDOW w AS (PARTITION BY conv_id)),
h AS (SELECT *, spoke AND NOT last AS h FROM p),
c AS (SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remain, coalesce(sum(tokens) FILTER (WHERE h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
e AS (SELECT *, min(turn) FILTER (WHERE h AND role != 'assistant') OVER (PARTITION BY conv_id) AS opening FROM c WHERE NOT (whole > 900 AND h AND whole - before > 765 AND remain > 2)),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS kept FROM e WHERE whole <= 900 OR NOT h OR coalesce(turn >= opening, false)),
t AS (SELECT *, kept > 900 AND last AND role = 'user' AND 900 - (kept - tokens) - 8 >= 100 AS trimmed FROM o)
SELECT conv_id, turn, CASE WHEN NOT trimmed THEN tokens::BIGINT END AS tokens, trimmed FROM t""")
def prompt_fit(spark, d):
    fitted = op.fit_prompt(table(spark, d, "conversations"), 900, floor=2, least_query=100)
    return fitted.select("conv_id", "turn", F.when(~F.col("trimmed"), F.col("tokens")).alias("tokens"), "trimmed")


@query(f"""WITH s AS (SELECT conv_id, turn, role, {ESTIMATE} + 4 AS tokens FROM (SELECT *, {BARE} AS b FROM conversations)),
c AS (SELECT conv_id, turn AS place, turn % 5 AS rank, ['## Web Search Context', '## URL Context', '## Retrieved Context', '## File Context', '## Notes'][turn % 5 + 1] || ' ' || coalesce(text, '') AS text FROM conversations WHERE turn < 7),
x AS (SELECT conv_id, place, rank, {ESTIMATE} AS tokens FROM (SELECT *, {BARE} AS b FROM c)),
x1 AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS many, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY rank, place)),
t AS (SELECT conv_id, a.said + coalesce(b.held, 0) AS total FROM (SELECT conv_id, sum(tokens) AS said FROM s GROUP BY conv_id) a LEFT JOIN (SELECT conv_id, sum(tokens) + 4 AS held FROM x GROUP BY conv_id) b USING (conv_id)),
x2 AS (SELECT *, total > 1500 AND rank <= 1 AND total - earlier > 1275 AND nth < many AS gone FROM x1 JOIN t USING (conv_id)),
f AS (SELECT conv_id, coalesce(sum(tokens) FILTER (WHERE gone), 0) AS freed FROM x2 GROUP BY conv_id),
p AS (SELECT *, total - coalesce(freed, 0) AS over_now, turn = max(turn) OVER w AS last, NOT bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spoke FROM s JOIN t USING (conv_id) LEFT JOIN f USING (conv_id) WINDOW w AS (PARTITION BY conv_id)),
h AS (SELECT *, spoke AND NOT last AS h FROM p),
k AS (SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remain, coalesce(sum(tokens) FILTER (WHERE h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
e AS (SELECT *, min(turn) FILTER (WHERE h AND role != 'assistant') OVER (PARTITION BY conv_id) AS opening FROM k WHERE NOT (total > 1500 AND h AND over_now - before > 1275 AND remain > 2)),
o AS (SELECT * FROM e WHERE total <= 1500 OR NOT h OR coalesce(turn >= opening, false)), m AS (SELECT conv_id, sum(tokens) AS said FROM o GROUP BY conv_id),
y AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) + said + 4 AS now, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier2 FROM x2 JOIN m USING (conv_id) WHERE NOT gone),
z AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) + said + 4 AS now2 FROM y WHERE NOT (total > 1500 AND now - earlier2 > 1500 AND nth < many)), v AS (SELECT * FROM z WHERE total <= 1500 OR now2 <= 1500),
r AS (SELECT o.*, sum(o.tokens) OVER (PARTITION BY conv_id) + coalesce(held, 0) AS now FROM o LEFT JOIN (SELECT conv_id, sum(tokens) + 4 AS held FROM v GROUP BY conv_id) USING (conv_id)),
q AS (SELECT *, now > 1500 AND last AND role = 'user' AND 1500 - (now - tokens) - 8 >= 100 AS trimmed FROM r)
SELECT conv_id, 'message' AS kind, turn AS place, CASE WHEN NOT trimmed THEN tokens::BIGINT END AS tokens, trimmed FROM q UNION ALL SELECT conv_id, 'section', place, tokens::BIGINT, false FROM v""")
def prompt_sections(spark, d):
    """Conversations with their first seven texts as retrieved sections of five kinds."""
    c, heads = table(spark, d, "conversations"), F.array(*[F.lit(h) for h in [*prompt.SECTIONS, "## Notes"]])
    sections = c.filter("turn < 7").select("conv_id", F.col("turn").alias("place"), F.concat(F.get(heads, (F.col("turn") % 5).cast("int")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    fitted = prompt.fit_prompt(c, sections, 1500, floor=2, least_query=100)
    return fitted.select("conv_id", "kind", "place", F.when(~F.col("trimmed"), F.col("tokens")).alias("tokens"), "trimmed")
