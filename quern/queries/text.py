"""Queries of text functions, chunking, pages and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quern.functions import html, text, vectors
from quern.operators import chunking
from quern.queries.conversation import BARE, ESTIMATE
from quern.queries.registry import query
from quern.sources.tables import table

def _stripped(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


def _tokens(c: str) -> str:
    """The token estimate of a column in SQL."""
    bare = _stripped(c)
    dense = rf"length(regexp_replace(left({bare}, 4000), '[A-Za-z0-9 \t\n\r]', '', 'g')) > 0.15::DOUBLE * length(left({bare}, 4000))"
    return rf"(CASE WHEN length({bare}) = 0 THEN 0 ELSE greatest(ceil(length({bare}) / (CASE WHEN {dense} THEN 3.0 ELSE 4.0 END))::BIGINT, (len(regexp_split_to_array({bare}, '\s+')) * 13 + 9) // 10) END)"


# pieces of a text in order, packed while they fit: full is the rule by which a piece opens a new chunk
_PACKED = """WITH RECURSIVE p AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM ({pieces})), c AS (SELECT *, {tokens} AS cost FROM p),
f AS (SELECT doc_id, k, 0 AS chunk_index, 1 AS held, cost AS used FROM c WHERE k = 1
UNION ALL SELECT doc_id, k, chunk_index + opens::INT, CASE WHEN opens THEN 1 ELSE held + 1 END, CASE WHEN opens THEN cost ELSE used + cost END
FROM (SELECT c.doc_id, c.k, c.cost, f.chunk_index, f.held, f.used, {full} AS opens FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1))
SELECT doc_id, chunk_index, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM (SELECT doc_id, chunk_index, string_agg(piece, {join} ORDER BY k) AS chunk FROM f JOIN p USING (doc_id, k) GROUP BY ALL) WHERE {kept}"""

CHUNK_LINES_SQL = _PACKED.format(pieces="SELECT doc_id, string_split(text, chr(10)) AS pieces FROM documents WHERE text <> ''", tokens=_tokens("piece"), full="f.used + c.cost > 500 OR f.held >= 50", join="chr(10)", kept="true")
CHUNK_SENTENCES_SQL = _PACKED.format(
    pieces=rf"SELECT doc_id, string_split(regexp_replace({_stripped('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS pieces FROM documents WHERE text <> ''",
    tokens=_tokens("piece"), full="f.used + c.cost > 500", join="' '", kept="chunk <> ''",
)
CHUNK_WINDOWS_SQL = rf"""WITH w AS (SELECT doc_id, regexp_split_to_array({_stripped("text")}, '\s+') AS words FROM documents WHERE {_stripped("text")} <> ''), s AS (SELECT doc_id, words, unnest(range(0, greatest(1, len(words) - 50), 150)) AS s FROM w)
SELECT doc_id, (s // 150)::INT AS chunk_index, length(c) AS n_chars, md5(c) AS chunk_md5 FROM (SELECT doc_id, s, array_to_string(words[s + 1:s + 200], ' ') AS c FROM s)"""
# where a chunk ends: behind the last line end or sentence before its size, if that is past 600 characters
CHUNK_PARENT_CHILD_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
f AS (SELECT doc_id, 0::BIGINT AS pos, 0::BIGINT AS stop, 0::BIGINT AS next FROM d
UNION ALL SELECT doc_id, pos, stop, CASE WHEN stop >= n THEN NULL ELSE greatest(pos + 1, stop - 150) END FROM (
SELECT doc_id, n, pos, CASE WHEN pos + 1000 >= n THEN n WHEN greatest(line, sentence) > pos + 600 THEN CASE WHEN line >= sentence THEN line + 1 ELSE sentence + 2 END ELSE pos + 1000 END AS stop FROM (
SELECT d.doc_id, n, f.next AS pos, CASE WHEN contains(h, chr(10)) THEN length(regexp_extract(h, '(?s)^(.*)\n', 1)) ELSE -1 END AS line, CASE WHEN contains(h, '. ') THEN length(regexp_extract(h, '(?s)^(.*)\. ', 1)) ELSE -1 END AS sentence
FROM f JOIN d ON d.doc_id = f.doc_id AND f.next IS NOT NULL, LATERAL (SELECT substr(d.text, 1, f.next + 1001) AS h) x))),
c AS (SELECT doc_id, pos, {_stripped("substr(text, pos + 1, stop - pos)")} AS chunk FROM f JOIN d USING (doc_id) WHERE stop > pos)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_index, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM c WHERE length(chunk) > 20"""
TRIMMED_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_tokens("coalesce(text, '')")} AS n FROM documents),
r AS (SELECT doc_id, greatest(0, floor(100 * (length(text)::DOUBLE / greatest(1, n))) - 16)::BIGINT AS size, 0 AS tried FROM d WHERE n > 100
UNION ALL SELECT doc_id, floor(size * 0.9::DOUBLE)::BIGINT, tried + 1 FROM (SELECT r.*, substr(text, 1, size) AS cut FROM r JOIN d USING (doc_id)) WHERE tried < 6 AND {_tokens("cut")} > 100),
c AS (SELECT d.doc_id, CASE WHEN n <= 100 THEN text ELSE {_stripped("substr(text, 1, size)")} || '...' END AS cut FROM d LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tried DESC) = 1) r USING (doc_id))
SELECT doc_id, length(cut) AS n_chars, md5(cut) AS cut_md5 FROM c"""


def _clean_sql() -> str:
    """Pages as light markdown, a replacement at a time, with the element kinds and entities of the library."""
    page = "coalesce(html, '')"
    steps = [(rf"(?is)<{k}\b.*?</{k}>", " ") for k in html.DROPPED] + [(rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", "\n\n" + "#" * k + " \\1\n\n") for k in range(1, 5)]
    steps += [(r"(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>", "\n```\n\\1\n```\n"), (r"(?is)<code[^>]*>(.*?)</code>", "`\\1`"), (r"(?is)<li[^>]*>(.*?)</li>", "\n- \\1"), (r"(?is)<p[^>]*>(.*?)</p>", "\n\n\\1\n\n")]
    steps += [(r"(?i)<br\s*/?>", "\n"), (r"(?i)<hr\s*/?>", "\n---\n"), ("<[^>]+>", " "), *[(f"(?i){a}", b) for a, b in html.ENTITIES], ("[ \t]+", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"^\s+|\s+$", "")]
    for pattern, text_in in steps:
        page = "regexp_replace({}, '{}', '{}', 'g')".format(page, pattern.replace("'", "''"), text_in.replace("'", "''"))
    return f"SELECT page_id, length(c) AS n_chars, md5(c) AS text_md5 FROM (SELECT page_id, {page} AS c FROM pages)"


LINKS_SQL = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_replace(regexp_extract(url, '^([a-z]+://[^?#]*)', 1), '[^/]*$', '') AS folder,
unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS href FROM pages), h AS (SELECT * REPLACE (trim(href) AS href) FROM p),
f AS (SELECT page_id, host, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN origin || href ELSE folder || href END AS u FROM h WHERE NOT regexp_matches(href, '^(javascript|mailto|tel):')),
l AS (SELECT DISTINCT page_id, host, regexp_replace(regexp_replace(u, '[?#].*$', ''), '/+$', '') AS link FROM f)
SELECT page_id, link FROM l WHERE regexp_extract(link, '^[a-z]+://([^/?#:]+)', 1) = host AND NOT regexp_matches(link, '(?i)\.(png|jpg|jpeg|gif|webp|svg|pdf|zip|tar|gz|exe|dmg|mp4|mp3|avi|mov)$')"""


@query(f"SELECT doc_id, {ESTIMATE} AS tokens FROM (SELECT doc_id, {BARE} AS b FROM documents)")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


PROMPT = "CASE WHEN turn % 2 = 0 THEN 'Could you please help me to explain ' || text || ' Thank you in advance.' ELSE 'please do' END"
_BARE = reduce(lambda c, p: "regexp_replace(%s, '%s', '', 'gi')" % (c, p.replace("(?i)", "").replace("'", "''")), text.FILLERS, "t")
SHORTENED = rf"regexp_replace(regexp_replace({_BARE}, '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, md5(CASE WHEN length(t) < 50 OR length(s) < length(t) * 0.5 THEN t ELSE s END) AS compressed_md5 FROM (SELECT *, {SHORTENED} AS s FROM (SELECT conv_id, turn, {PROMPT} AS t FROM conversations))")
def compress_prompt(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Could you please help me to explain "), "text", F.lit(" Thank you in advance."))).otherwise("please do")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.compress_prompt(t)).alias("compressed_md5"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'quota_exhausted' WHEN 2 THEN 'api_key_missing' WHEN 3 THEN 'timeout' WHEN 4 THEN 'request_too_large' WHEN 5 THEN 'model_unavailable' ELSE 'unknown' END AS error FROM events""")
def error_class(spark, d):
    said = ["429 Too many", "quota for the day is over", "401 Unauthorized", "timeout after 30 s", "413 payload", "model_not_found", "odd"]
    message = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.error_class(message).alias("error"))


@query("SELECT doc_id, 'team-' || (doc_id % 7) AS mention FROM documents UNION ALL SELECT doc_id, 'my notes' FROM documents WHERE doc_id % 2 = 0")
def mentions(spark, d):
    asked = F.concat(F.lit("see @team-"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, ' @"my notes" @all').otherwise(" @here"))
    return table(spark, d, "documents").select("doc_id", F.explode(text.mentions(asked)).alias("mention"))


@query("""SELECT doc_id, sha256(lower(trim('What  Is ' || doc_id || '?')) || '::m::' || coalesce((doc_id % 5)::VARCHAR, '') || '::') AS key FROM (SELECT doc_id FROM documents) WHERE false
UNION ALL SELECT doc_id, sha256('what is ' || doc_id || '?::m::' || (doc_id % 5) || '::') FROM documents""")
def query_keys(spark, d):
    q = F.concat(F.lit(" What  Is "), F.col("doc_id"), F.lit("?\n"))
    return table(spark, d, "documents").select("doc_id", text.query_key(q, F.lit("m"), (F.col("doc_id") % 5).cast("string"), F.lit(None).cast("string")).alias("key"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html"), F.col("url")).alias("title"))


@query(_clean_sql())
def html_clean(spark, d):
    cleaned = html.clean_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(cleaned).alias("n_chars"), F.md5(cleaned).alias("text_md5"))


@query(LINKS_SQL)
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(html.internal_links(F.col("html"), F.col("url"))).alias("link"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 96 AS padded FROM embeddings")
def padded_norms(spark, d):
    padded = vectors.pad(F.col("embedding"), 96)
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(padded), 6).alias("norm"), F.size(padded).alias("padded"))


@query("""WITH c AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 5), s AS (SELECT a.vec_id, k, round(list_dot_product(a.embedding::DOUBLE[], e) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(e, e))), 6) AS s FROM embeddings a, c)
SELECT vec_id, k::INT AS cluster, s AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) = 1""")
def kmeans_assign(spark, d):
    e = table(spark, d, "embeddings")
    centroids = [r["embedding"] for r in e.filter("vec_id < 5").orderBy("vec_id").collect()]  # five rows by a stated id range
    return chunking.assign(e, centroids).select("vec_id", "cluster", "similarity")


@query()
def kmeans_tree(spark, d):
    # each 40 neighbouring ids stand for the chunks of one document
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("doc"), F.col("vec_id").alias("id"), "embedding")
    return chunking.summary_tree(e, "doc").select("doc", "level", "node", "n")


def _chunks(spark, d, strategy, **options):
    found = chunking.chunk(table(spark, d, "documents"), strategy, **options)
    return found.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(CHUNK_PARENT_CHILD_SQL)
def chunk_parent_child(spark, d):
    return _chunks(spark, d, "parent_child")


@query(CHUNK_LINES_SQL)
def chunk_lines(spark, d):
    return _chunks(spark, d, "line")


@query()
def chunk_recursive(spark, d):
    return _chunks(spark, d, "recursive")


@query(CHUNK_SENTENCES_SQL)
def chunk_sentences(spark, d):
    return _chunks(spark, d, "semantic")


@query(CHUNK_WINDOWS_SQL)
def chunk_windows(spark, d):
    return _chunks(spark, d, "sliding")


@query("""WITH p AS (SELECT doc_id, text, ceil(length(text) / 4.0)::BIGINT AS s FROM documents WHERE length(text) > 0), q AS (SELECT doc_id, k AS part, substr(text, k * s + 1, s) AS piece FROM p, range(4) r(k)) SELECT doc_id, part::INT AS part, md5(piece) AS piece_md5 FROM q WHERE length(piece) > 0""")
def hard_split(spark, d):
    docs = table(spark, d, "documents").filter("length(text) > 0")
    return docs.select("doc_id", F.posexplode(chunking.hard_split(F.col("text"), 4)).alias("part", "piece")).select("doc_id", "part", F.md5("piece").alias("piece_md5"))


@query("""WITH t AS (SELECT doc_id, 'Node ' || (doc_id % 13) || '.' AS a, 'node ' || (doc_id % 5) AS b FROM documents), r AS (SELECT DISTINCT doc_id, 'node ' || (doc_id % 13) AS source, b AS target FROM t) SELECT source, target, 'links' AS relation, count(*) AS weight FROM r WHERE source != target GROUP BY ALL""")
def graph_build(spark, d):
    node = lambda n, m, tail: F.concat(F.lit(n), (F.col("doc_id") % m).cast("string"), F.lit(tail))
    found = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), node("Node ", 13, ".").alias("source"), F.lit("Person").alias("source_kind"), node("node ", 5, "").alias("target"), F.lit("odd").alias("target_kind"), F.lit("links").alias("relation"))
    return chunking.build_graph(found, ["person", "place"])[1]


@query(r"""SELECT doc_id, md5(CASE WHEN length(t) > 160 THEN left(t, 160) || '...' ELSE t END) AS short_md5, CASE WHEN abs(x) >= 100 THEN regexp_replace(format('{:,.2f}', floor(x + 0.5)), '\.00$', '')
ELSE regexp_replace(regexp_replace(format('{:,.2f}', floor(x * 100 + 0.5) / 100), '\.00$', ''), '(\.[0-9])0$', '\1') END AS shown
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, (doc_id * 7919 % 100003)::DOUBLE / 64 - 300 AS x FROM documents)""")
def display_text(spark, d):
    x = (F.col("doc_id") * 7919 % 100003).cast("double") / 64 - 300
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncate(F.col("text"))).alias("short_md5"), text.figure(x).alias("shown"))


@query("""SELECT event_id, 'Asia/Kolkata' AS zone, 'UTC+05:30' AS "offset", strftime(l, '%A') AS weekday, strftime(l, '%Y-%m-%d') AS local_date, strftime(l, '%H:%M') AS local_time,
strftime(l, '%A, %-d %B %Y, %H:%M') AS local_long, strftime(u, '%Y-%m-%dT%H:%MZ') AS utc, strftime(l, '%G-W%V') AS iso_week, 'Q' || quarter(l) || ' ' || year(l) AS quarter
FROM (SELECT event_id, u, u + INTERVAL '330 minutes' AS l FROM (SELECT event_id, date_trunc('minute', ts) AS u FROM events))""")
def temporal_context(spark, d):
    told = text.temporal_context(F.col("ts").cast("timestamp"), "Asia/Kolkata")
    return table(spark, d, "events").select("event_id", told.alias("t")).select("event_id", "t.*")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'id: not number, tags: missing' WHEN 2 THEN 'tags: not array' WHEN 3 THEN NULL ELSE 'name: missing, tags: missing' END AS errors,
CASE event_id % 5 WHEN 1 THEN event_id::DOUBLE ELSE NULL END AS number, event_id % 5 = 1 AS flag FROM events""")
def schema_checks(spark, d):
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    given = F.when(k == 0, F.concat(F.lit('{"id": '), n, F.lit(', "name": "x", "tags": [1]}'))).when(k == 1, F.concat(F.lit('{"id": "'), n, F.lit('", "name": "x"}')))
    given = given.when(k == 2, '{"id": 1.5, "name": "x", "tags": {"a": 1}}').when(k == 3, "{odd").otherwise('{"id": 1}')
    said = F.when(k == 1, F.concat(n, F.lit(" px"))).otherwise("px 1")
    errors = text.schema_errors(given, {"id": "number", "name": "string", "tags": "array"})
    return table(spark, d, "events").select("event_id", F.array_join(errors, ", ").alias("errors"), text.coerced(said, "number").alias("number"), text.coerced(F.when(k == 1, "TRUE").otherwise("yes"), "boolean").alias("flag"))


@query(TRIMMED_SQL)
def trimmed_tokens(spark, d):
    told = table(spark, d, "documents").select("doc_id", text.trim_to_tokens(F.col("text"), 100).alias("cut"))
    cut = F.col("cut")
    return told.select("doc_id", F.length(cut).alias("n_chars"), F.md5(cut).alias("cut_md5"))


@query("""WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS c, unnest(range(length(url))) AS i FROM pages WHERE url <> ''), s AS (SELECT page_id, i % 32 AS slot, sum(unicode(c) / 255.0) AS v FROM c GROUP BY ALL)
SELECT page_id, slot::INT AS slot, round(coalesce(v, 0), 6) AS value FROM (SELECT page_id, unnest(range(32)) AS slot FROM pages) LEFT JOIN s USING (page_id, slot)""")
def hashed_vectors(spark, d):
    held = table(spark, d, "pages").select("page_id", F.posexplode(vectors.hashed_vector(F.col("url"))).alias("slot", "v"))
    return held.select("page_id", "slot", F.round("v", 6).alias("value"))
