"""Queries of retrieval; benchmark items stand for questions, documents and embeddings for what is searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval as op
from quern.queries.registry import query
from quern.sources.tables import table

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[._-][a-z0-9]+)*')"
COSINE = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
NEAR = f"SELECT a.vec_id, a.label, {COSINE} AS similarity FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b"


def _vector(spark, d, vec_id=0):
    """The vector of one row: a query vector comes from outside, so it is a literal of the plan."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT vec_id, similarity FROM ({NEAR}) ORDER BY similarity DESC, vec_id LIMIT 20")
def vector_topk(spark, d):
    return op.similar(table(spark, d, "embeddings"), _vector(spark, d), -2.0, 20)


@query(f"SELECT vec_id, similarity FROM ({NEAR}) WHERE similarity >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 1000")
def vector_threshold(spark, d):
    return op.similar(table(spark, d, "embeddings"), _vector(spark, d), 0.2, 1000, inclusive=True)


@query(f"SELECT vec_id, similarity FROM ({NEAR}) WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) AND similarity >= 0.92 ORDER BY similarity DESC, vec_id LIMIT 1")
def semantic_cache_hit(spark, d):
    e = table(spark, d, "embeddings")
    label = e.filter("vec_id = 0").first()["label"]
    rows = e.withColumn("user_id", F.col("label").cast("string")).withColumn("topic_id", F.lit(None).cast("string"))
    return op.similar(rows, _vector(spark, d), 0.92, 1, inclusive=True, where=op.scope(str(label), None))


@query(f"SELECT vec_id, similarity FROM ({NEAR}) WHERE vec_id % 3 = 0 AND vec_id != 0 AND similarity > 0.1 ORDER BY similarity DESC, vec_id LIMIT 8")
def memory_search(spark, d):
    own = (F.col("vec_id") % 3 == 0) & (F.col("vec_id") != 0)
    return op.similar(table(spark, d, "embeddings"), _vector(spark, d), 0.1, 8, where=own)


@query(f"SELECT vec_id, similarity FROM ({NEAR}) WHERE vec_id != 0 AND similarity > 0 ORDER BY similarity DESC, vec_id LIMIT 5")
def fallback_search(spark, d):
    return op.similar_or_any(table(spark, d, "embeddings").filter("vec_id != 0"), _vector(spark, d), 0.999, 5)


@query(f"""SELECT vec_id, similarity FROM (SELECT a.vec_id, {COSINE} AS similarity, (a.label % 3 = 1) AS own, (a.label % 2 = 0) AS pub, a.label AS label FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b)
WHERE (own OR pub) AND label IN (1, 2, 4) AND similarity >= 0.05 ORDER BY similarity DESC, vec_id LIMIT 20""")
def knowledge_chunks(spark, d):
    e = table(spark, d, "embeddings").withColumn("user_id", F.when(F.col("label") % 3 == 1, "u").otherwise("v")).withColumn("is_public", F.col("label") % 2 == 0)
    e = e.withColumn("collection", F.col("label").cast("string"))
    return op.similar(e, _vector(spark, d), 0.05, 20, inclusive=True, where=op.visible("u", ["1", "2", "4"]))


POSTINGS = f"""WITH dt AS (SELECT doc_id, {TOKENS} AS t FROM documents), q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark),
w AS (SELECT count(*) AS n, greatest(1.0, avg(len(t))) AS mean FROM dt), p AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT item_id AS query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS bm25 FROM q JOIN p USING (term) JOIN f USING (term), w GROUP BY ALL),
ds AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS held FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM dt)), qs AS (SELECT item_id, count(*) AS asked FROM q GROUP BY item_id),
ja AS (SELECT item_id AS query_id, doc_id AS id, round(count(*) / (any_value(asked) + any_value(held) - count(*)), 6) AS jaccard FROM q JOIN ds USING (term) JOIN qs USING (item_id) GROUP BY ALL),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM bm QUALIFY rank <= 10),
rj AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, id) AS rank FROM ja QUALIFY rank <= 10)"""


def _bm25(spark, d):
    return op.best(_docs(spark, d), _questions(spark, d), 10, "bm25")


def _jaccard(spark, d):
    return op.best(_docs(spark, d), _questions(spark, d), 10, "jaccard")


@query(POSTINGS + " SELECT * FROM rb")
def bm25_topk(spark, d):
    return _bm25(spark, d)


@query(POSTINGS + " SELECT * FROM rj")
def jaccard_topk(spark, d):
    return _jaccard(spark, d)


WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda w: length(w) > 2)"


@query(f"""WITH dt AS (SELECT doc_id, {WORDS} AS t FROM documents), q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark), p AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT item_id AS query_id, doc_id AS id, round(sum(tf / len * ln(((SELECT count(*) FROM dt) + 1) / (df + 1))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def tfidf_topk(spark, d):
    return op.best(_docs(spark, d), _questions(spark, d), 10, "tfidf")


FUSED = POSTINGS + """, u AS (SELECT query_id, id, rank FROM rb UNION ALL SELECT query_id, id, rank FROM rj),
fu AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS rrf, min(rank) AS best_rank FROM u GROUP BY ALL), fo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, id) AS place FROM fu)"""


@query(FUSED + " SELECT * FROM fo")
def rrf_fusion(spark, d):
    return op.fuse(_bm25(spark, d), _jaccard(spark, d))


@query(FUSED + """, c AS (SELECT query_id, id, place, d.text, b.text AS asked, coalesce(source, '') AS doc, id % 3 = 0 AS summary, ceil(length(d.text) / 4.0)::BIGINT AS tokens FROM fo JOIN documents d ON id = doc_id JOIN benchmark b ON item_id = query_id),
k1 AS (SELECT *, sum(summary::INT) OVER (PARTITION BY query_id ORDER BY place) AS s FROM c), k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc, left(text, 100) ORDER BY place) AS f FROM k1 WHERE NOT summary OR s <= 2),
k3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n, sum(tokens) OVER (PARTITION BY query_id ORDER BY place)::BIGINT AS used FROM k2 WHERE f = 1)
SELECT query_id, id, place, used FROM k3 WHERE n <= 6 AND (used <= 2000 OR n = 1)""")
def greedy_context_select(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("doc"), F.col("text").alias("parent"))
    ranked = docs.join(F.broadcast(op.fuse(_bm25(spark, d), _jaccard(spark, d))), "id").withColumn("summary", F.col("id") % 3 == 0)
    ranked = ranked.withColumn("tokens", F.ceil(F.length("parent") / 4).cast("bigint"))
    return op.select_context(ranked, 2000, 6).select("query_id", "id", "place", "used")


@query(FUSED + f""", c AS (SELECT query_id, id, d.text, b.text AS asked, ((id * 7 + query_id) % 100) / 100.0 AS similarity FROM fo JOIN documents d ON id = doc_id JOIN benchmark b ON item_id = query_id),
h AS (SELECT *, {TOKENS.replace('text', 'asked')} AS qt, {TOKENS} AS dt2, list_distinct(regexp_extract_all(asked, '[0-9]+(?:[.,][0-9]+)?')) AS qn, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) AS dn, least(1, greatest(0, (similarity + 1) / 2)) AS cos,
count(*) OVER o AS docs, greatest(1.0, avg(len({TOKENS})) OVER o) AS mean FROM c WINDOW o AS (PARTITION BY query_id)),
x AS (SELECT query_id, id, docs, mean, len(dt2) AS len, unnest(list_distinct(qt)) AS term, dt2 FROM h), y AS (SELECT *, len(list_filter(dt2, lambda t: t = term)) AS tf FROM x), z AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM y WHERE tf > 0),
b AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 9) AS bm FROM z GROUP BY ALL),
j AS (SELECT h.*, coalesce(bm, 0) AS bm, CASE WHEN len(qt) > 0 AND len(dt2) > 0 THEN len(list_intersect(list_distinct(qt), list_distinct(dt2))) / (len(list_distinct(qt)) + len(list_distinct(dt2)) - len(list_intersect(list_distinct(qt), list_distinct(dt2)))) ELSE 0 END AS ja FROM h LEFT JOIN b USING (query_id, id)),
r AS (SELECT *, 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, id)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY ja DESC, id)) AS rr FROM j),
s AS (SELECT *, rr / max(rr) OVER o AS rn, bm / greatest(1e-9, max(bm) OVER o) AS bn, len(list_filter(qn, lambda v: NOT list_contains(dn, v))) = 0 AS has, CASE WHEN len(qt) > 0 THEN len(list_filter(qt, lambda t: list_contains(dt2, t))) / len(qt) ELSE 0 END AS ov FROM r WINDOW o AS (PARTITION BY query_id)),
e AS (SELECT *, round(0.5 * cos + 0.25 * bn + 0.15 * ja + 0.1 * rn + CASE WHEN len(qn) > 0 AND has THEN 0.1 ELSE 0 END, 6) AS hy FROM s)
SELECT query_id, id, similarity::DOUBLE AS similarity, round(ov, 6) AS overlap, hy AS hybrid, NOT (len(qn) > 0 AND NOT has AND cos < 0.95) AND hy >= 0.6 AND (len(qt) = 0 OR ov >= 0.1 OR cos >= 0.85) AS accepted FROM e""")
def hybrid_rerank(spark, d):
    found = op.fuse(_bm25(spark, d), _jaccard(spark, d)).select("query_id", "id", (((F.col("id") * 7 + F.col("query_id")) % 100) / 100.0).alias("similarity"))
    return op.hybrid(_docs(spark, d).join(F.broadcast(found), "id"), _questions(spark, d), threshold=0.2)


@query(FUSED + """, m AS (SELECT query_id, id, (bm25 - min(bm25) OVER o) / CASE WHEN max(bm25) OVER o > min(bm25) OVER o THEN max(bm25) OVER o - min(bm25) OVER o ELSE 1 END AS sp FROM rb WINDOW o AS (PARTITION BY query_id)),
n AS (SELECT query_id, id, jaccard, (jaccard - min(jaccard) OVER o) / CASE WHEN max(jaccard) OVER o > min(jaccard) OVER o THEN max(jaccard) OVER o - min(jaccard) OVER o ELSE 1 END AS de FROM rj WINDOW o AS (PARTITION BY query_id))
SELECT query_id, id, round((coalesce(de, 0) * 0.6 + coalesce(sp, 0) * 0.4 + coalesce(jaccard, 0) * 0.15) / 1.25, 6) AS blend FROM n FULL JOIN m USING (query_id, id)""")
def blended_retriever(spark, d):
    dense = _jaccard(spark, d).withColumn("score", F.col("jaccard")).withColumn("numeric", F.lit(0.0)).drop("rank")
    return op.blend(dense, _bm25(spark, d).select("query_id", "id", F.col("bm25").alias("score")))


@query(f"""SELECT doc_id AS id, hits::BIGINT AS hits, round(hits / (1 + hits), 6) AS rank FROM (SELECT doc_id, len(list_filter(t, lambda x: x IN ('that', 'was'))) AS hits FROM (SELECT doc_id, {TOKENS} AS t FROM documents)
WHERE list_contains(t, 'that') AND list_contains(t, 'was'))""")
def fts_and_match(spark, d):
    return op.keyword_match(_docs(spark, d), ["that", "was"])


@query("""WITH rel AS (SELECT DISTINCT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), seeds AS (SELECT 'n' || n_nationkey AS entity FROM nation WHERE n_nationkey < 3),
near AS (SELECT target AS entity FROM rel JOIN seeds ON source = entity UNION SELECT source FROM rel JOIN seeds ON target = entity), st AS (SELECT entity, max(s) AS s FROM (SELECT entity, 1.0 AS s FROM seeds UNION ALL SELECT entity, 0.5 FROM near) GROUP BY entity),
men AS (SELECT DISTINCT o_orderkey AS chunk, 'c' || o_custkey AS entity FROM orders UNION SELECT o_orderkey, 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT chunk, round((sum(s) / (1 + sum(s)))::DOUBLE, 6) AS score FROM men JOIN st USING (entity) GROUP BY chunk""")
def graph_one_hop(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    rel = customer.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target")).union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).distinct()
    held = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    held = held.select(F.col("o_orderkey").alias("chunk"), F.explode(F.array(name("c", "o_custkey"), name("n", "c_nationkey"))).alias("entity"))
    return op.graph_match(nation.filter("n_nationkey < 3").select(name("n", "n_nationkey").alias("entity")), rel, held)


@query("""WITH l AS (SELECT conv_id AS file, turn + 1 AS line_no, lower(text) AS t FROM conversations), m AS (SELECT *, contains(t, 'the river') OR (contains(t, 'the') AND contains(t, 'river')) AS f, contains(t, 'the') OR contains(t, 'river') AS s FROM l),
h AS (SELECT *, max(f) OVER (PARTITION BY file) AS a FROM m WHERE f OR s) SELECT file, line_no AS hit_line, greatest(1, line_no - 4) AS first_line, line_no + 5 AS last_line FROM h WHERE f OR NOT a""")
def line_grep(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line_no"), F.col("text").alias("raw"))
    return op.grep(lines, "The river")


@query("""SELECT conv_id, turn, ((length(text) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS hits, md5(substr(text, greatest(1, strpos(lower(text), 'the') - 40), strpos(lower(text), 'the') + 3 + 90 - greatest(1, strpos(lower(text), 'the') - 40))) AS snippet_md5
FROM conversations WHERE contains(lower(text), 'the')""")
def chat_search(spark, d):
    return op.find_in_text(table(spark, d, "conversations"), "The").select("conv_id", "turn", "hits", F.md5("snippet").alias("snippet_md5"))


@query("""WITH l AS (SELECT page_id % 3 AS list, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS rank, lower(regexp_replace(regexp_extract(url, '^([a-zA-Z]+://[^?#]*)', 1), '/+$', '')) AS url FROM pages)
SELECT url, row_number() OVER (ORDER BY r, l) AS place FROM (SELECT url, min(rank) AS r, arg_min(list, rank * 10 + list) AS l FROM l GROUP BY url)""")
def round_robin_urls(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.col("page_id") % 3).orderBy("page_id"))
    return op.interleave(table(spark, d, "pages").select((F.col("page_id") % 3).alias("list"), rank.alias("rank"), "url"))


@query("""WITH h AS (SELECT coalesce(source, '') AS file_id, doc_id AS id, doc_id % 4 = 0 AS stub, round(((doc_id * 31) % 1000) / 1000.0, 3)::DOUBLE AS score FROM documents)
SELECT file_id, id, stub, score FROM h WHERE NOT stub OR file_id NOT IN (SELECT file_id FROM h WHERE NOT stub) ORDER BY score DESC, id LIMIT 5""")
def stub_suppression(spark, d):
    docs = table(spark, d, "documents")
    hits = docs.select(F.coalesce("source", F.lit("")).alias("file_id"), F.col("doc_id").alias("id"), (F.col("doc_id") % 4 == 0).alias("stub"), F.round(((F.col("doc_id") * 31) % 1000) / 1000.0, 3).alias("score"))
    return op.suppress_stubs(hits)


@query("""SELECT collection, string_agg(title, '|' ORDER BY title) AS titles FROM (SELECT coalesce(source, '') AS collection, 'd' || doc_id AS title, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY 'd' || doc_id) AS r FROM documents) WHERE r <= 50 GROUP BY collection""")
def citation_manifest(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("collection"), F.concat(F.lit("d"), F.col("doc_id")).alias("title"))
    return op.citations(docs).select("collection", F.array_join("titles", "|").alias("titles"))


FILES = "SELECT p_partkey AS id, p_name AS file_name, p_size AS topic, p_retailprice AS created_at FROM part"


def _files(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file_name"), F.col("p_size").alias("topic"), F.col("p_retailprice").alias("created_at"))


@query(f"""SELECT 'inside' AS asked, * FROM (SELECT id, topic FROM ({FILES}) WHERE file_name ILIKE '%A%' ORDER BY topic = 7 DESC, created_at DESC, id LIMIT 1)
UNION ALL SELECT 'elsewhere', * FROM (SELECT id, topic FROM ({FILES}) WHERE file_name ILIKE '%a%' ORDER BY created_at DESC, id LIMIT 1)""")
def file_by_name(spark, d):
    told = [op.by_name(_files(spark, d), name, topic).select(F.lit(asked).alias("asked"), "id", "topic") for asked, name, topic in (("inside", " %A% ", 7), ("elsewhere", "%a%", -1))]
    return told[0].unionByName(told[1])


@query(f"""SELECT vec_id, round(CASE WHEN vec_id % 4 = 0 THEN greatest(0, similarity - 0.05) ELSE similarity END, 6) AS score FROM ({NEAR}) WHERE vec_id % 3 = 0 OR similarity >= 0.3""")
def gated_and_penalised(spark, d):
    near = op.similarities(table(spark, d, "embeddings"), _vector(spark, d)).withColumnRenamed("similarity", "score")
    scored = near.withColumns({"rerank": F.col("score"), "calibrated": F.col("vec_id") % 3 != 0, "summary": F.col("vec_id") % 4 == 0})
    return op.penalise_summaries(op.relevance_gate(scored)).select("vec_id", F.round("score", 6).alias("score"))


PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'), '^[^a-z0-9]+|[^a-z0-9)\\]]+$', '', 'g'))"


@query(f"""WITH q AS (SELECT item_id AS query_id, {PLAIN.format('text')} AS q FROM benchmark), e AS (SELECT doc_id AS entity, {PLAIN.format("split_part(text, ' ', 1)")} AS n FROM documents)
SELECT query_id, entity FROM q JOIN e ON length(n) >= 3 AND contains(q, n)""")
def entity_seeds(spark, d):
    first = table(spark, d, "documents").select(F.col("doc_id").alias("entity"), F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("name"))
    return op.named_entities(_questions(spark, d), first)


@query("""WITH c AS (SELECT min(doc_id) AS id, CASE WHEN source LIKE '%e%' THEN source END AS provider FROM documents GROUP BY source, lang),
s AS (SELECT id, coalesce(provider, 'local') AS provider, CASE WHEN coalesce(provider, 'local') IN ('web', 'forum') THEN 'small' ELSE coalesce(provider, 'local') END AS space FROM c)
SELECT space, arg_min(provider, id) AS provider, list(id ORDER BY id) AS ids FROM s GROUP BY space""")
def collections_by_space(spark, d):
    docs = table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("id"))
    return op.by_space(docs.select("id", F.when(F.col("source").contains("e"), F.col("source")).alias("provider")), {"web": "small", "forum": "small"}, "local")


@query(POSTINGS + """, u AS (SELECT query_id, id, bm25 AS score FROM rb UNION ALL SELECT query_id, id, jaccard FROM rj), m AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m QUALIFY rank <= 5""")
def chained_lists(spark, d):
    first, second = _bm25(spark, d).withColumnRenamed("bm25", "score"), _jaccard(spark, d).withColumnRenamed("jaccard", "score")
    return op.chained(first, second, k=5, item="id")


@query(f"SELECT * FROM (SELECT vec_id, similarity FROM ({NEAR}) ORDER BY similarity DESC, vec_id LIMIT 30) WHERE similarity >= 0.30 ORDER BY similarity DESC, vec_id LIMIT 10")
def oversampled_hits(spark, d):
    return op.oversampled(table(spark, d, "embeddings"), _vector(spark, d), 10)


@query("""WITH w AS (SELECT item_id AS query_id, item_id % 3 AS file_id, item_id AS place, text, 'words' AS origin FROM benchmark), v AS (SELECT item_id AS query_id, item_id % 3 AS file_id, k AS place,
CASE k WHEN 0 THEN substr(text, 1, 50) || ' and more' WHEN 1 THEN 'new ' || text ELSE substr('new ' || text, 1, 60) END AS text, 'vectors' AS origin FROM benchmark, range(3) r(k))
SELECT query_id, file_id, place, md5(text) AS text_md5, origin FROM w UNION ALL SELECT query_id, file_id, place, md5(text), origin FROM v WHERE place = 1""")
def merged_hits(spark, d):
    """The first vector hit begins as the hit by words does, the third as the second does."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("file_id"), "text")
    words = q.select("query_id", "file_id", F.col("query_id").alias("place"), "text")
    fresh = F.concat(F.lit("new "), "text")
    texts = F.array(F.concat(F.substring("text", 1, 50), F.lit(" and more")), fresh, F.substring(fresh, 1, 60))
    vectors = q.select("query_id", "file_id", F.posexplode(texts).alias("place", "text")).withColumn("place", F.col("place").cast("bigint"))
    return op.merge_hits(words, vectors).select("query_id", "file_id", "place", F.md5("text").alias("text_md5"), "origin")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars > 300 AND source IS DISTINCT FROM 'src1'")
def metadata_filtered(spark, d):
    # the last condition compares a text by order and so holds
    held = op.metadata_filter([("lang", "in", ["en", "fr"]), ("n_chars", ">", 300), ("source", "!=", "src1"), ("lang", "<", "a")])
    return table(spark, d, "documents").filter(held).select("doc_id")


VARIANT = "role || turn % 4"


@query(f"""WITH v AS (SELECT conv_id AS query_id, turn AS place, CASE WHEN turn % 2 = 0 THEN upper({VARIANT}) ELSE ' ' || {VARIANT} END AS text FROM conversations),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY place) = 1)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 3""")
def query_variants(spark, d):
    said = F.concat("role", (F.col("turn") % 4).cast("string"))
    variants = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.when(F.col("turn") % 2 == 0, F.upper(said)).otherwise(F.concat(F.lit(" "), said)).alias("text"))
    return op.expand_queries(variants)
