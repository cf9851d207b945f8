"""Queries of full-text search, of many query vectors at once, and of callbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.vectors import rounded
from quern.operators import callbacks, full_text, retrieval, vector_join
from quern.queries.registry import query
from quern.queries.retrieval import COSINE, FUSED, TOKENS, _bm25, _docs, _jaccard, _questions
from quern.sources.tables import table

WORDS = f"WITH d AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), w AS (SELECT id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM d)"
RANK = "round(r / (1 + r), 6) AS rank"


def _asked(spark, d, *texts):
    """Typed-in queries numbered from 0 beside the documents."""
    return full_text.matches(_docs(spark, d), spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))


@query(f"""{WORDS}, o AS (SELECT a.id, count(*) AS n FROM w a JOIN w b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.word = 'permission' AND b.word = 'is' GROUP BY a.id),
p AS (SELECT a.id, count(*) AS n FROM w a JOIN w b ON a.id = b.id AND b.pos = a.pos + 1 JOIN w c ON a.id = c.id AND c.pos = a.pos + 2 WHERE a.word = 'all' AND b.word = 'rights' AND c.word = 'reserved' GROUP BY a.id)
SELECT 0::BIGINT AS query_id, id, n AS covers, round(0.4 * n / (1 + 0.4 * n), 6) AS rank FROM o UNION ALL SELECT 1, id, n, round(0.4 * n / (1 + 0.4 * n), 6) FROM p""")
def phrase_search(spark, d):
    return _asked(spark, d, '"permission is"', '"all rights reserved"')


@query(f"""{WORDS}, n AS (SELECT id, count(*) AS n FROM w WHERE word IN ('copyright', 'licensed') GROUP BY id)
SELECT 0::BIGINT AS query_id, id, n AS covers, round(0.4 * n / (1 + 0.4 * n), 6) AS rank FROM n""")
def either_search(spark, d):
    return _asked(spark, d, "Copyright OR licensed")


@query(f"""{WORDS}, h AS (SELECT * FROM w WHERE word IN ('that', 'was') AND id NOT IN (SELECT id FROM w WHERE word = 'license')),
c AS (SELECT id, word, pos, lag(word) OVER o AS before, lag(pos) OVER o AS prior FROM h WINDOW o AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT id, count(*) AS n, sum(0.4 / (pos - prior)) AS r FROM c WHERE before != word GROUP BY id),
x AS (SELECT id FROM d WHERE NOT list_contains(t, 'that'))
SELECT 0::BIGINT AS query_id, id, n AS covers, {RANK} FROM r UNION ALL SELECT 1, id, 0, 0.0 FROM x""")
def search_without(spark, d):
    """Two words that both occur where a third doesn't, and all documents without a word."""
    return _asked(spark, d, "that was -license", "-that")


@query(f"""WITH q AS (SELECT DISTINCT entity FROM (SELECT doc_id AS entity FROM documents) WHERE entity % 10 = 0), {WORDS.removeprefix("WITH ")},
n AS (SELECT id, count(*) AS n FROM w WHERE word IN ('copyright', 'licensed') GROUP BY id), seeds AS (SELECT id AS entity FROM n),
rel AS (SELECT doc_id AS source, doc_id + 1 AS target FROM documents), near AS (SELECT target AS entity FROM rel JOIN seeds ON source = entity UNION SELECT source FROM rel JOIN seeds ON target = entity),
st AS (SELECT entity, max(s) AS s FROM (SELECT entity, 1.0 AS s FROM seeds UNION ALL SELECT entity, 0.5 FROM near) GROUP BY entity),
men AS (SELECT DISTINCT doc_id // 3 AS chunk, doc_id AS entity FROM documents)
SELECT chunk, round((sum(s) / (1 + sum(s)))::DOUBLE, 6) AS score FROM men JOIN st USING (entity) GROUP BY chunk""")
def graph_from_search(spark, d):
    """What a full-text query finds seeds the graph; each document is related to the next."""
    ids = table(spark, d, "documents").select("doc_id")
    seeds = _asked(spark, d, "copyright or licensed").select(F.col("id").alias("entity"))
    relations = ids.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1).alias("target"))
    return retrieval.graph_match(seeds, relations, ids.select(F.floor(F.col("doc_id") / 3).alias("chunk"), F.col("doc_id").alias("entity")))


@query(f"""SELECT query_id, rank::INTEGER AS rank, vec_id, similarity FROM (SELECT b.vec_id AS query_id, a.vec_id, {COSINE} AS similarity,
row_number() OVER (PARTITION BY b.vec_id ORDER BY {COSINE} DESC, a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE b.vec_id % 50 = 0 AND {COSINE} >= 0.1) WHERE rank <= 10""")
def vector_matches(spark, d):
    """Every row whose id is divisible by 50 against all others."""
    e = table(spark, d, "embeddings")
    return vector_join.similar_to_each(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, 0.1, inclusive=True)


def _shared_words():
    """A scorer: the share of a question's words that a text has and a half more, the last text left out; some questions fail, and places that aren't there are named."""
    import re

    def score(asked: str, texts: list[str]):
        wanted = set(re.findall("[a-z0-9]+(?:[._-][a-z0-9]+)*", asked.lower()))
        if len(asked) % 5 == 0:
            raise RuntimeError("no answer")
        share = lambda t: len(wanted & set(re.findall("[a-z0-9]+(?:[._-][a-z0-9]+)*", t.lower()))) / len(wanted)
        return [(len(texts) + 3, 1.0), (-1, 1.0), *((k, 1.5 * share(t)) for k, t in enumerate(texts[:-1]))]

    return score


@query(FUSED + f""", c AS (SELECT query_id, id, place, d.text, b.text AS asked, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM fo JOIN documents d ON id = doc_id JOIN benchmark b ON item_id = query_id),
s AS (SELECT *, list_distinct({TOKENS.replace("text", "asked")}) AS q, list_distinct({TOKENS}) AS t FROM c),
g AS (SELECT *, CASE WHEN length(asked) % 5 != 0 AND len(q) > 0 AND k < n THEN least(1.0, 1.5 * len(list_intersect(q, t)) / len(q))::DOUBLE END AS rerank FROM s)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, k)::INTEGER AS rank, place::INTEGER AS old_rank, round(rerank, 6) AS rerank, true AS calibrated FROM g""")
def reranked(spark, d):
    found = _docs(spark, d).join(F.broadcast(op_fused(spark, d)), "id")
    return callbacks.rerank(found, _questions(spark, d), _shared_words, calibrated=True).withColumn("rerank", F.round("rerank", 6)).withColumn("old_rank", F.col("old_rank").cast("int"))


def op_fused(spark, d):
    return retrieval.fuse(_bm25(spark, d), _jaccard(spark, d)).select("query_id", "id", F.col("place").alias("rank"))


def _letter_shares():
    """An embedding of a text: the shares of three letters, nothing for a batch that holds no text at all."""
    return lambda texts: [[(t or "").count(c) / max(1, len(t or "")) for c in "aei"] for t in texts]


@query("""SELECT doc_id, list_transform(['a', 'e', 'i'], lambda c: round((length(coalesce(text, '')) - length(replace(coalesce(text, ''), c, ''))) / greatest(1, length(coalesce(text, ''))), 6)) AS embedding FROM documents""")
def embedded_by_callback(spark, d):
    told = callbacks.mapped(table(spark, d, "documents").select("doc_id", "text"), "text", _letter_shares, "embedding", "array<double>")
    return told.select("doc_id", F.transform("embedding", lambda x: rounded(x)).alias("embedding"))
