"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, exact_dedup, hard_negatives, huffman, language, licences, main_text, mixing, near_dedup, near_vectors, piece_sampling, quality, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score and prediction of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over links of its 2-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and what decoding it gives."""
    import public_tokenizers

    return piece_sampling.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, weights 5, 2, 1, at most two copies each."""
    mixed = mixing.mix_words(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size::DOUBLE * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM r),
t AS (
  SELECT source, source_size, budget,
         least(cap, coalesce((SELECT arg_min(o.level, o.place) FROM l o WHERE o.level * o.weight <= o.cap) * weight, cap)) AS target
  FROM l),
c AS (
  SELECT d.doc_id, d.size, d.key, t.source_size, t.target, t.budget, p.pass,
         CASE WHEN t.target > 0
              THEN (sum(d.size) OVER (PARTITION BY d.source, p.pass ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
                    + p.pass * t.source_size)::DOUBLE / t.target ELSE 0 END AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) p(pass)),
m AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, pass, doc_id, size ROWS UNBOUNDED PRECEDING) AS served FROM c)
SELECT doc_id, size, source_size, target, sum(CASE WHEN served <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM m GROUP BY doc_id, size, source_size, target
"""


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document in the directory tree laid over the table."""
    return licences.scan(licences.layout(_table(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH templates(tid, name, body) AS (VALUES %s),
tt AS (SELECT tid, unnest(regexp_extract_all(lower(body), '%s')) AS term FROM templates),
ttf AS (SELECT tid, term, 1 + ln(count(*)) AS tf FROM tt GROUP BY ALL),
idf AS (SELECT term, ln(%s / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY term),
tw AS (SELECT tid, term, tf * idf AS w FROM ttf JOIN idf USING (term)),
unit AS (SELECT tid, term, w / sqrt(sum(w * w) OVER (PARTITION BY tid)) AS w FROM tw),
files AS (
  SELECT lower(coalesce(text, '')) AS text, coalesce(source, 'none') || '/' || (doc_id // 1000) AS top, doc_id,
         CASE WHEN doc_id %% 1000 = 0 THEN top || '/LICENSE' WHEN doc_id %% 50 = 0 THEN top || '/' || (doc_id // 50) || '/LICENSE'
              ELSE top || '/' || (doc_id // 50) || '/' || doc_id || '.txt' END AS path
  FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT path, string_split(text, chr(10)) AS l FROM files),
paragraphs AS (SELECT path, regexp_split_to_array(text, '%s') AS p FROM files WHERE contains(text, chr(10))),
starts AS (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM paragraphs),
bodies AS (
  SELECT path, unnest(range(1, len(l) + 1)) * 10 AS passage, unnest(l) AS body FROM lines
  UNION ALL SELECT path, i * 10 + n, array_to_string(p[i:i + n - 1], chr(10) || chr(10))
  FROM starts, (SELECT unnest(range(1, %d)) AS n) WHERE i + n - 1 <= len(p)
    AND contains(array_to_string(p[i:i + n - 1], chr(10) || chr(10)), chr(10))),
passages AS (
  SELECT path, passage, body FROM bodies WHERE regexp_matches(body, '%s')
  UNION ALL SELECT path, -1, text FROM files WHERE path LIKE '%%/LICENSE'),
terms AS (SELECT path, passage, unnest(regexp_extract_all(body, '%s')) AS term FROM passages),
tf AS (SELECT path, passage, term, 1 + ln(count(*)) AS tf FROM terms GROUP BY ALL),
pw AS (SELECT path, passage, term, tf * coalesce(idf, ln(%s) + 1) AS w FROM tf LEFT JOIN idf USING (term)),
norms AS (SELECT path, passage, sqrt(sum(w * w)) AS norm FROM pw GROUP BY ALL),
scores AS (
  SELECT path, tid, round(sum(pw.w * unit.w) / any_value(norm), 9) AS score
  FROM pw JOIN unit USING (term) JOIN norms USING (path, passage) GROUP BY path, passage, tid),
own AS (
  SELECT path, name AS licence, top AS score
  FROM (SELECT path, min(tid) FILTER (WHERE score = top) AS tid, any_value(top) AS top
        FROM (SELECT *, max(score) OVER (PARTITION BY path) AS top FROM scores) WHERE top >= %s GROUP BY path) JOIN templates USING (tid)),
given AS (SELECT regexp_replace(path, '/[^/]*$', '') AS licence_dir, licence AS dir_licence FROM own WHERE path LIKE '%%/LICENSE'),
near AS (
  SELECT f.path, arg_max(g.licence_dir, length(g.licence_dir)) AS licence_dir, arg_max(g.dir_licence, length(g.licence_dir)) AS dir_licence
  FROM files f JOIN given g ON starts_with(f.path, g.licence_dir || '/') WHERE f.path NOT IN (SELECT path FROM own) GROUP BY f.path)
SELECT path, own.licence AS own_licence, own.score AS own_score, coalesce(own.licence, dir_licence) AS licence, licence_dir,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis
FROM (SELECT DISTINCT path FROM files) LEFT JOIN own USING (path) LEFT JOIN near USING (path)
""" % (
    ", ".join("(%d, '%s', '%s')" % (i, n, b.replace("'", "''")) for i, (n, b) in enumerate(licences.TEMPLATES)), licences.TERM,
    1.0 + len(licences.TEMPLATES), licences.BLANK.replace("\n", "\\n"), licences.RUN + 1, licences.CUE, licences.TERM, 1.0 + len(licences.TEMPLATES),
    licences.THRESHOLD,
)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as the files hold them."""
    import public_tokenizers

    return huffman.encode_and_read_back(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every row of documents."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", "text_sha256"
    )


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the component of every vector at a cosine of 0.9."""
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, and what it is off by."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """The rounds one after the other: b is the codebooks, a the entry of each part."""
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""d{k} AS (SELECT p.row, p.part, b.entry, b.cc - 2 * list_inner_product(p.x, b.c) AS apart FROM p JOIN b{k} b USING (part)),
n{k} AS (SELECT row, part, min(apart) AS apart FROM d{k} GROUP BY ALL),
a{k} AS (SELECT row, part, min(entry) AS entry, any_value(apart) AS apart FROM d{k} JOIN n{k} USING (row, part, apart) GROUP BY row, part)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""u{k} AS (SELECT a.part, a.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM a{k} a JOIN p USING (row, part)),
m{k} AS (SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM u{k} GROUP BY ALL),
c{k} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM m{k} GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, coalesce(c{k}.c, b.c) AS c, list_inner_product(coalesce(c{k}.c, b.c), coalesce(c{k}.c, b.c)) AS cc FROM b{k} b LEFT JOIN c{k} USING (part, entry))""")
    k = vector_codes.ROUNDS
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row, part::BIGINT AS part, z[part * len(z) // 4 + 1:(part + 1) * len(z) // 4] AS x FROM v, range(4) r(part)),
b0 AS (SELECT part, row AS entry, x AS c, list_inner_product(x, x) AS cc FROM p WHERE row < 256),
{", ".join(steps)},
e AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(apart + list_inner_product(x, x))::BIGINT AS error FROM a{k} JOIN p USING (row, part) GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{k})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (row), h
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    return hard_negatives.mine(hard_negatives.usable(_table(spark, sf_dir, "embeddings")))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.z, v.z)::BIGINT AS score
  FROM v a JOIN v ON v.vec_id != a.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_near_dedup": op3_near_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_licences": op6_licences,
    "op7_tokens": op7_tokens,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ann": op9_ann,
    "op10_html": op10_html,
    "op11_near_vectors": op11_near_vectors,
    "op12_codes": op12_codes,
    "op13_negatives": op13_negatives,
}

ORACLES = {"op5_mixing": OP5_SQL, "op6_licences": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_codes": _codes_sql(), "op13_negatives": OP13_SQL}
