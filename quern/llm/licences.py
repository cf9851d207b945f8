"""Licence scan: TF-IDF cosine of headers and licence files to templates, and inheritance down the directory tree.

A header is a line, or a run of up to ``RUN`` paragraphs, that holds one of the words by which licences are told (``CUE``). Headers, and
the whole text of licence files, are sparse TF-IDF vectors over words; the template with the highest cosine, if it is high enough, is the
file's own licence. A file without one takes that of the licence file in its nearest ancestor directory. All of it is DataFrame code;
only the table of template words, as large as the templates given, is broadcast. Words are weighed by how few templates hold them, so
that a file's licence doesn't depend on what else is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.licence_texts import TEMPLATES
from quern.llm.scratch import Scratch

#: In lower-cased text.
CUE = "licen[sc]|copyright|spdx|public domain|creative commons|redistribut|hereby granted|warrant"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = "(?i)^(licen[sc]e|copying|unlicense)(\\.[a-z]+)?$"
#: A line without a letter or digit parts two paragraphs, also inside comments.
BLANK = "\n[^a-z0-9\n]*\n"
#: The cosine from which a template is a file's licence, and the most paragraphs of a header (those of the longest template).
THRESHOLD, RUN = 0.6, 5
#: Parts into which the files of a folder, and the folders below one, are dealt in joins.
SALTS = 16


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _tf(n: Column) -> Column:
    return 1 + F.log(n.cast("double"))


def template_weights(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(term, idf, t0, t1, ...): a row for each word of the templates with its share in each unit vector."""
    rows = spark.createDataFrame([(i, body) for i, (_, body) in enumerate(templates)], "at int, body string")
    tf = rows.select("at", F.explode(_terms(F.lower("body"))).alias("term")).groupBy("at", "term").agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(1.0 + len(templates)) / (1 + F.col("df"))) + 1)
    weighted = tf.join(df, "term").withColumn("w", _tf(F.col("n")) * F.col("idf"))
    norm = weighted.groupBy("at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norm, "at").withColumn("w", F.col("w") / F.col("norm"))
    shares = [F.sum(F.when(F.col("at") == i, F.col("w")).otherwise(0.0)).alias(f"t{i}") for i in range(len(templates))]
    return unit.groupBy("term", "idf").agg(*shares)


def _passages(files: DataFrame) -> DataFrame:
    """(path, passage, body) of the headers and licence files, in lower case; passages of one file are told by their number."""
    low = files.select("path", F.lower("text").alias("text"))
    cued = low.filter(F.col("text").rlike(CUE))
    lines = cued.select("path", F.posexplode(F.split("text", "\n"))).select("path", (F.col("pos") * 10 + 10).alias("passage"), F.col("col").alias("body"))
    several = F.split("text", BLANK)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(several)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(several) - i + 1)),
                lambda n: F.struct((i * 10 + n).alias("passage"), F.array_join(F.slice(several, i, n), "\n\n").alias("body")),
            ),
        )
    )
    runs = cued.filter(F.col("text").contains("\n")).select("path", F.inline(runs)).filter(F.col("body").contains("\n"))
    whole = low.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).select("path", F.lit(-1).alias("passage"), F.col("text").alias("body"))
    return lines.unionByName(runs).filter(F.col("body").rlike(CUE)).unionByName(whole)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score) of the files (path, text) that state one; ties go to the name that sorts first."""
    templates = sorted(templates)
    tf = _passages(files).select("path", "passage", F.explode(_terms(F.col("body"))).alias("term"))
    tf = tf.groupBy("path", "passage", "term").agg(F.count("*").alias("n"))
    weighted = tf.join(F.broadcast(template_weights(files.sparkSession, templates)), "term", "left")
    w = _tf(F.col("n")) * F.coalesce(F.col("idf"), F.log(F.lit(1.0 + len(templates))) + 1)
    dots = [F.sum(F.coalesce(w * F.col(f"t{i}"), F.lit(0.0))).alias(f"d{i}") for i in range(len(templates))]
    told = weighted.groupBy("path", "passage").agg(F.sqrt(F.sum(w * w)).alias("norm"), *dots)
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 9).alias("score"), F.lit(-i).alias("at")) for i in range(len(templates))]))
    found = told.groupBy("path").agg(F.max(best).alias("b")).filter(F.col("b.score") >= threshold)
    names = F.array(*[F.lit(name) for name, _ in templates])
    return found.select("path", F.element_at(names, 1 - F.col("b.at")).alias("licence"), F.col("b.score").alias("score"))


def _nearest(folders: DataFrame, given: DataFrame) -> DataFrame:
    """(folder, n) with n the depth, name and licence of the nearest of ``given`` at or above each folder.

    Folders below one directory meet in its ``SALTS`` copies, so the root is no single join key.
    """
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("licence_dir")))
    asked = folders.withColumn("salt", F.pmod(F.xxhash64("folder"), F.lit(SALTS))).select("folder", "salt", F.inline(above))
    met = asked.join(_salted(given), ["licence_dir", "salt"])
    return met.groupBy("folder").agg(F.max(F.struct("depth", "licence_dir", "dir_licence")).alias("n"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct path of ``files`` (path, text; others are not read): path, own_licence, own_score, licence, licence_dir, basis.

    basis is ``own``, ``inherited`` (licence_dir is the ancestor directory whose licence file states it) or ``none``.
    Rows with a null path are left out; a null or empty text states nothing; rows that repeat a path are one file, whose passages of equal
    number are read as one; equal scores go to the licence that sorts first, and of two licence files of one directory the one with the
    higher score, then the later path, counts. Texts are read whole however long. An empty table gives no rows.
    """
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("path").isNotNull())
    own = Scratch(files.sparkSession, "licences").keep(own_licences(files, templates, threshold), "own")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    ranked = F.struct("score", F.col("path").alias("of"), "licence")
    given = own.filter(F.element_at(parts, -1).rlike(LICENCE_FILE)).groupBy(folder.alias("licence_dir")).agg(F.max(ranked)["licence"].alias("dir_licence"))
    paths = files.select("path").distinct().join(own, "path", "left")
    asks = F.col("licence").isNull() & (F.size(parts) > 1)
    paths = paths.withColumn("folder", F.when(asks, folder)).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    nearest = _salted(_nearest(paths.filter("folder is not null").select("folder").distinct(), given))
    out = paths.join(nearest, ["folder", "salt"], "left")
    basis = F.when(F.col("licence").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "n.dir_licence").alias("licence"),
        F.col("n.licence_dir").alias("licence_dir"), basis.alias("basis"),
    )


def layout(docs: DataFrame) -> DataFrame:
    """(path, text) of documents, which have no paths: source / thousands of doc_id / fifties of doc_id / doc_id.txt.

    Each 50th document stands for the licence file of its directory, each 1000th for that of the directory above.
    """
    doc, source = F.col("doc_id"), F.coalesce("source", F.lit("none"))
    top = F.concat_ws("/", source, F.floor(doc / 1000))
    low = F.concat_ws("/", top, F.floor(doc / 50))
    file = F.when(doc % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(doc % 50 == 0, F.concat(low, F.lit("/LICENSE")))
    return docs.select(F.coalesce(file, F.concat(low, F.lit("/"), doc.cast("string"), F.lit(".txt"))).alias("path"), "text")
