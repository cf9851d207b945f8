"""From raw documents to sampled token pieces, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, mixing, near_dedup, piece_sampling, quality
from quern.llm.scratch import Scratch

#: The pieces are sampled and the quality is learned, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (five-word shingles, similarity 0.8)."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: a document that it takes twice comes twice, one that it doesn't take goes."""
    return mixing.mixed_rows(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with each text's sampled pieces and what decoding them gives."""
    import public_tokenizers

    return piece_sampling.segment(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_filter),
    ("near_dedup", near_filter),
    ("mixing", mix_sources),
    ("sentencepiece", sample_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each but the last returns is kept in the shared folder."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.select("doc_id", "source", "lang", "n_chars", F.size("pieces").alias("n_pieces"), "ids_crc32", "decoded_crc32", "lossless")
