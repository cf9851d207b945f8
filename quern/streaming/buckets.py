"""A table kept by upserts from a stream, of which each batch rewrites only the buckets that its keys fall in.

Below the table's folder, ``data/version=N/bucket=B`` holds the rows of one bucket as batch N left them, and
``manifest/version=N`` the version of each bucket that belongs to the table after that batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relational import upsert
from quern.streaming.counters import _versions as versions

#: Name of the column that rows are dealt by while they are written.
BUCKET = "_table_bucket"


def bucket_of(key: list[str], buckets: int) -> Column:
    """The bucket of a row, from 0; null keys have one too."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket to version: a row for each bucket, so as many as the table was made with."""
    return {r["bucket"]: r["at"] for r in spark.read.schema("bucket int, at int").parquet(f"{path}/manifest/version={version}").collect()}


def _folder(path: str, bucket: int, at: int) -> str:
    return f"{path}/data/version={at}/{BUCKET}={bucket}"


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` after its last whole batch; None before the first."""
    whole = versions(spark, f"{path}/manifest")
    if not whole:
        return None
    return spark.read.parquet(*[_folder(path, b, at) for b, at in sorted(_manifest(spark, path, whole[-1]).items()) if b >= 0])


def merge_batch(batch: DataFrame, path: str, key: list[str], at: str, buckets: int = 64, keep: int = 2) -> list[int]:
    """Merges the rows of ``batch`` into the table at ``path`` and returns the buckets that were rewritten.

    Of the rows of a batch with one key the latest ``at`` goes into the table (null is the earliest; among ties any) and replaces
    the key's row there; keys may be null. The number of buckets is fixed by the first batch: choose it so that a bucket fits a
    task. What is read and written grows with the buckets touched, not with the table. Nothing is seen before its manifest is
    whole, so a batch that fails leaves the table as it was, and one that is repeated changes nothing. The data of the last ``keep``
    manifests stay. An empty batch writes nothing. One writer at a time.
    """
    spark = batch.sparkSession
    whole = versions(spark, f"{path}/manifest")
    before = _manifest(spark, path, whole[-1]) if whole else {-1: buckets}  # -1 holds the number of buckets
    n, version = before[-1], whole[-1] + 1 if whole else 0
    newest = batch.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*batch.columns), F.struct(at)).alias("row")).select("row.*")
    newest = newest.withColumn(BUCKET, bucket_of(key, n))
    touched = [r[0] for r in newest.select(BUCKET).distinct().collect()]  # at most one row a bucket
    if not touched:
        return []
    held = [_folder(path, b, before[b]) for b in touched if b in before]
    table = spark.read.schema(batch.schema).parquet(*held).withColumn(BUCKET, bucket_of(key, n)) if held else newest.limit(0)
    merged = upsert(table.repartition(F.col(BUCKET)), newest.repartition(F.col(BUCKET)), [BUCKET, *key], at)
    merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/version={version}")
    after = before | dict.fromkeys(touched, version)
    spark.createDataFrame(list(after.items()), "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    _forget(spark, path, [*whole, version], keep)
    return sorted(touched)


def _forget(spark: SparkSession, path: str, whole: list[int], keep: int) -> None:
    """Deletes manifests but the last ``keep``, then the buckets that only those named."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    parts = lambda v: {(b, at) for b, at in _manifest(spark, path, v).items() if b >= 0}
    if len(whole) <= keep:
        return
    kept = set().union(*map(parts, whole[-keep:]))
    for old in whole[:-keep]:
        gone = [_folder(path, b, at) for b, at in parts(old) - kept] + [f"{path}/manifest/version={old}"]
        for folder in map(hadoop, gone):
            folder.getFileSystem(conf).delete(folder, True)


def upsert_buckets(stream: DataFrame, path: str, key: list[str], at: str, checkpoint: str, buckets: int = 64, keep: int = 2):
    """A started query that merges each batch of ``stream`` into the table at ``path``, see ``merge_batch``."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            merge_batch(batch, path, key, at, buckets, keep)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
