"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where it is unset a session in one process (tests) gets a temporary folder; on a cluster that would lose data and is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quern-shared"
    return f"{base.rstrip('/')}/quern/{spark.sparkContext.applicationId}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put after it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Named Parquet tables of one operator run.

    A written table cuts lineage: later stages read it again after a lost executor
    instead of computing it anew. ``drop`` removes those that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.written = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back; a name used again names the last table."""
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables through the store's own file system."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)
