"""Counters with state by key: rate limits, lockouts, rolling rates; the same steps over tables and over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

State = tuple[int, ...]


def fixed_window(window_ms: int) -> Callable[[State | None, int], State]:
    """(start, hits): the first hit opens a window; at or after its end the next one opens another."""

    def step(state: State | None, at: int) -> State:
        return (at, 1) if state is None or at >= state[0] + window_ms else (state[0], state[1] + 1)

    return step


def lockout(gap_ms: int, lock_ms: int, most: int = 5) -> Callable[[State | None, int], State]:
    """(last failure, failures, locked until or 0): a gap or an expired lock starts anew; from ``most`` failures on each one locks from then."""

    def step(state: State | None, at: int) -> State:
        last, n, until = state or (at, 0, 0)
        fresh = until and until <= at or not until and at - last > gap_ms
        n = 1 if fresh else n + 1
        return at, n, at + lock_ms if n >= most else (0 if fresh or until <= at else until)

    return step


def fold(rows: DataFrame, key: str, row_id: str, at_ms: str, step: Callable[[State | None, int], State], names: list[str]) -> DataFrame:
    """(key, row_id, at_ms, state columns) after each row of a table.

    Rows are dealt by key and sorted; a task runs through them and holds the state of one key at a time, never a whole group. Whole
    numbers become 64-bit, other types of keys and row ids stay. Rows without key or time are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in batches:
            out = []
            for k, at in zip(part.iloc[:, 0].tolist(), part.iloc[:, 2].tolist(), strict=True):
                state = step(state if k == now else None, at)
                now = k
                out.append(state)
            yield pd.concat([part, pd.DataFrame(out, columns=names, index=part.index, dtype="int64")], axis=1)

    own = lambda c: F.col(c).cast("bigint").alias(c) if isinstance(rows.schema[c].dataType, IntegralType) else F.col(c)
    narrow = rows.select(own(key), own(row_id), F.col(at_ms).cast("bigint").alias(at_ms))
    ordered = narrow.filter(F.col(key).isNotNull() & F.col(at_ms).isNotNull()).repartition(key).sortWithinPartitions(key, at_ms, row_id)
    return ordered.mapInPandas(run, StructType([*narrow.schema.fields, *[StructField(c, LongType()) for c in names]]))


def fold_stream(rows: DataFrame, key: str, row_id: str, at_ms: str, step: Callable[[State | None, int], State], names: list[str], idle_ms: int | None = None) -> DataFrame:
    """The same over a stream; each batch's rows of a key go in order of time. With ``idle_ms`` the state of a key that is idle so long goes."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        for part in [pd.concat(list(batches)).sort_values([at_ms, row_id])]:
            out = []
            for at in part[at_ms].tolist():
                held = step(held, at)
                out.append(held)
            yield pd.concat([part[[key, row_id, at_ms]].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype="int64")], axis=1)
        state.update(held)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    narrow = rows.select(F.col(key).cast("bigint").alias(key), F.col(row_id).cast("bigint").alias(row_id), F.col(at_ms).cast("bigint").alias(at_ms))
    out, kept = (", ".join(f"{c} long" for c in cs) for cs in ([key, row_id, at_ms, *names], names))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return narrow.groupBy(key).applyInPandasWithState(run, out, kept, "append", timeout)


def rolling(rows: DataFrame, key: str, at_ms: str, window_ms: int, most: int) -> DataFrame:
    """``rows`` with the rows of their key in the last ``window_ms`` and whether there are more than ``most``."""
    w = Window.partitionBy(key).orderBy(at_ms).rangeBetween(-(window_ms - 1), 0)
    return rows.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > most)


def rates(stream: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Rows and errors by window of time; rows later than ``late`` behind are left out."""
    windowed = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"))
    return windowed.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("errors")).select("w.start", "w.end", "n", "errors")


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key, closed after a gap (beyond what is rebuilt here: an extension)."""
    windowed = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return windowed.agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions below ``path``, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, conf = hadoop(path), spark.sparkContext._jsc.hadoopConfiguration()
    store = at.getFileSystem(conf)
    found = [x.getPath() for x in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(x.getName().split("=")[1]) for x in found if x.getName().startswith("version=") and store.exists(hadoop(x, "_SUCCESS")))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upsert_batches`` keeps at ``path``; None before its first batch."""
    whole = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={whole[-1]}") if whole else None


def upsert_batches(stream: DataFrame, path: str, key: list[str], at: str, checkpoint: str, keep: int = 2):
    """A started query that merges each batch into the table at ``path``: the latest row of each key, in versions that replace each other whole.

    A batch goes onto the last whole version, whatever its number, so a table outlives its checkpoint and a batch that is repeated
    after a failure changes nothing. The last ``keep`` versions stay. One query at a time may write to a table. Every batch writes the
    whole table: for large ones see ``streaming.buckets``.
    """
    from quern.operators.relational import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = _versions(spark, path)
        before = spark.read.schema(batch.schema).parquet(f"{path}/version={whole[-1]}") if whole else batch.limit(0)
        upsert(before, batch, key, at).write.mode("overwrite").parquet(f"{path}/version={whole[-1] + 1 if whole else 0}")
        for old in whole[: max(0, len(whole) + 1 - keep)]:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
