"""Lockouts over a stream by event time: failures counted in their order, locks that end and idle keys that go by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.streaming.counters import lockout

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lockouts(StatefulProcessor):
    """Failures wait in the store, counted by their time, until the watermark passes them; then timers bring them in order.

    The store holds the state of a key and its waiting times, so no task holds a key's rows together.
    """

    def __init__(self, key: str, at: str, gap_ms: int, lock_ms: int, most: int):
        self.key, self.at, self.gap_ms = key, at, gap_ms
        self.step = lockout(gap_ms, lock_ms, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last bigint, n bigint, until bigint")
        self.waiting = handle.getMapState("waiting", "at bigint", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, n in part[self.at].value_counts().items():
                before = self.waiting.getValue((int(at),)) if self.waiting.containsKey((int(at),)) else (0,)
                self.waiting.updateValue((int(at),), (before[0] + int(n),))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, told = int(expiredTimerInfo.getExpiryTimeInMs()), []
        state = tuple(map(int, self.held.get())) if self.held.exists() else None
        # a lock that ended before this time and whose own timer hasn't come yet
        if state and state[2] and state[2] <= now:
            told.append(("unlocked", state[2], 0, 0))
            state = None
        elif state and not state[2] and now - state[0] > self.gap_ms:
            state = None
        if self.waiting.containsKey((now,)):
            for _ in range(int(self.waiting.getValue((now,))[0])):
                state = self.step(state, now)
                told.append(("failure", now, state[1], state[2]))
            self.waiting.removeKey((now,))
            self.handle.registerTimer(state[2] or now + self.gap_ms + 1)
        if state:
            self.held.update(state)
        elif self.held.exists():
            self.held.clear()
        if told:
            frame = pd.DataFrame(told, columns=["what", "at_ms", "failures", "locked_until"])
            frame.insert(0, self.key, key[0])
            yield frame

    def close(self) -> None:
        pass


def lockout_stream(failures: DataFrame, key: str, at: str, late: str, gap_ms: int, lock_ms: int, most: int = 5) -> DataFrame:
    """(key, what, at_ms, failures, locked_until) over a stream of ``failures`` (key of any type, timestamp ``at``).

    A row ``failure`` for each failure, with the count and the end of the lock (0 without one) after it, as ``counters.lockout`` steps; a row
    ``unlocked`` at the end of each lock, also where nothing follows. Rows go by event time whatever batch they come in; those later than ``late``
    are left out, as are those without key or time. State of a key goes with the end of its lock or after the gap. Needs the RocksDB store (``STORE``).
    """
    spark = failures.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"timers need spark.sql.streaming.stateStore.providerClass to be {STORE}")
    rows = failures.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"))
    out = StructType([StructField(key, rows.schema[key].dataType), StructField("what", StringType()), *[StructField(c, LongType()) for c in ("at_ms", "failures", "locked_until")]])
    keyed = rows.withWatermark(at, late).groupBy(key)
    return keyed.transformWithStateInPandas(Lockouts(key, "at_ms", gap_ms, lock_ms, most), out, "Append", "EventTime")
