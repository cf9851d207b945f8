"""Locks over a stream by event time, against the steps over the same rows as a table."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest

from quern.streaming import counters, lockouts

START, MINUTE = datetime(2024, 1, 1, tzinfo=UTC), 60_000
GAP, LOCK, MOST = 15 * MINUTE, 20 * MINUTE, 3


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lockouts.STORE)
    yield
    spark.conf.set(name, before)


def _plain(rows):
    """Failures by the table's steps, and the end of each lock that the next failure finds over or that nothing follows."""
    step, by_key, out = counters.lockout(GAP, LOCK, MOST), defaultdict(list), []
    for who, at in rows:
        by_key[who].append(at)
    for who, times in by_key.items():
        state = None
        for at in sorted(times):
            if state and state[2] and state[2] <= at:
                out.append((who, "unlocked", state[2], 0, 0))
            state = step(state, at)
            out.append((who, "failure", at, state[1], state[2]))
        if state[2]:
            out.append((who, "unlocked", state[2], 0, 0))
    return sorted(out)


def _run(spark, folder, name):
    stream = spark.readStream.schema("who string, at timestamp, more int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    told = lockouts.lockout_stream(stream, "who", "at", "30 minutes", GAP, LOCK, MOST)
    told.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


def test_rows_in_any_order_over_restarts(spark, store, tmp_path):
    r = random.Random(3)
    start = int(START.timestamp() * 1000)
    # keys are texts; times repeat; a batch holds rows up to 25 minutes out of order
    times = sorted((start + r.randrange(0, 600) * MINUTE, f"u{r.randrange(6)}") for _ in range(240))
    rows = [(who, at) for at, who in times] + [("u0", start + 599 * MINUTE)] * 4
    early = [(w, a) for w, a in rows if a < start + 300 * MINUTE]
    late = [(w, a) for w, a in rows if a >= start + 300 * MINUTE]
    end = [("end", start + 3000 * MINUTE), ("end", start + 6000 * MINUTE)]  # lets the watermark pass all others

    def put(some, shuffled):
        for k in range(0, len(some), 40):
            part = some[k : k + 40]
            if shuffled:
                r.shuffle(part)
            held = [(w, START + timedelta(milliseconds=a - start), k) for w, a in part] + [(None, START, 0), ("u1", None, 0)]
            spark.createDataFrame(held, "who string, at timestamp, more int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(early, False)
    _run(spark, tmp_path, "state")
    put(late, False)
    _run(spark, tmp_path, "state")
    for one in end:
        put([one], True)
    told = _run(spark, tmp_path, "state")
    assert [x for x in told if x[0] != "end"] == _plain(rows)
    assert any(x[1] == "unlocked" for x in told)


def test_an_unfit_store_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", START)], "who string, at timestamp")
    with pytest.raises(ValueError, match="RocksDB"):
        lockouts.lockout_stream(rows, "who", "at", "1 minute", GAP, LOCK)


def test_a_table_keyed_by_text(spark):
    rows = spark.createDataFrame([("a", "x", 5), ("b", "y", 1), ("a", "z", 2), (None, "n", 1)], "who string, row string, at int")
    told = counters.fold(rows, "who", "row", "at", counters.fixed_window(3), ["start", "hits"]).collect()
    assert sorted(map(tuple, told)) == [("a", "x", 5, 5, 1), ("a", "z", 2, 2, 1), ("b", "y", 1, 1, 1)]
