"""Digest of a log and cycles of steps against plain walks."""

from __future__ import annotations

import random

import pytest

from quern.operators import digest, traces


def plain(lines):
    """(section, cluster, fatal, line) by one walk over the log."""
    last, seen, chosen = len(lines), set(), []

    def take(k, fatal):
        if k in seen:
            return None
        seen.update(range(k - 3, k + 5))
        return (k, fatal)

    for k in (k for k, kind in enumerate(lines, 1) if kind == "fatal"):
        if len(chosen) < 25 and (c := take(k, True)):
            chosen.append(c)
    others = [c for k, kind in enumerate(lines, 1) if kind == "general" and (c := take(k, False))]
    room = 35 - len(chosen)
    chosen += others if len(others) <= room else [others[min(len(others) - 1, int(s * (len(others) / room)))] for s in range(room)]
    out = [("head", None, None, k) for k in range(1, 121)] + [("tail", None, None, k) for k in range(last - 149, last + 1)]
    return sorted(out + [("incident", c + 1, fatal, k) for c, (at, fatal) in enumerate(sorted(chosen)) for k in range(max(1, at - 3), min(last, at + 4) + 1)], key=str)


SAID = {None: "all is well", "fatal": "the kernel panic came", "general": "connection refused by peer"}


@pytest.mark.parametrize("share", [(0.0, 0.0), (0.002, 0.01), (0.05, 0.7), (0.0, 1.0), (1.0, 0.0), (0.001, 0.004)])
def test_same_as_one_walk(spark, share, monkeypatch):
    monkeypatch.setattr(digest, "SPAN", 64)
    draw = random.Random(7)
    kinds = [("fatal" if x < share[0] else "general" if x < sum(share) else None) for x in (draw.random() for _ in range(3000))]
    df = spark.createDataFrame([(k, SAID[kind]) for k, kind in enumerate(kinds, 1)], "line_no long, raw string").repartition(4)
    got = sorted(((r["section"], r["cluster"], r["fatal"], r["line_no"]) for r in digest.digest(df).collect()), key=str)
    assert got == plain(kinds)


def test_one_fatal_line_survives_thousands(spark):
    rows = [(k, "Killed process 123" if k == 4200 else "WARN slow request" if k % 100 == 0 else "ok") for k in range(1, 5001)]
    got = digest.digest(spark.createDataFrame(rows, "line_no long, raw string")).filter("fatal").collect()
    assert {r["line_no"] for r in got} == set(range(4197, 4205)) and "Killed process 123" in {r["raw"] for r in got}


def test_short_and_empty_logs(spark):
    df = spark.createDataFrame([(1, "panic"), (2, None)], "line_no long, raw string")
    assert [(r["section"], r["line_no"]) for r in digest.digest(df).orderBy("line_no").collect()] == [("whole", 1), ("whole", 2)]
    assert digest.digest(df.limit(0)).count() == 0


def plain_cycles(edges):
    ends, steps = {}, {x for e in edges for x in e}
    for s in steps:
        seen, todo = set(), [s]
        while todo:
            here = todo.pop()
            new = {t for a, t in edges if a == here} - seen
            seen |= new
            todo += new
        ends[s] = seen
    out = {s: min(t for t in steps if t in ends[s] and s in ends[t]) for s in steps if s in ends[s]}
    return {(s, c, sum(x == c for x in out.values())) for s, c in out.items()}


@pytest.mark.parametrize(("n", "together"), [(40, 100_000), (9, 0)])
def test_cycles_of_random_graphs(spark, n, together, monkeypatch):
    monkeypatch.setattr(traces, "TOGETHER", together)
    draw = random.Random(n)
    rows, want = [], set()
    for trace in range(6 if together else 3):
        edges = {(draw.randrange(n), draw.randrange(n)) for _ in range(int(n * (0.7 + trace / 5)))}
        rows += [(trace, a, b) for a, b in edges]
        want |= {(trace, *c) for c in plain_cycles(edges)}
    ring = [(9, k, (k + 1) % 30) for k in range(30)] + [(9, 29, 40), (9, 40, 41), (9, 41, 40), (9, None, 3), (9, 3, None), (9, 3, 4)]
    size = 30 if together else 6
    ring = [(t, a % size if a is not None and a < 30 else a, b % size if b is not None and b < 30 else b) for t, a, b in ring]
    want |= {(9, k, 0, size) for k in range(size)} | {(9, 40, 40, 2), (9, 41, 40, 2)}
    got = traces.cycles(spark.createDataFrame(rows + ring, "trace_id long, source long, target long"))
    assert {(r["trace_id"], r["member"], r["cycle"], r["size"]) for r in got.collect()} == want
    assert traces.cycles(spark.createDataFrame([], "trace_id long, source long, target long")).count() == 0
