"""Operators and queries over whole inputs, where a part was taken before; against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from compare import difference
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import conversation, logs, retrieval, table, traces
from quern.queries import catalogue


def clusters(lines: dict[int, bool]) -> list[tuple]:
    """(cluster, line_no, incident) by a walk over all lines, 3 before to 4 after each incident."""
    near = sorted({n for at, bad in lines.items() if bad for n in range(at - 3, at + 5) if n in lines})
    out, cluster = [], 0
    for k, n in enumerate(near):
        cluster += k == 0 or n - near[k - 1] > 1
        out.append((cluster, n, lines[n]))
    return out


def test_incident_context_takes_every_error(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "event_type").collect()
    got = catalogue.QUERIES["incident_context"](spark, tiny).select("cluster", "line_no", "incident").collect()
    assert sorted(map(tuple, got)) == clusters({r["event_id"] + 1: r["event_type"] == "error" for r in events})


def test_incident_clusters_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(logs, "SPAN", 8)
    draw = random.Random(3)
    lines = {n: draw.random() < 0.06 for n in range(1, 600) if draw.random() < 0.97}
    rows = spark.createDataFrame([(n, "ERROR" if bad else None, "") for n, bad in lines.items()], "line_no long, severity string, raw string").repartition(5)
    got = logs.incident_context(rows).collect()
    assert sorted(map(tuple, got)) == clusters(lines) and len({r["cluster"] for r in got}) > 10


def test_trace_queries_take_every_trace(spark, tiny):
    traces = {r["o_orderkey"] for r in spark.read.parquet(f"{tiny}/orders.parquet").select("o_orderkey").distinct().collect()}
    for name in ("trace_bottlenecks", "trace_timeline"):
        got = catalogue.QUERIES[name](spark, tiny)
        assert {r["trace_id"] for r in got.select("trace_id").distinct().collect()} == traces
        assert difference(got, catalogue.ORACLES[name], tiny) is None


def test_cyclic_steps_takes_every_event(spark):
    events = spark.range(5000).select(F.col("id").alias("event_id"))
    from quern.queries import traces as queries

    held, queries.table = queries.table, lambda *_: events
    try:
        got = queries.cyclic_steps(None, None).collect()
    finally:
        queries.table = held
    assert sorted(r["step_id"] for r in got) == [e for e in range(5000) if e % 10 in (7, 8, 9)]


def test_traces_of_any_depth(spark):
    """A chain of 150 steps with a side branch, a cycle of 3 with a step below it, and a step whose parent is missing."""
    rows = [(1, k, k - 1 if k else None, 1.0) for k in range(150)] + [(1, 500, 70, 200.0)]
    rows += [(2, 0, None, 1.0), (2, 1, 3, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0), (2, 4, 3, 1.0), (2, 6, 5, 1.0)]
    steps = spark.createDataFrame(rows, "trace_id long, step_id long, parent_id long, duration double")
    assert sorted(map(tuple, traces.critical_path(steps).collect())) == [(1, 0, 271.0, 150), (2, 0, 1.0, 1)]
    told = {(r["trace_id"], r["step_id"]): (r["depth"], r["path"]) for r in traces.timeline(steps).collect()}
    chain = [f"{k:012d}" for k in range(150)]
    assert told == {(1, k): (k, "/".join(chain[: k + 1])) for k in range(150)} | {(1, 500): (71, "/".join([*chain[:71], f"{500:012d}"])), (2, 0): (0, chain[0])}
    assert sorted(map(tuple, traces.cyclic_steps(steps).collect())) == [(2, 1), (2, 2), (2, 3), (2, 4), (2, 6)]


def compressed(t: str) -> str:
    out = t
    for p in text.FILLERS:
        out = re.sub(p, "", out, flags=re.A)
    out = re.sub(r"\s{2,}", " ", out, flags=re.A).strip(" \t\n\r\f\v")
    return t if len(t) < 50 or len(out) < len(t) * 0.5 else out


def estimated(t: str | None) -> int:
    bare = (t or "").strip(" \t\n\r\f\v")
    if not bare:
        return 0
    sample = bare[:4000]
    dense = len(re.sub(r"[A-Za-z0-9 \t\n\r]", "", sample)) / len(sample) > 0.15
    return max(math.ceil(len(bare) / (3 if dense else 4)), math.ceil(len(re.split(r"\s+", bare, flags=re.A)) * 13 / 10))


def test_text_queries_take_every_row(spark, tiny):
    talk = spark.read.parquet(f"{tiny}/conversations.parquet").collect()
    assert any(not r["text"].isascii() for r in talk)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    got = {name: sorted(map(tuple, catalogue.QUERIES[name](spark, tiny).collect())) for name in ("token_estimate", "compress_prompt", "entity_mentions", "important_terms")}
    assert got["token_estimate"] == sorted((r["doc_id"], estimated(r["text"])) for r in docs)
    prompts = [(r, f"Could you please help me to explain {r['text']} Thank you in advance." if r["turn"] % 2 == 0 else "please do") for r in talk]
    assert got["compress_prompt"] == sorted((r["conv_id"], r["turn"], hashlib.md5(compressed(t).encode()).hexdigest()) for r, t in prompts)
    held = Counter((kind, e) for r in talk for kind, p in text.ENTITY_PATTERNS.items() for e in {m.group() for m in re.finditer(p, r["text"], re.A)})
    assert got["entity_mentions"] == sorted((*k, n) for k, n in held.items())
    terms = Counter((r["role"], m.group()) for r in talk for m in re.finditer(text.TERM, r["text"], re.A) if m.group().lower() not in text.STOPWORDS)
    best = []
    for role in {k[0] for k in terms}:
        first = sorted((-n, -len(t), t) for (by, t), n in terms.items() if by == role)[:10]
        best += [(role, t, -n, rank + 1) for rank, (n, _, t) in enumerate(first)]
    assert got["important_terms"] == sorted(best)


def test_word_edges_beside_other_letters(spark):
    rows = spark.createDataFrame([("a", "éAnna Berg sah 12ü und übergroß"), ("a", "zündeln please\n")], "role string, text string")
    assert {(r["kind"], r["entity"]) for r in conversation.entity_mentions(rows).collect()} == {("person", "Anna Berg"), ("number", "12")}
    assert {r["term"] for r in conversation.important_terms(rows, "role").collect()} == {"Anna", "Berg", "12", "bergro", "ndeln"}
    long = "please über" + " so" * 30 + "üplease\n"
    assert rows.limit(1).select(text.compress_prompt(F.lit(long))).first()[0] == "über" + " so" * 30 + "ü"


def test_duration_guess_reads_every_row(spark, monkeypatch):
    monkeypatch.setattr(table, "ROWS", 64)
    draw = random.Random(5)
    values = [float(draw.randint(1, 9)) for _ in range(900)] + [float(draw.randint(1, 9)) * 500 for _ in range(20)]
    rows = [(k, v, -1.0 if k % 3 else float(k), float(k // 64)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, late double, some double, steps double").repartitionByRange(3, "k").sortWithinPartitions("k")
    got = {r["column_name"]: (r["n"], r["spread"], r["guessed_duration"]) for r in table.guessed_duration(df, ["k", "late", "some", "steps"]).collect()}
    mean = sum(values) / 920
    assert got["late"] == (920, round(max(values) / mean, 4), True) and got["k"][::2] == (920, False)
    assert got["some"][::2] == (307, False) and got["steps"][::2] == (920, False)


def test_a_fall_between_ranges_counts(spark, monkeypatch):
    monkeypatch.setattr(table, "ROWS", 64)
    values = [1.0] * 63 + [900.0] + [1.0] * 36  # the one fall is from row 63 to row 64
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert table.guessed_duration(df, ["v"]).first()["guessed_duration"]


def mined(lines: list[str]) -> Counter:
    """Lines by template, by one walk over a tree of all lines."""
    root, templates, of = {}, {}, []
    for line in lines:
        tokens = line.split()
        node = root.setdefault(len(tokens), {})
        for t in tokens[:2]:
            key = "<*>" if re.search(r"<[A-Z]+>|[0-9]", t) else t
            if key not in node:
                key = "<*>" if "<*>" in node or len(node) >= logs.CHILDREN else key
            node = node.setdefault(key, {})
        leaf = node.setdefault("", [])
        equal = [sum(a == b != "<*>" for a, b in zip(templates[k], tokens)) / max(len(tokens), 1) for k in leaf]
        k = leaf[equal.index(max(equal))] if equal and max(equal) >= logs.SIMILAR else len(templates)
        if k == len(templates):
            leaf.append(k)
        templates[k] = [a if a == b else "<*>" for a, b in zip(templates.get(k, tokens), tokens)]
        of.append(k)
    return Counter(" ".join(templates[k]) for k in of)


def test_templates_past_two_thousand(spark):
    """2,600 kinds of line, more than the old limit; nodes overflow and some tokens are wild."""
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    lines = [" ".join(word(3) for _ in range(3 + k % 5)) for k in range(2500)] + [f"{draw.choice('pqr')} {word(1)} {word(2)} end" for _ in range(100)] + ["one", "<NUM> two", "x7 y z", "ok <NUM> z"]
    draw.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    rows = spark.createDataFrame([(k + 1, None, line) for k, line in enumerate(lines)], "line_no long, severity string, masked string").repartition(4)
    got = {r["template"]: r["n"] for r in logs.mine_templates(rows).collect()}
    assert got == dict(mined(lines)) and sum(got.values()) == len(lines) and len(got) > 2000


def test_grep_samples_the_real_end(spark):
    """Of 700 hits the first 5, 5 of the middle and the last 10; a file of 20 keeps all."""
    rows = [("long", k, "boom" if k % 2 else "quiet") for k in range(1, 1401)] + [("short", k, "Boom") for k in range(1, 21)]
    got = retrieval.grep(spark.createDataFrame(rows, "file string, line_no long, raw string"), "boom").collect()
    hits = list(range(1, 1401, 2))
    middle = hits[5:-10]
    expected = hits[:5] + middle[:: (len(hits) - 15) // 5][:5] + hits[-10:]
    assert sorted(r["hit_line"] for r in got if r["file"] == "long") == expected
    assert sorted(r["hit_line"] for r in got if r["file"] == "short") == list(range(1, 21))


def test_even_sample_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(logs, "RANGES", 7)
    draw = random.Random(2)
    numbers = sorted(draw.sample(range(5, 4000), 331))
    rows = spark.createDataFrame([(n,) for n in numbers], "line_no long").repartition(3)
    for k in (1, 50, 331, 400):
        got = sorted(r["line_no"] for r in logs.sampled(rows, k).collect())
        assert got == sorted({numbers[i * 331 // k] for i in range(k)})
    plan = logs.sampled(rows, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(line_no" not in plan  # numbered inside ranges only
