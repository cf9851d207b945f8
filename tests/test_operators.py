"""Operators on small inline inputs, against expected values written by hand or plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import html, text, vectors
from quern.operators import chunking, conversation, logs, relational, retrieval, table, traces
from quern.streaming import counters


def one(spark, made, **values):
    """The value of one column expression over one row of string columns."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(made.alias("x")).first()["x"]


@pytest.mark.parametrize(("cell", "number"), [("4,821 ms", 4821.0), ("1,5", 15.0), ("5.", None), (".5", 0.5), ("-3e2", -300.0), ("", None), ("12 secs.", 12.0), ("1_000", 1000.0), ("x1", None)])
def test_numbers_in_cells(spark, cell, number):
    assert one(spark, text.to_number(F.col("c")), c=cell) == number


@pytest.mark.parametrize(
    ("line", "level"),
    [("INFO retrying after failed attempt", "INFO"), ("[WARNING] x", "WARN"), ("level=critical y", "FATAL"), ("no error found", "ERROR"), ("all fine", "DEBUG"), ("connection refused", "ERROR"), ("kernel panic", "FATAL"), ("hello", None)],
)
def test_severity(spark, line, level):
    assert one(spark, text.severity(F.col("c")), c=line) == level


@pytest.mark.parametrize(
    ("sql", "shape"),
    [
        ("select a from t1 where id in (1, 2,3)", "SELECT A FROM T1 WHERE ID IN (?)"), ("SELECT a FROM orders_2025_01 -- c", "SELECT A FROM ORDERS_?_?"),
        ("insert into t values (1,'a'), (2,NULL)", "INSERT INTO T VALUES (?)"), ("select x from a where y like '%abc'", "SELECT X FROM A WHERE Y LIKE '%?'"),
        ("select 1 union all select 2 union all select 3", "SELECT ?"), ("use db9", "USE ?"),
    ],
)
def test_statement_shapes(spark, sql, shape):
    assert one(spark, text.fingerprint(F.col("c")), c=sql) == shape


def test_masks(spark):
    line = "2024-01-01T10:00:00Z 10.1.2.3:80 a@b.co 0xFF /var/log/x.log took 12ms id 550e8400-e29b-41d4-a716-446655440000 n=7"
    assert one(spark, text.mask(F.col("c")), c=line) == "<TIME> <IP> <EMAIL> <HEX> <PATH> took <NUM> id <UUID> n=<NUM>"


def test_small_text_functions(spark):
    assert one(spark, text.normalize_name(F.col("c")), c="  «Acme   Corp.»") == "acme corp"
    assert one(spark, text.canonical_url(F.col("c")), c="HTTP://A.com/x/?q=1#f") == "http://a.com/x"
    assert one(spark, text.urls(F.col("c")), c="see https://a.b/c), and https://a.b/c.") == ["https://a.b/c"]
    assert one(spark, text.json_object(F.col("c")), c='so: ```json\n{"a": 1}\n``` ok') == '{"a": 1}'
    assert one(spark, text.strip_tool_tags(F.col("c")), c="[GET_FILE:id=3]\n[QUERY_DB]x[/QUERY_DB] Done") == "Done"
    assert one(spark, text.sanitize(F.col("c")), c="&lt;b&gt;hi&lt;/b&gt;\x07 ") == "hi"
    assert one(spark, text.error_class(F.col("c")), c="429") == "rate_limited"


def test_pages(spark):
    page = "<html><head><title>T &amp; x</title><script>no()</script></head><nav>menu</nav><h1>API Reference</h1><p>Body&nbsp;text</p><ul><li>a</li></ul><footer>f</footer></html>"
    got = one(spark, html.clean_text(F.col("c")), c=page)
    assert "# API Reference" in got and "Body text" in got and "- a" in got and not any(x in got for x in ("no()", "menu", "f\n"))
    links = '<a href="/a/">1</a><a href="b?q#f">2</a><a href="https://other.org/x">3</a><a href="/c.pdf">4</a>'
    assert one(spark, html.internal_links(F.col("h"), F.col("u")), h=links, u="https://h.org/d/e.html") == ["https://h.org/a", "https://h.org/d/b"]


def test_padding_leaves_cosines(spark):
    x, y = [1.0, 2.0, -1.0], [0.5, 0.1, 3.0]
    df = spark.createDataFrame([(x, y)], "a array<float>, b array<float>")
    plain, padded = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(vectors.pad(F.col("a"), 9), vectors.pad(F.col("b"), 9))).first()
    assert abs(plain - padded) < 1e-12 and abs(plain - np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-6


def test_template_mining(spark):
    lines = [(i + 1, f"2024-01-01 10:00:{i:02d} INFO user {i} logged in") for i in range(40)] + [(41, "ERROR disk sda full today")]
    got = {r["template"]: (r["n"], r["first_line"], r["severity"]) for r in logs.mine_templates(logs.annotate(spark.createDataFrame(lines, "line_no long, raw string"))).collect()}
    assert got == {"<TIME> INFO user <NUM> logged in": (40, 1, "INFO"), "ERROR disk sda full today": (1, 41, "ERROR")}


def test_a_burst_and_a_flat_log(spark):
    flat = [(h * 10 + j, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{j:02d}:00 INFO x") for h in range(24) for j in range(10)]
    spike = [(1000 + j, f"2024-01-01 07:30:{j % 60:02d} ERROR y") for j in range(90)]
    annotated = lambda rows: logs.annotate(spark.createDataFrame(rows, "line_no long, raw string"))
    got = logs.bursts(annotated(flat + spike), bucket_s=3600).collect()
    assert [(r["n"], r["errors"]) for r in got] == [(100, 90)] and logs.bursts(annotated(flat), bucket_s=3600).count() == 0


def test_census_of_a_sheet(spark):
    rows = [(str(i), "a" if i % 2 else "b", "5,000" if i == 3 else f"{i}.5") for i in range(60)]
    got = {r["column_name"]: r for r in table.census(spark.createDataFrame(rows, "F1 string, F2 string, F3 string")).collect()}
    assert got["F2"]["kind"] == "text" and got["F2"]["distinct_cells"] == 2 and got["F3"]["max"] == 5000 and got["F1"]["median"] == 30
    with pytest.raises(ValueError, match="outside"):
        table.column(spark.range(1), 2)


def test_fusion_ties_and_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, id long, rank int")
    places = lambda df: [r["id"] for r in df.orderBy("place").collect()]
    assert places(retrieval.fuse(a, b)) == places(retrieval.fuse(b, a)) == [20, 10, 30]


def test_hybrid_gates(spark):
    queries = spark.createDataFrame([(1, "price of item 42")], "query_id long, text string")
    rows = [(1, 1, "the price of item 42 is 7", 0.9), (1, 2, "the price of item 43", 0.7), (1, 3, "unrelated words", 0.1)]
    got = {r["id"]: r["accepted"] for r in retrieval.hybrid(spark.createDataFrame(rows, "query_id long, id long, text string, similarity double"), queries).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_context_stops_at_the_first_overflow(spark):
    rows = [(1, 1, "d", "p1", 50, False), (1, 2, "d", "p1", 10, False), (1, 3, "e", "p2", 60, False), (1, 4, "e", "p3", 10, False)]
    ranked = spark.createDataFrame(rows, "query_id long, place int, doc string, parent string, tokens int, summary boolean")
    assert [r["place"] for r in retrieval.select_context(ranked, 100, 5).orderBy("place").collect()] == [1]
    assert [r["place"] for r in retrieval.select_context(ranked, 10, 5).orderBy("place").collect()] == [1]
    assert [r["place"] for r in retrieval.select_context(ranked, 500, 2).orderBy("place").collect()] == [1, 3]


def test_splitters_cover_their_texts():
    draw = random.Random(1)
    whole = "\n\n".join(" ".join(draw.choice(["alpha", "beta", "gamma."]) for _ in range(60)) for _ in range(20))
    for split in (chunking.by_lines, chunking.by_sentences, lambda t: chunking.by_separators(t, 100, 0)):
        assert " ".join(" ".join(split(whole)).split()) == " ".join(whole.split())
    assert all(w in " ".join(chunking.by_size(whole)) for w in ("alpha", "gamma."))
    chunks = chunking.by_words(whole, 50, 40)
    assert len(chunks[-1].split()) <= 50 and chunks[-1].split()[-1] == whole.split()[-1]
    assert chunking.by_words("a" * 900, 5, 3) == ["a" * 900] and chunking.by_size("x" * 2500)[0] == "x" * 1000


def test_kmeans_finds_the_groups():
    x = np.array([[1, 0, 0, 0], [0.9, 0.1, 0, 0], [1, 0.05, 0, 0], [0, 1, 0, 0], [0, 0.95, 0.1, 0], [0, 0, 1, 0], [0, 0, 0.9, 0.1]])
    found = chunking.kmeans(x, 3)
    assert sorted(map(sorted, ([i for i in range(7) if found[i] == k] for k in set(found)))) == [[0, 1, 2], [3, 4], [5, 6]]
    assert (chunking.kmeans(x, 3) == found).all() and len(set(chunking.kmeans(x, 9))) == 7


def test_lockout_and_fixed_window_steps():
    step, state, seen = counters.lockout(15, 15, 5), None, []
    for at in (0, 1, 2, 3, 4, 10, 40, 41, 70):
        state = step(state, at)
        seen.append((state[1], state[2]))
    assert seen == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 19), (6, 25), (1, 0), (2, 0), (1, 0)]
    hit, state, counts = counters.fixed_window(10), None, []
    for at in (3, 5, 12, 13, 22, 23):
        state = hit(state, at)
        counts.append(state[1])
    assert counts == [1, 2, 3, 1, 2, 1]


def test_stream_counts_as_the_table_does(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    step, names = counters.fixed_window(86_400_000), ["window_start", "hits"]
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = counters.fold_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "user_id", "event_id", "at_ms", step, names)
    run = stream.writeStream.format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, counters.fold(events, "user_id", "event_id", "at_ms", step, names).collect()))


def test_stream_upserts_in_versions(spark, tmp_path):
    for k, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 2)])):
        spark.createDataFrame(rows, "k long, v string, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, v string, at long").parquet(f"{tmp_path}/in")
        counters.upsert_batches(stream, f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/check").awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out/version={k}").count() == 2 + k
    assert {r["v"] for r in spark.read.parquet(f"{tmp_path}/out/version=1").collect()} == {"b", "c", "d"}
    # a new checkpoint over the table that is there: all rows come again, none is lost, and the oldest version goes
    spark.createDataFrame([(9, "z", 0)], "k long, v string, at long").write.parquet(f"{tmp_path}/late")
    late = spark.readStream.schema("k long, v string, at long").parquet(f"{tmp_path}/late")
    counters.upsert_batches(late, f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/other").awaitTermination(120)
    assert {r["v"] for r in counters.latest(spark, f"{tmp_path}/out").collect()} == {"b", "c", "d", "z"}
    assert counters._versions(spark, f"{tmp_path}/out") == [1, 2] and counters.latest(spark, f"{tmp_path}/none") is None


def test_traces_with_a_cycle(spark):
    rows = [(1, 1, None, 5.0), (1, 2, 1, 3.0), (1, 3, 2, 4.0), (1, 4, 1, 6.0), (1, 8, 9, 1.0), (1, 9, 8, 1.0)]
    steps = spark.createDataFrame(rows, "trace_id long, step_id long, parent_id long, duration double")
    assert tuple(traces.critical_path(steps).first()) == (1, 1, 12.0, 3)
    assert {r["step_id"] for r in traces.cyclic_steps(steps).collect()} == {8, 9}
    assert [r["step_id"] for r in traces.timeline(steps).orderBy("path").collect()] == [1, 2, 3, 4]


def test_upsert_keeps_or_replaces(spark):
    held, new = spark.createDataFrame([(1, "a", 1)], "k long, v string, at long"), spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k long, v string, at long")
    values = lambda **o: sorted(r["v"] for r in relational.upsert(held, new, ["k"], "at", **o).collect())
    assert values() == ["b", "c"] and values(ignore=True) == ["a", "c"]


def test_windows_never_open_on_an_assistant(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 40) for i in range(30)]
    kept = conversation.history_window(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=80).orderBy("turn").collect()
    assert kept[0]["role"] == "user" and kept[-1]["turn"] == 29 and len(kept) <= 6
