"""Exact quantiles, roles of columns, profiles and timings in log text, against plain Python."""

from __future__ import annotations

import math
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import profile, table
from quern.operators.quantiles import MARKS, UPPER_MEDIAN, at_ranks, counted_values


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_ranks_by_group_with_ties_and_nulls(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 1.5, float(draw.randrange(40)), draw.gauss(0, 1e6)])) for _ in range(4000)] + [("one", 2.0), ("empty", None)]
    got = {r["k"]: r for r in at_ranks(counted_values(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"]), ["k"], MARKS | UPPER_MEDIAN).collect()}
    want = {k: sorted(v for g, v in rows if g == k and v is not None) for k in ("a", "b", None, "one")}
    assert set(got) == set(want)
    for k, values in want.items():
        assert [got[k][m] for m in MARKS] == [values[math.ceil(len(values) * p) - 1] for p in (0.5, 0.95, 0.99)]
        assert got[k]["median"] == values[len(values) // 2]


def test_ranks_of_nothing(spark):
    assert at_ranks(counted_values(spark.createDataFrame([], "v double"), []), [], MARKS).collect() == [(None, None, None)]


@pytest.mark.parametrize(
    ("sql", "shape"),
    [
        ("select a from t union select a from t union all select b from t", "SELECT A FROM T UNION ALL SELECT B FROM T"),
        ("select a from t1 union select b from t2 union select a from t1 where x = 5", "SELECT A FROM T1 UNION SELECT B FROM T2 UNION SELECT A FROM T1 WHERE X = ?"),
        ("select a union select b union select a", "SELECT A UNION SELECT B"),
    ],
)
def test_union_branches(spark, sql, shape):
    assert one(spark, text.fingerprint(F.col("c")), c=sql) == shape
    assert one(spark, text.fingerprint(text.rough_shape(F.col("c"))), c=sql) == shape


def test_rough_shapes_keep_the_fingerprint(spark):
    draw = random.Random(9)
    parts = ["select", "t1", "t22", "orders_2025_01", "'it''s 55'", "'%x12'", '"%q"', "-- 'no 12\n", "/* 77 'x */", "12", "12.50", "1e5", "0x1F", "null", "in (1, 22, 333)", "union", ",", "(", ")", "'open"]
    rows = [(" ".join(["select", *draw.choices(parts, k=12)]),) for _ in range(400)]
    got = spark.createDataFrame(rows, "c string").select("c", text.fingerprint(F.col("c")).alias("a"), text.fingerprint(text.rough_shape(F.col("c"))).alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == []


@pytest.mark.parametrize(
    ("reply", "left"),
    [
        ('<Function id="query_db_1">x</Function> [DB_SCHEMA_REQUEST:t]\nHi', "Hi"),
        ("<GET_SCHEMA>t</GET_SCHEMA><GET_SCHEMA:x><request a=1>q</request></function> Hi", "Hi"),
        ("[query_db]x[/query_db] Hi", "[query_db]x[/query_db] Hi"),
        ("[web_search:x] [/QUERY_DB] </query> Hi", "Hi"),
    ],
)
def test_tool_calls(spark, reply, left):
    assert one(spark, text.strip_tool_tags(F.col("c")), c=reply) == left


def test_headers_and_dates(spark):
    assert one(spark, text.normalize_header(F.col("c")), c=" Ausführungszeit (ms)! ") == "Ausfuhrungszeit (ms)"
    assert one(spark, text.normalize_header(F.col("c")), c="Duração") == "Duracao"
    said = {"2024-02-30": False, "2024/2/9 10:00": True, "12/31/2024": True, "31/12/2024": False, "SKU-0": False, "12:30": False, "1/2/24": True}
    for cell, date in said.items():
        assert one(spark, text.looks_like_date(F.col("c")), c=cell) is date, cell


def test_roles(spark):
    rows = [(f"select x from t where id = {i}", f"{i % 7},5", i, "ok", "") for i in range(30)]
    df = spark.createDataFrame(rows, "a string, `Latency sec` string, executions long, Estado string, empty string")
    got = {r["column_name"]: (r["role"], r["unit"], r["executions"]) for r in profile.column_roles(df).collect()}
    assert got == {"a": ("statement", "ms", False), "Latency sec": ("duration", "s", False), "executions": ("count", "ms", True), "Estado": ("status", "ms", False), "empty": ("text", "ms", False)}


def test_a_duration_is_guessed_only_without_a_named_one(spark):
    draw = random.Random(1)
    rows = [(i, draw.random() ** 40 * 1000 + 0.001, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, w double, t string").coalesce(1)
    assert {r["column_name"]: r["role"] for r in profile.column_roles(df).collect()} == {"id": "numeric", "w": "duration", "t": "text"}
    renamed = df.withColumnRenamed("id", "cost")
    assert {r["column_name"]: r["role"] for r in profile.column_roles(renamed).collect()} == {"cost": "duration", "w": "numeric", "t": "text"}


def test_profile_of_a_trace_and_of_a_plain_table(spark):
    rows = [(f"select x from t where id = {i}", float(i), "ok" if i % 3 else "bad", f"2024-01-0{i % 9 + 1}") for i in range(40)]
    told = profile.profile(spark.createDataFrame(rows, "sql string, `elapsed s` double, status string, date string"))
    by = {k: list(v) for k, v in groupby(sorted(told.collect(), key=lambda r: r["section"]), key=lambda r: r["section"])}
    assert sorted(by) == ["anti-pattern", "columns", "slowest", "statement", "status", "timing", "window"] or sorted(by) == ["columns", "slowest", "statement", "status", "timing", "window"]
    assert [(r["item"], r["ms"]) for r in by["slowest"]][:2] == [("select x from t where id = 39", 39000.0), ("select x from t where id = 38", 38000.0)]
    assert [(r["item"], r["n"], r["ms"]) for r in by["statement"]] == [("SELECT X FROM T WHERE ID = ?", 40, 780000.0)]
    assert {r["item"] for r in by["window"]} == {"2024-01-01 00:00:00", "2024-01-09 00:00:00"}
    assert profile.profile(spark.createDataFrame([("a", "b")] * 9, "x string, y string")) is None


def test_statements_across_blocks_are_those_of_the_whole_file(spark, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK", 128)
    draw = random.Random(4)
    kinds = ["2024-01-01 took 5 ms", "INFO latency 2 sec", "SELECT a", "  FROM t", "WHERE x = 1;", "", "  b, c", "done 7 ms update t set x", "waited 3 s", "odd"]
    lines = {n: draw.choice(kinds) for n in range(900) if draw.random() < 0.97}
    got = profile.inline_timings(spark.createDataFrame([("f", n, x) for n, x in lines.items()], "file string, line_no long, raw string").repartition(4)).collect()
    want = {n: (5.0 if "5 ms" in x else 7.0 if "7 ms" in x else 2000.0, profile._statement(lines, n)) for n, x in lines.items() if " ms" in x or " sec" in x}
    assert {r["line_no"]: (r["ms"], r["statement"]) for r in got} == want
    assert len(got) == len(want) and any(s for _, s in want.values())


def test_where_a_statement_is_looked_for():
    log = dict(enumerate(["[x] took 3 ms", "SELECT a,", "   b", "FROM t", "[y] next", "", "UPDATE t", "  SET x = 1", "took 4 ms", "2024-01-01 took 9 ms", "2024-01-01 more"]))
    assert profile._statement(log, 0) == "SELECT a, b FROM t"
    assert profile._statement(log, 8) == "UPDATE t SET x = 1"
    assert profile._statement({0: "took 4 ms", 1: "[z] SELECT x"}, 0) == "SELECT x"
    assert profile._statement(log, 4) == "SELECT a, b FROM t"  # nothing below, so what stands above
    assert profile._statement(log, 10) is None


def test_a_census_of_dates_and_few_values(spark):
    df = spark.createDataFrame([("2024-01-0%d" % (i % 9 + 1), "ab"[i % 2], f"{i},0", " ") for i in range(20)], "day string, few string, num string, blank string")
    got = {r["column_name"]: r for r in table.census(df).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"day": "datetime", "few": "text", "num": "number"}
    assert got["few"]["value_counts"] == "a=10, b=10" and got["day"]["samples"] == "2024-01-01 | 2024-01-02 | 2024-01-03" and got["num"]["median"] == 100.0
