"""Answers parsed into parts, and prompt budgets, on odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import answers, budget


def test_parts_of_odd_answers(spark):
    rows = [(1, None), (2, ""), (3, "| a |\n|---|"), (4, "| a | b |\n|---|---|\n| 1 | |\n|1|2|\nx"), (5, " * one\r\n* two\n-\n+  three  ")]
    df = spark.createDataFrame(rows, "k int, t string")
    t = F.col("t")
    got = {r["k"]: r for r in df.select("k", answers.answer_kind(t).alias("kind"), answers.markdown_table(t).alias("m"), answers.markdown_list(t).alias("l")).collect()}
    assert [got[k]["kind"] for k in range(1, 6)] == [None, None, "table", "table", "list"]
    assert got[3]["m"] is None and got[1]["m"] is None and got[1]["l"] is None and got[2]["l"] == []
    assert got[4]["m"]["header"] == ["a", "b"] and got[4]["m"]["rows"] == [["1", "2"]]
    assert got[5]["l"] == ["two", "three"]  # a line that ends with a carriage return is no item


def test_delimited_rows_and_named_matches(spark):
    df = spark.createDataFrame([('a, "b,c" ,d""e\n\n x', "x1 y22"), (None, None)], "t string, u string")
    got = df.select(answers.delimited(F.col("t")).alias("r"), answers.named_matches(F.col("u"), {"n": "[0-9]+", "f": "[0-9]+", "z": "Z"}, first={"f", "z"}).alias("m")).collect()
    assert got[0]["r"] == [["a", "b,c", "de"], ["x"]] and got[1]["r"] is None
    assert (got[0]["m"]["n"], got[0]["m"]["f"], got[0]["m"]["z"]) == (["1", "22"], "1", None)


def test_complexity_is_bounded_and_defined(spark):
    hard = "Debug the SAP ABAP OData HANA BTP code ``` select a from b; create table x Run(y) <a> {\"k\": 1} json xml api sql deploy " + "word " * 400
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, hard, "sap abap odata hana btp cds"), (4, "hello there", None)], "k int, q string, h string")
    got = {r["k"]: r["c"] for r in df.select("k", budget.complexity(F.col("q"), F.col("h")).alias("c")).collect()}
    assert got[1] is None and got[2] == 0.0 and got[3] == 10.0 and got[4] == 0.0


def test_sections_add_up(spark):
    df = spark.range(1, 80).selectExpr("id", "id * 700 as size", "double(id % 11) as score")
    for told in (budget.prompt_budget(F.col("size")), budget.dynamic_budget(F.col("id"), F.col("score"), F.col("size"))):
        for row in df.select(told.alias("b")).select("b.*").collect():
            whole = row.asDict()
            most = whole.pop("prompt")
            assert sum(whole.values()) == most or most <= 0
