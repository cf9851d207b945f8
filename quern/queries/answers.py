"""Queries of structured answers and prompt budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import answers, budget
from quern.queries.registry import query
from quern.sources.tables import table

TRIM = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
# the answers are made of part names and sizes: a table with a short row and a blank cell, then a list
ANSWER = """'Here it is:' || chr(10) || '| name | size |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' || chr(10)
 || '| one cell |' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  |x|  |y|' || chr(10) ELSE '' END || '- ' || p_brand || chr(10) || ' * ' || p_type || ' ' || chr(10) || '-none'"""


def _answers(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(ANSWER).alias("t"))


@query(rf"""WITH a AS (SELECT p_partkey, list_filter(string_split({ANSWER}, chr(10)), lambda x: starts_with({TRIM % "x"}, '|')) AS l FROM part),
c AS (SELECT p_partkey, list_transform(l, lambda x: list_filter(list_transform(string_split(x, '|'), lambda y: {TRIM % "y"}), lambda y: y != '')) AS c FROM a),
r AS (SELECT p_partkey, c[1] AS header, unnest(c[3:]) AS row, generate_subscripts(c[3:], 1) AS i FROM c)
SELECT p_partkey, header[1] AS first, row[1] AS name, row[2] AS size FROM r WHERE len(row) = len(header)""")
def answer_tables(spark, d):
    found = _answers(spark, d).select("p_partkey", answers.markdown_table(F.col("t")).alias("m"))
    return found.select("p_partkey", F.col("m.header")[0].alias("first"), F.explode("m.rows").alias("r")).select("p_partkey", "first", F.col("r")[0].alias("name"), F.col("r")[1].alias("size"))


ITEM = r"'^\s*[-*+]\s+([^\n\r]+)$'"


@query(f"""SELECT p_partkey, {TRIM % f"regexp_extract(x, {ITEM}, 1)"} AS item
FROM (SELECT p_partkey, unnest(string_split({ANSWER}, chr(10))) AS x FROM part) WHERE regexp_matches(x, {ITEM})""")
def answer_lists(spark, d):
    return _answers(spark, d).select("p_partkey", F.explode(answers.markdown_list(F.col("t"))).alias("item"))


@query(r"""SELECT conv_id, turn, CASE WHEN text = '' THEN NULL WHEN contains(text, '|') AND contains(text, '---') THEN 'table' WHEN regexp_matches(text, '(?m)^\s*[-*+]\s') THEN 'list' WHEN text IS NOT NULL THEN 'text' END AS kind FROM conversations""")
def answer_kinds(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answers.answer_kind(F.col("text")).alias("kind"))


@query("""SELECT o_orderkey, o_custkey::VARCHAR AS customer, 'a,' || o_orderstatus AS quoted, 3 AS width FROM orders""")
def answer_rows(spark, d):
    text = F.concat(F.lit("id,customer,note\n\n"), "o_orderkey", F.lit(", "), "o_custkey", F.lit(' ,"a,'), "o_orderstatus", F.lit('"'))
    row = F.element_at(answers.delimited(text), 2)
    return table(spark, d, "orders").select("o_orderkey", row[1].alias("customer"), row[2].alias("quoted"), F.size(row).alias("width"))


@query(r"""SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+')[1] AS number, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS names FROM documents""")
def answer_patterns(spark, d):
    m = answers.named_matches(F.col("text"), {"number": "[0-9]+", "names": "[A-Z][a-z]+"}, first={"number"})
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.number", F.size("m.names").cast("bigint").alias("names"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _held(text: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))::DOUBLE"


def _points(test: str, points: float) -> str:
    return f"CASE WHEN {test} THEN {points}::DOUBLE ELSE 0::DOUBLE END"


# every third message has a statement, every fifth markup and every seventh a call and an object in front of it
QUESTION = """CASE WHEN turn % 3 = 0 THEN 'Select a, b from t; create view v: ' ELSE '' END || CASE WHEN turn % 5 = 0 THEN '<div> ```' ELSE '' END
 || CASE WHEN turn % 7 = 0 THEN 'Run(x) {"k": 1} ' ELSE '' END || text"""
SCORE = f"""least({_held("low", budget.HIGH)}, 4) + least({_held("low", budget.MIDDLE)} * 0.5::DOUBLE, 3) + {_points("contains(q, '```')", 1.5)}
 + {" + ".join(_points(f"regexp_matches(low, '{p}')", n) for p, n in budget.PATTERNS.items())}
 + ({_points(f"regexp_matches(q, '{budget.MARKUP}')", 0.5)} + {_points(f"contains(q, '{{') AND regexp_matches(q[instr(q, '{{'):], '{budget.PAIR}')", 0.5)} + {_points(f"regexp_matches(q, '{budget.CALL}')", 0.5)})
 + least(len(regexp_split_to_array(q, '\\s+')) / 80::DOUBLE, 2.5::DOUBLE)
 + coalesce(least({_held("past", budget.HIGH)} * 0.4::DOUBLE + {_held("past", budget.MIDDLE)} * 0.15::DOUBLE, 2::DOUBLE), 0::DOUBLE)"""
COMPLEXITY = f"""WITH m AS (SELECT conv_id, turn, {QUESTION} AS q, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text)) AS past, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN greatest(0, least(10, floor(({SCORE}) * 10 + 0.5) / 10)) END AS complexity FROM (SELECT *, lower(q) AS low FROM m))"""


def _scored(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr(QUESTION).alias("q"))
    rows = rows.withColumn("past", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).withColumn("turns", F.count("*").over(Window.partitionBy("conv_id")))
    return rows.withColumn("complexity", budget.complexity(F.col("q"), F.col("past")))


@query(COMPLEXITY + " SELECT conv_id, turn, complexity FROM c")
def complexity_score(spark, d):
    return _scored(spark, d).select("conv_id", "turn", "complexity")


@query(COMPLEXITY + """, k AS (SELECT *, 1000 * (1 + turn % 40) AS size FROM c),
b AS (SELECT *, size - CASE WHEN size >= 32000 THEN 4000 ELSE least(2000, greatest(800, floor(size * 0.25::DOUBLE))) END AS prompt FROM k),
h AS (SELECT *, floor(prompt * 0.12::DOUBLE) AS loop FROM b),
r AS (SELECT *, floor((prompt - loop) * CASE WHEN turns < 3 THEN 0.25::DOUBLE WHEN complexity > 7 OR turns > 10 THEN 0.65::DOUBLE WHEN complexity > 5 THEN 0.5::DOUBLE ELSE 0.45::DOUBLE END) AS history FROM h),
s AS (SELECT *, prompt - loop - history AS rest FROM r),
f AS (SELECT size - CASE WHEN size >= 32000 THEN 4000 ELSE least(4000, greatest(800, floor(size * 0.35::DOUBLE))) END AS most, * FROM s)
SELECT conv_id, turn, prompt::BIGINT AS prompt, loop::BIGINT AS tool_loop, history::BIGINT AS history, floor(rest * 0.14::DOUBLE)::BIGINT AS system, floor(rest * 0.26::DOUBLE)::BIGINT AS rag,
  (rest - floor(rest * 0.14::DOUBLE) - 2 * floor(rest * 0.26::DOUBLE))::BIGINT AS query, greatest(1200, most)::BIGINT AS fixed_prompt, floor(greatest(1200, most) * 0.3::DOUBLE)::BIGINT AS fixed_history,
  (greatest(1200, most) - floor(greatest(1200, most) * 0.1::DOUBLE) - floor(greatest(1200, most) * 0.3::DOUBLE) - 3 * floor(greatest(1200, most) * 0.15::DOUBLE))::BIGINT AS fixed_query FROM f""")
def prompt_budgets(spark, d):
    size = 1000 * (1 + F.col("turn") % 40)
    told = _scored(spark, d).select("conv_id", "turn", budget.dynamic_budget(F.col("turns"), F.col("complexity"), size).alias("b"), budget.prompt_budget(size).alias("f"))
    return told.select(
        "conv_id", "turn", "b.prompt", "b.tool_loop", "b.history", "b.system", "b.rag", "b.query",
        F.col("f.prompt").alias("fixed_prompt"), F.col("f.history").alias("fixed_history"), F.col("f.query").alias("fixed_query"),
    )
