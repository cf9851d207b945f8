"""Prompt fitting, trimming and list merges against plain Python."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import conversation, logs, relational, retrieval


def estimate(t: str | None) -> int:
    bare = re.sub(r"^\s+|\s+$", "", t or "", flags=re.A)
    if not bare:
        return 0
    head = bare[:4000]
    dense = len(re.sub(r"[A-Za-z0-9 \t\n\r]", "", head)) / len(head) > 0.15
    return max(math.ceil(len(bare) / (3 if dense else 4)), math.ceil(len(re.split(r"\s+", bare, flags=re.A)) * 13 / 10))


def trimmed(t: str | None, most: int) -> str:
    if not t or most <= 0:
        return ""
    if estimate(t) <= most:
        return t
    size = max(0, math.floor(most * (len(t) / max(1, estimate(t)))) - 16)
    out = t[:size].strip()
    for _ in range(6):
        if estimate(out) <= most:
            break
        size = math.floor(size * 0.9)
        out = t[:size].strip()
    return out + "..."


def texts(draw, n):
    kinds = ["word ", "a ", "{}:;", "longerword ", "\n", "é"]
    return ["".join(draw.choices(kinds, weights=draw.choices(range(1, 9), k=6), k=draw.choice([0, 3, 60, 900]))) for _ in range(n)] + [None, " "]


def test_trimming(spark):
    draw = random.Random(2)
    rows = [(i, t) for i, t in enumerate(texts(draw, 60))]
    for most in (0, 1, 40, 200):
        got = spark.createDataFrame(rows, "i int, t string").select("i", text.trim_to_tokens(F.col("t"), most).alias("x")).collect()
        assert {r["i"]: r["x"] for r in got} == {i: trimmed(t, most) for i, t in rows}


def fitted(messages: list[tuple], ceiling: int, low: float, floor: int, least: int) -> list[tuple]:
    cost = lambda m: estimate(m[2]) + 4
    total = lambda: sum(map(cost, kept))
    kept = list(messages)
    if total() <= ceiling:
        return kept
    pinned = next((k for k, m in enumerate(kept) if m[1] != "system"), len(kept))
    while total() > int(ceiling * low) and len(kept) - 1 - pinned > floor:
        kept.pop(pinned)
    while len(kept) - 1 > pinned and kept[pinned][1] == "assistant":
        kept.pop(pinned)
    last = kept[-1]
    room = ceiling - sum(map(cost, kept[:-1])) - 8
    if total() > ceiling and last[1] == "user" and room >= least:
        kept[-1] = (last[0], last[1], trimmed(last[2], room))
    return kept


def test_prompts_are_fitted(spark):
    draw = random.Random(8)
    rows = []
    for conv in range(60):
        said = texts(draw, draw.randrange(1, 14))
        roles = ["system"] * draw.randrange(3) + draw.choices(["user", "assistant", None], weights=[4, 4, 1], k=20)
        rows += [(conv, k, roles[k], t) for k, t in enumerate(said[: draw.randrange(1, len(said) + 1)])]
    got = conversation.fit_prompt(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 700, floor=3, least_query=60).collect()
    want = [(c, *m) for c in range(60) for m in fitted([r[1:] for r in rows if r[0] == c], 700, 0.85, 3, 60)]
    assert sorted((r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in got) == sorted((c, k, role or "", t or "") for c, k, role, t in want)
    assert any(r["trimmed"] for r in got) and len(got) < len(rows)


def test_hits_are_merged_in_order(spark):
    draw = random.Random(6)
    make = lambda n: [(0, draw.randrange(3), k, "".join(draw.choices("ab", k=draw.randrange(1, 7)))) for k in range(n)]
    words, vectors = make(6), make(30)
    kept = list(words)
    for hit in vectors:
        if not any(k[1] == hit[1] and hit[3][:3] in k[3] for k in kept):
            kept.append(hit)
    schema = "query_id int, file_id int, place int, text string"
    got = retrieval.merge_hits(spark.createDataFrame(words, schema), spark.createDataFrame(vectors, schema), prefix=3).collect()
    assert sorted(map(tuple, ((r["query_id"], r["file_id"], r["place"], r["text"]) for r in got))) == sorted(kept)


def test_reports_need_lines_and_repeats(spark):
    lines = lambda raw: logs.annotate(spark.createDataFrame(list(enumerate(raw, 1)), "line_no long, raw string"))
    assert logs.mine_report(lines(["INFO started job 5"] * 29)).collect() == []
    assert [r["share"] for r in logs.mine_report(lines(["INFO started job 5"] * 30)).collect()] == [1.0]
    assert logs.mine_report(lines([f"{'x' * k} {'y' * k}" for k in range(1, 40)])).collect() == []


def test_json_of_odd_rows(spark):
    errors = lambda c, **kw: spark.createDataFrame([(c,)], "c string").select(text.schema_errors(F.col("c"), {"a": "number", "b": "object"}, **kw).alias("x")).first()["x"]
    assert errors('{"a": true, "b": {}}') == ["a: not number"] and errors("[1]") == ["a: missing", "b: missing"]
    assert errors("{}", partial=True) == [] and errors(None) is None and errors("") is None
    files = spark.createDataFrame([("0" * 36, "x"), (None, None)], "id string, source string")
    for odd in (None, "", "5", "[5]", '"odd"', '{"file_id": "%s"}' % ("0" * 36)):
        assert sorted(relational.mark_generated(files, spark.createDataFrame([(odd,)], "generated_files string")).collect(), key=str) == [("0" * 36, "x"), (None, None)]
