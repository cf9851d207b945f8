"""Prompts of sections and messages against a walk step by step, and long files by splits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import prompt
from quern.sources import files


def plain(messages, sections, ceiling, floor, least):
    """messages: [(turn, role, tokens)], sections: [(place, rank, tokens)]; what stays, and whether the last message is cut."""
    messages, sections, target = list(messages), sorted(sections, key=lambda s: (s[1], s[0])), int(ceiling * 0.85)
    total = lambda: sum(m[2] for m in messages) + (sum(s[2] for s in sections) + 4 if sections else 0)
    if total() <= ceiling:
        return messages, sections, False
    while len(sections) > 1 and sections[0][1] <= 1 and total() > target:
        sections.pop(0)
    start = next((k for k, m in enumerate(messages) if m[1] != "system"), len(messages))
    while total() > target and len(messages) - 1 - start > floor:
        messages.pop(start)
    while len(messages) - 1 > start and messages[start][1] == "assistant":
        messages.pop(start)
    while len(sections) > 1 and total() > ceiling:
        sections.pop(0)
    if total() > ceiling:
        sections = []
    room = ceiling - (total() - messages[-1][2]) - 8
    return messages, sections, total() > ceiling and messages[-1][1] == "user" and room >= least


@pytest.mark.parametrize("ceiling", [300, 700, 1500])
def test_same_as_step_by_step(spark, ceiling):
    draw, talks, given, want = random.Random(ceiling), [], [], set()
    text = lambda tokens: "x" * (4 * tokens)
    for conv in range(40):
        m = [(k, "system" if k < conv % 3 else draw.choice(["user", "assistant"]), draw.randint(1, 120)) for k in range(draw.randint(1, 14))]
        s = [(p, r, draw.randint(8, 150)) for p, r in enumerate(draw.choices(range(5), k=draw.randint(0, 6)))]
        talks += [(conv, k, role, text(t)) for k, role, t in m]
        given += [(conv, p, (heads := [*prompt.SECTIONS, "## Notes"])[r] + "y" * (4 * t - len(heads[r]))) for p, r, t in s]
        kept, left, cut = plain([(k, role, t + 4) for k, role, t in m], s, ceiling, 2, 50)
        want |= {(conv, "message", k, cut and k == kept[-1][0]) for k, _, _ in kept} | {(conv, "section", p, False) for p, _, _ in left}
    got = prompt.fit_prompt(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"), spark.createDataFrame(given, "conv_id long, place long, text string"), ceiling, floor=2, least_query=50)
    rows = got.collect()
    assert {(r["conv_id"], r["kind"], r["place"], r["trimmed"]) for r in rows} == want
    sums = {}
    for r in rows:
        sums[r["conv_id"]] = sums.get(r["conv_id"], 0) + r["tokens"]
    assert all(sums[r["conv_id"]] <= ceiling + 8 for r in rows if r["trimmed"])


def test_lines_of_a_long_file_by_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k} {'z' * (k % 50)}\n" for k in range(1, 20_001)))
    (tmp_path / "b.log").write_text("only\n\nthree")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = files.read_long_lines(spark, str(tmp_path))
        got = lines.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = {r["line_no"]: r["raw"] for r in got if r["file"].endswith("a.log")}
    assert len(a) == 20_000 and all(a[k].startswith(f"line {k} ") for k in a)
    assert {r["line_no"]: r["raw"] for r in got if r["file"].endswith("b.log")} == {1: "only", 2: "", 3: "three"}
    assert lines.filter(F.col("line_no") < 1).count() == 0
