"""Template mining against a plain miner, at the size of a full leaf, and matching without learning."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from quern.operators import logs


def plain(lines):
    """(template, n, first line) by a miner that compares each line with every template of its leaf."""
    tree, told = {}, []
    for number, line in lines:
        tokens = line.split()
        if not tokens:
            continue
        node = tree.setdefault(len(tokens), {})
        for token in tokens[:2]:
            key = "<*>" if re.search(r"<[A-Z]+>|\d", token) else token
            if key not in node:
                key = "<*>" if "<*>" in node or len(node) >= logs.CHILDREN else key
            node = node.setdefault(key, {})
        leaf = node.setdefault("", [])
        marks = [sum(a == b for a, b in zip(c["t"], tokens, strict=True)) / len(tokens) for c in leaf]
        if marks and max(marks) >= 0.4:
            own = leaf[marks.index(max(marks))]
            own["t"] = [a if a == b else "<*>" for a, b in zip(own["t"], tokens, strict=True)]
            own["n"] += 1
        else:
            leaf.append({"t": tokens, "n": 1, "first": number})
            told.append(leaf[-1])
    out = {}
    for c in told:
        t = " ".join(c["t"])
        n, first = out.get(t, (0, c["first"]))
        out[t] = (n + c["n"], min(first, c["first"]))
    return out


def mined(spark, lines):
    rows = spark.createDataFrame(lines, "line_no long, masked string").withColumn("severity", F.lit(None).cast("string"))
    return {r["template"]: (r["n"], r["first_line"]) for r in logs.mine_templates(rows.repartition(3)).collect()}


def test_same_as_a_plain_miner(spark):
    draw = random.Random(4)
    words = [f"w{chr(97 + k)}" for k in range(12)] + ["user=<NUM>", "[<TIME>]", "<IP>", "a<NUM>b"]
    seen = {" ".join(draw.choice(words) for _ in range(draw.randint(1, 7))) for _ in range(2500)}
    lines = [(k + 1, line) for k, line in enumerate(draw.sample(sorted(seen), len(seen)))] + [(9000, ""), (9001, "  ")]
    assert mined(spark, lines) == plain(lines)


def test_children_beyond_the_bound_and_after_a_wildcard_share_one_node(spark, monkeypatch):
    monkeypatch.setattr(logs, "CHILDREN", 3)
    lines = [(k, f"{a} common tail of it") for k, a in enumerate("abcdef")] + [(10, "x <NUM> p q"), (11, "x late p q"), (12, "x early r s")]
    assert mined(spark, lines) == plain(lines)


def test_thirty_thousand_templates_of_one_leaf():
    leaf, draw = logs.TemplateLeaf(), random.Random(1)
    lines = [["same", "start", *(f"t{draw.randrange(10**7)}" for _ in range(8))] for _ in range(30_000)]
    began = time.process_time()
    assert leaf.add(lines) == list(range(30_000))
    assert time.process_time() - began < 10
    assert leaf.add([[*lines[777][:6], "x", "y", "z", "u"]]) == [777] and leaf.templates()[777].endswith("<*> <*> <*> <*>")


def test_a_second_log_is_matched_without_being_learned(spark):
    rows = lambda texts: logs.annotate(spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "line_no long, raw string"))
    model = logs.template_model(rows([f"job {k} done by worker w{k} fine" for k in range(9)] + ["disk sda is full now", "disk sdb is full now"]))
    asked = ["job 77 done by worker zz fine", "disk sdz is full now", "disk sda was never seen", "disk sda is full", "never seen at all here", ""]
    got = {r["masked"]: r["template"] for r in logs.match_templates(model, rows(asked)).collect()}
    assert got["job <NUM> done by worker zz fine"] == "job <NUM> done by worker <*> fine"
    # the model's tree has no other disk, and what it has isn't like enough
    assert got["disk sdz is full now"] is None and got["disk sda was never seen"] == "disk sda is full now"
    assert got["disk sda is full"] is None and got["never seen at all here"] is None and "" not in got
    assert logs.match_templates(model.limit(0), rows(asked)).filter("template is not null").count() == 0


def test_one_model_for_both_logs(spark):
    """A line's template in the baseline is the one it has in the current log, also if each log alone would generalise otherwise."""
    rows = lambda texts: logs.annotate(spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "line_no long, raw string"))
    base = rows(["load file alpha from cache"] * 6 + ["gone for good now"] * 3 + ["kept as it was"] * 20)
    now = rows([f"load file {w} from cache" for w in ("beta", "gamma", "delta", "eps", "zeta")] + ["brand new event here"] * 2 + ["kept as it was"] * 2 + ["x" * 4001])
    got = {r["template"]: (r["before"], r["after"], r["change"]) for r in logs.compare(base, now).collect()}
    assert got == {"gone for good now": (3, 0, "vanished"), "brand new event here": (0, 2, "appeared"), "kept as it was": (20, 2, "less")}
    assert logs.compare(base, now.limit(4)).count() == 0
