"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from quern.llm import near_dedup


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def by_hand(rows, width: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (size of the set, component) by comparing every pair."""
    sets = {d: shingles(t, width) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    kept = [d for d in sets if sets[d]]
    for a, b in combinations(kept, 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if 100 * small >= percent * large and root(a) != root(b):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (small + large - common):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


def told(df) -> dict[int, tuple[int, int]]:
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    return out


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (5, 80)])
def test_documents_against_all_pairs(spark, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert told(near_dedup.near_duplicates(docs, width, percent)) == by_hand(rows, width, percent)


@pytest.mark.parametrize("node", [near_dedup.NODE, 40])
def test_chains_and_large_groups_of_variants(spark, monkeypatch, node):
    monkeypatch.setattr(near_dedup, "NODE", node)  # small: nodes of the groups branch in Spark
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, doc = [], 0
    for _ in range(3):  # groups of over LEAF variants, each some edits away from the base
        base = draw.choices(vocabulary, k=150)
        for _ in range(60):
            words = list(base)
            for _ in range(draw.randint(0, 9)):
                words[draw.randrange(150)] = draw.choice(vocabulary)
            rows.append((doc, " ".join(words)))
            doc += 1
    chain = draw.choices(vocabulary, k=200)
    for _ in range(30):  # each near the next only
        chain = chain[6:] + draw.choices(vocabulary, k=6)
        rows.append((doc, " ".join(chain)))
        doc += 1
    rows += [(doc + i, " ".join(draw.choices(vocabulary, k=100))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert told(near_dedup.near_duplicates(docs, 2, 80)) == by_hand(rows, 2, 80)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One", None), (5, "one", "y"), (6, "one two", "y"), (7, "ONE  TWO", "y"), (8, "k " * 30_000, "y"), (None, "one two", "y"), (9, "Ä b", "z"), (10, "ä b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 2, 80).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert got[8][0] == 1 and got[None][1:] == (None, True)
    assert got[9][1] == 9 and got[10][1] == 10  # only A-Z is lower-cased
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_survivors_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "t"), (3, None, None)], "doc_id long, text string, kept string")
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_trees_follow_from_the_target_recall():
    assert near_dedup.trees_for(0.99, 12, 0.8) < near_dedup.TREES < near_dedup.trees_for(0.99999, 12, 0.8)
    assert near_dedup.survival(3, 1.0) == 1.0 and near_dedup.survival(40, 0.5) < 1e-6


def test_closer_look_tells_small_sets_exactly():
    draw = np.random.default_rng(2)
    pool = np.sort(draw.choice(1 << 32, 400, replace=False).astype(np.uint64))
    sets = [np.sort(draw.choice(pool[:120], 100, replace=False)) for _ in range(40)]
    bottom = np.full((40, near_dedup.BOTTOM), 0xFFFFFFFF, dtype=np.uint32)
    for i, s in enumerate(sets):
        bottom[i, :100] = s
    members = near_dedup.Members(np.arange(40), np.full(40, 100), np.zeros((40, 128), dtype=np.uint8), np.arange(40), 0.7, bottom)
    x, y = np.triu_indices(40, 1)
    share = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(x, y)])
    near = members._near(x, y)
    assert near[share >= 0.7].all() and not near[share < 0.69].any()
