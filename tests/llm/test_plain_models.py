"""The quality and language models against the same models written out plainly, over all rows of a small table."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from quern.llm import language, quality


def features(text):
    raw = list((text or "").encode("utf-8", "replace"))
    words = bytes(raw).split()
    if not words:
        return [0.0] * 12 + [1.0]
    n, k = len(raw), len(words)
    upper, lower, digits = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122), (48, 57)))
    marks = sum(33 <= c <= 126 for c in raw) - upper - lower - digits
    usual = sum(chr(c) in ".,;:'\"()-" for c in raw)
    lines, distinct = bytes(raw).split(b"\n"), len(set(words))
    near = lambda share: math.log(share + 0.002)
    twice = sum(words[i] == words[i + 1] for i in range(k - 1))
    return [
        near((marks - usual) / (n + 40)), near(upper / (n + 40)), near(digits / (n + 40)), near(marks / (n + 40)), near(raw.count(124) / (k + 8)), near(raw.count(46) / (k + 8)),
        near(twice / (k + 8)), near(distinct / k), math.log(distinct + 1) / math.log(k + 2), (n + 48) / (k + 8) / 10, near(1 - len(set(lines)) / len(lines)), math.log1p(k) / 10, 0.0,
    ]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows(spark, tiny):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    return docs, labels


def test_quality_scores_of_all_rows(spark, tiny, rows):
    docs, labels = rows
    known = sorted((tuple(features(docs[d][0])), q) for d, q in labels.items() if q in (0, 1) and not held(d) and d in docs)
    x, y = np.array([k[0] for k in known]), [k[1] for k in known]
    mean, scale = x.mean(axis=0), np.array([s if s > 1e-9 else 1.0 for s in x.std(axis=0)])
    z, draw = (x - mean) / scale, np.random.default_rng(11)
    good, bad = ([i for i, q in enumerate(y) if q == v] for v in (1, 0))
    won, lost = draw.choice(good, quality.PAIRS), draw.choice(bad, quality.PAIRS)
    pairs, w = z[won] - z[lost], np.zeros(13)
    # damped steps to the minimum of the loss, which is convex: whoever finds it finds the same
    loss_gradient = lambda w: -(pairs / (1 + np.exp(pairs @ w))[:, None]).sum(axis=0) + w
    for _ in range(60):
        p = 1 / (1 + np.exp(-(pairs @ w)))
        hessian = np.eye(13) + pairs.T @ (pairs * (p * (1 - p))[:, None])
        w = w - 0.7 * np.linalg.solve(hessian, loss_gradient(w))
    assert np.abs(loss_gradient(w)).max() < 1e-6
    raw = sorted((z @ w).tolist())
    cut, spread = (raw[len(bad) - 1] + raw[len(bad)]) / 2, max(1.0, float(np.std(raw)) / 4)
    got = {r["doc_id"]: r for r in quality.classify(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")).collect()}
    assert set(got) == set(docs)
    for d, (text, _) in docs.items():
        strength = float(((np.array(features(text)) - mean) / scale) @ w)
        score = 1 / (1 + math.exp(-max(-40, min(40, (strength - cut) / spread + math.log(0.3 / 0.7)))))
        assert got[d]["score"] == pytest.approx(score, abs=1e-6) and got[d]["predicted"] == int(got[d]["score"] >= 0.3) and got[d]["held_out"] == held(d)


def trigrams(text):
    raw = text.lower().encode("utf-8", "replace")
    words = "".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in raw).split(" ")
    line = " " + " ".join(w for w in words if w) + " "
    return [((ord(a) << 16 | ord(b) << 8 | ord(c)) * 2654435761 % (1 << 32)) >> 16 for a, b, c in zip(line, line[1:], line[2:], strict=False)]


def test_language_predictions_of_all_rows(spark, tiny, rows):
    docs, _ = rows
    learned = [(lang, trigrams(text), text) for d, (text, lang) in docs.items() if lang is not None and text is not None and not held(d)]
    names = sorted({x[0] for x in learned if x[1]})
    bits = 2 ** (len(names) - 1) - 1
    word = {n: [1 if (b + 1) >> i & 1 else -1 for b in range(bits)] for i, n in enumerate(names)}
    share = {}
    for n in names:
        counts = np.full(1 << 16, 0.02)
        for lang, grams, _ in learned:
            if lang == n:
                np.add.at(counts, grams, 1)
        share[n] = counts / counts.sum()
    weights = []
    for b in range(bits):
        sides = [np.mean([share[n] for n in names if word[n][b] == v], axis=0) if any(word[n][b] == v for n in names) else None for v in (1, -1)]
        weights.append((np.log(sides[0]) - np.log(sides[1])).astype(np.float32).astype(float) if sides[0] is not None and sides[1] is not None else np.zeros(1 << 16))
    margins = lambda grams: [sum(w[grams].tolist()) / max(len(grams), 1) * math.sqrt(min(len(grams), 400)) for w in weights]
    right = {n: [[] for _ in range(bits)] for n in names}
    for lang, grams, text in learned:
        if any(c.isalpha() for c in text):
            for b, m in enumerate(margins(grams)):
                right[lang][b].append(m * word[lang][b] > 0)
    trust = {n: [max(sum(h) / len(h), 0.01) for h in right[n]] for n in names}
    told = {}
    for d, (text, _) in docs.items():
        if not text or not any(c.isalpha() for c in text):
            told[d] = ("und", 0.0)
            continue
        m = margins(trigrams(text))
        loss = {n: sum(t / sum(trust[n]) * np.logaddexp(0, -c * v) for t, c, v in zip(trust[n], word[n], m, strict=True)) for n in names}
        best = min(names, key=lambda n: (loss[n], n))
        told[d] = (best, 1 / sum(math.exp(-4 * (loss[n] - loss[best])) for n in names))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.read.parquet(f"{tiny}/documents.parquet")).collect()}
    assert set(got) == set(told)
    for d in told:
        assert got[d][0] == told[d][0] and got[d][1] == pytest.approx(told[d][1], abs=1e-5)
