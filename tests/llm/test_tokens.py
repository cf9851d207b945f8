"""Huffman token files against the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quern.llm import huffman

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def by_hand(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows in order of doc_id, by the library alone."""
    tokenizer, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in huffman.encode_and_read_back(docs, VOCABULARY).collect()]
    assert sorted(got) == by_hand(rows)


def test_odd_rows(spark):
    texts = [(0, None), (1, ""), (2, " "), (3, "a  b\n\n c d \t"), (4, "é 日本 😀 I'm they'll"), (5, "long " * 60_000), (6, "x y z"), (7, "<|endoftext|> end"), (8, "a <|endoftext|>\nb  <|endoftext|>"), (9, "one.\nTwo, three!\n\nfour.\n five_six x² don't.\n'll %%% a\tb c\n"), (10, "\n"), (11, "Éa.\nB–c d́e Ⅷ.\nx")]
    docs = spark.createDataFrame([(a, b, "z") for a, b in texts], "doc_id long, text string, start string").repartition(2)
    got = sorted(tuple(r) for r in huffman.encode_and_read_back(docs, VOCABULARY).collect())
    assert got == by_hand(texts)
    twice = spark.createDataFrame([(5, "a b"), (5, "c"), (None, "x")], "doc_id long, text string")
    rows = huffman.encode_and_read_back(twice, VOCABULARY).collect()
    assert len(rows) == 3 and next(r["start"] for r in rows if r["doc_id"] is None) == 0
    assert huffman.encode_and_read_back(docs.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 700])
def test_codes_are_prefix_free_optimal_and_limited(n):
    counts = np.random.default_rng(n).geometric(0.001, n)
    lengths = huffman.code_lengths(counts, 30)
    assert abs(sum(2.0**-lengths) - (1 if n > 1 else 0.5)) < 1e-12
    heap = sorted(counts.tolist())
    cost = 0
    while len(heap) > 1:
        a, b = heap[0], heap[1]
        cost += a + b
        heap = sorted([*heap[2:], a + b])
    assert (lengths * counts).sum() == (cost or counts.sum())
    skewed = np.array([2.0**k for k in range(40)])
    assert huffman.code_lengths(skewed, 12).max() <= 12 and abs(sum(2.0 ** -huffman.code_lengths(skewed, 12)) - 1) < 1e-12


def test_blocks_decode_by_themselves():
    draw = np.random.default_rng(3)
    ids = np.minimum(draw.geometric(0.01, 5000), 60_000)
    symbols, counts = np.unique(ids, return_counts=True)
    code = huffman.Code.of(symbols, counts)
    payload, offsets = huffman.pack(ids, *code.tables())
    assert np.array_equal(huffman.unpack(payload, offsets, len(ids), *code.decoder(), code.limit), ids)
    assert len(offsets) == 8 * -(-5000 // huffman.EVERY)


def library_ids(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def encoded(encoder, texts):
    ids, many = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])]


def test_pieces_of_random_texts_against_the_library():
    signs = [*" \n\t\r\x0b\x1c\x85\xa0 ᠎    　", *"aZé×÷ßȿɀǅ日かß", *".,'!-_|<>'\"", *"07²Ⅷ\x00\x7f́–“😀", "'s", "'ll", " a", " é.", "\nB", ".\n", "<|endoftext|>", "  ", "\n\n"]
    draw = np.random.default_rng(5)
    texts = ["".join(signs[k] for k in draw.integers(0, len(signs), draw.integers(0, 14))) for _ in range(6000)] + [None, "", " ", "\n"]
    encoder = huffman.ChunkEncoder(VOCABULARY)
    assert encoded(encoder, texts) == library_ids(texts)
    assert encoded(encoder, texts[::-1]) == library_ids(texts)[::-1]
    assert encoded(encoder, []) == [[]] and encoded(encoder, [None, ""]) == [[0], [0]]


def test_a_word_is_remembered_once_whatever_stands_around_it():
    words, around = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)], [",", ".", "!", "?!", ".\nThe", ":", ";", ")", "]", "..."]
    text = " ".join(w + a for a in around for w in words)
    encoder = huffman.ChunkEncoder(VOCABULARY)
    assert encoded(encoder, [text]) == library_ids([text])
    assert len(encoder.known) <= len(words) + len(around) + 5


def test_pieces_of_several_parts_outlive_a_trim(monkeypatch):
    encoder = huffman.ChunkEncoder(VOCABULARY)
    for texts in (["an often once"], ["x often, twice"]):
        encoded(encoder, texts)
    encoder.trim()
    assert set(encoder.known) == {" often"}
    monkeypatch.setattr(huffman, "REMEMBERED", 3)
    for texts in (["a b c d"], ["c d e f"], ["a d"], ["d"]) * 3:
        assert encoded(encoder, texts) == library_ids(texts)


def test_blocks_are_decoded_side_by_side():
    draw = np.random.default_rng(4)
    blocks = [np.minimum(draw.geometric(0.01, n), 60_000) for n in (1, 127, 128, 129, 40_000)]
    symbols, counts = np.unique(np.concatenate(blocks), return_counts=True)
    code = huffman.Code.of(symbols, counts)
    packed = [huffman.pack(b, *code.tables()) for b in blocks]
    got = huffman.unpack_all([p for p, _ in packed], [o for _, o in packed], list(map(len, blocks)), *code.decoder(), code.limit)
    assert all(np.array_equal(a, b) for a, b in zip(got, blocks, strict=True))
