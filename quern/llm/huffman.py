"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

A file is a Parquet table whose rows are blocks. A block holds whole documents in ascending doc_id
order: their ids, lengths, the packed code bits, and the bit offset of every ``EVERY``-th id. A block is
decoded by itself, with one table for the whole file; from the offsets all its stretches are decoded
side by side, a table lookup each step.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

#: Ids in a block (at least, unless it is the last of its part), ids between two bit offsets, id ending a document.
BLOCK_IDS, EVERY, END_ID = 1 << 17, 128, 0
#: Blocks of the least size that are decoded together.
SIDE_BY_SIDE = 8
#: Pieces that a worker's encoder remembers, and bytes of text that it encodes together.
REMEMBERED, TOGETHER = 900_000, 16 << 20
#: Pieces of text sent to the library as one, and ids of the longest piece that outlives a trim.
JOINED, LONGEST = 200, 32
#: Classes of bytes: Latin letters, ASCII marks without the apostrophe, line ends, spaces, other characters that aren't white space, and other white space.
_LETTER, _MARK, _LINE_END, _SPACE, _OTHER, _WHITE = range(6)
_CLASSES = 6
#: Bytes whose class depends on their neighbours: continuation bytes, and first bytes of characters that may be letters or white space.
_OPEN = 64
#: A piece without white space but for a space at its begin.
_PIECE = re.compile(r"( ?)\S+\Z").match


def _byte_classes() -> bytes:
    def of(b: int) -> int:
        if b >= 0x80:
            return _OPEN if b < 0xC0 or 0xC2 <= b <= 0xC8 or 0xE1 <= b <= 0xE3 else _OTHER
        c = chr(b)
        if c == " ":
            return _SPACE
        if c == "\n":
            return _LINE_END
        return _WHITE if c.isspace() else _LETTER if c.isalpha() else _MARK if c.isprintable() and not c.isdigit() and c != "'" else _OTHER

    return bytes(map(of, range(256)))


def _breaks() -> bytes:
    """By the classes of a byte (weight 6), the one before (1) and the one after (36): 1 for a break before the byte, 2 for one after it.

    The pre-tokenizer always breaks between letters and marks, before a space between characters that aren't white space, and on both
    sides of a line end between letters or marks; what stands on either side has no influence on the other.
    """
    word, solid = (_LETTER, _MARK), (_LETTER, _MARK, _OTHER)
    out = bytearray(256)
    for code in range(_CLASSES**3):
        before, own, after = code % _CLASSES, code // _CLASSES % _CLASSES, code // _CLASSES**2
        if own == _LINE_END and before in word and after in word:
            out[code] = 3
        elif own == _SPACE and before in solid and after in solid or own in word and before in word and own != before:
            out[code] = 1
    return bytes(out)


_BYTE_CLASS, _BREAK = _byte_classes(), _breaks()


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts; all bytes of a character have the same."""
    found = np.frombuffer(bytearray(data.tobytes().translate(_BYTE_CLASS)), dtype=np.uint8)
    at = np.flatnonzero(found == _OPEN)
    if len(at):
        back = data[at] < 0xC0
        at, rest = at[~back], at[back]
        found[rest] = _OTHER
        held = np.append(data, np.zeros(2, dtype=np.uint8))
        a, b, c = held[at], held[at + 1], held[at + 2]
        letter = (a >= 0xC3) & (a <= 0xC8) & ((a > 0xC3) | (b != 0x97) & (b != 0xB7))
        white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        own = np.where(letter, _LETTER, np.where(white, _WHITE, _OTHER)).astype(np.uint8)
        found[at], found[at + 1] = own, own
        wide = at[a >= 0xE0]
        found[wide + 2] = own[a >= 0xE0]
    return found


class ChunkEncoder:
    """Texts to ids through the tokenizers library, remembering the ids of pieces seen before.

    Texts are cut where the byte-level pre-tokenizer always breaks (``_breaks``), told from the classes of neighbouring bytes. Each
    distinct piece is encoded once by the library and what it gave is joined; what stands between two sure breaks stays a piece, whatever it
    is. A text with one of the vocabulary's special strings is one piece. Pieces are cut, counted and joined as Arrow and NumPy arrays; only
    distinct ones become Python strings.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.model._resize_cache(0)  # a piece comes once
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u4" if size > 1 << 16 else "<u2"
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else -1  # without an id of its own nothing is found and pieces are encoded by themselves
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces; entry 0 is the end id."""
        self.known: dict[str, int] = {}
        self.ids, self.used = np.full(1 << 16, END_ID, dtype=self.dtype), 1
        self.start, self.size, self.entries = np.zeros(1 << 16, dtype=np.int64), np.ones(1 << 16, dtype=np.int64), 1
        self.seen = np.zeros(1 << 16, dtype=np.int64)

    def trim(self) -> None:
        """Forgets pieces that came in one part of the input only, and all if too many are left."""
        kept = [(piece, k) for piece, k in self.known.items() if self.seen[k] > 1 and self.size[k] <= LONGEST]
        ids, start, size = self.ids, self.start, self.size
        self.clear()
        if kept and len(kept) <= REMEMBERED // 2:
            at = np.array([k for _, k in kept])
            flat = np.repeat(start[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
            self.known.update(zip([piece for piece, _ in kept], self._add(ids[flat], size[at]), strict=True))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.fromiter(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _room(held: np.ndarray, used: int, more: int) -> np.ndarray:
        return held if used + more <= len(held) else np.concatenate([held[:used], np.zeros((used + more) // 2 + more, dtype=held.dtype)])

    def _add(self, flat: np.ndarray, size: np.ndarray) -> range:
        """Stores ids; their entries."""
        self.ids = self._room(self.ids, self.used, len(flat))
        self.start, self.size, self.seen = (self._room(x, self.entries, len(size)) for x in (self.start, self.size, self.seen))
        self.ids[self.used : self.used + len(flat)] = flat
        own = range(self.entries, self.entries + len(size))
        self.start[own.start : own.stop], self.size[own.start : own.stop], self.seen[own.start : own.stop] = np.cumsum(size) - size + self.used, size, 0
        self.used, self.entries = self.used + len(flat), own.stop
        return own

    def _keep(self, pieces: list[str], found: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.known.update(zip(pieces, self._add(np.concatenate(found), size), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, many in a text: those with a space before them begin at a token that begins with one, others follow a line end."""
        kinds: dict[str | None, list[str]] = {" ": [], "": [], None: []}
        for piece in pieces:
            found = _PIECE(piece)
            kinds[found and found[1]].append(piece)
        for kind, between in ((" ", ""), ("", "\n")):
            for at in range(0, len(kinds[kind]), JOINED):
                part = kinds[kind][at : at + JOINED]
                flat = self._whole([between + between.join(part)])[0]
                begins = self.spaced[flat] if kind else flat == self.line_end
                begin = np.flatnonzero(begins)
                if len(begin) != len(part) or begin[0]:
                    self._keep(part, self._whole(part))
                    continue
                size = np.diff(begin, append=len(flat))
                self.known.update(zip(part, self._add(flat, size) if kind else self._add(flat[~begins], size - 1), strict=True))
        if kinds[None]:
            self._keep(kinds[None], self._whole(kinds[None]))

    def _entries(self, coded: pa.DictionaryArray) -> np.ndarray:
        """The entry of each piece."""
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        if None in found:
            new = [k for k, x in enumerate(found) if x is None]
            self._learn([distinct[k] for k in new])
            for k in new:
                found[k] = self.known[distinct[k]]
        entries = np.array(found, dtype=np.int32)
        self.seen[entries] += 1
        return entries[np.asarray(coded.indices)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, number of ids of each); null is an empty text."""
        if self.entries > REMEMBERED or self.used > 16 * REMEMBERED:
            self.trim()
        texts = column.fill_null("").cast(pa.large_string())
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = np.full(len(data) + 2, _WHITE, dtype=np.uint8)
        kinds[1:-1] = byte_classes(data)
        found = np.frombuffer((kinds[:-2] + kinds[1:-1] * _CLASSES + kinds[2:] * _CLASSES**2).tobytes().translate(_BREAK), dtype=np.uint8)
        begins = (found & 1).astype(bool)
        begins[1:] |= found[:-1] > 1
        for row in np.flatnonzero(self._special(texts)):
            begins[offsets[row] : offsets[row + 1]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.searchsorted(starts, offsets[1:])
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        entry = np.insert(self._entries(pieces.dictionary_encode()), ends, 0)
        size = self.size[entry].astype(np.int32)
        to = np.cumsum(size, dtype=np.int64)
        at = np.repeat((self.start[entry] - to + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], np.diff(to[ends + np.arange(len(ends))], prepend=0)

    def _special(self, texts: pa.Array) -> np.ndarray:
        """Whether a text has one of the vocabulary's special strings."""
        found = np.zeros(len(texts), dtype=bool)
        for special in self.specials:
            found |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        return found


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        is_leaf.append(at < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for level in reversed(is_leaf):  # the cheapest leaves of each level get one more bit
        chosen = int(level[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Code:
    """A canonical code: for each symbol (ascending) its length and bits."""

    symbols: np.ndarray
    lengths: np.ndarray
    limit: int

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray) -> Code:
        limit = max(16, int(np.ceil(np.log2(max(len(symbols), 2)))) + 1)
        return cls(symbols.astype(np.int64), code_lengths(counts, limit), limit)

    def _canonical(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.symbols, self.lengths))
        starts = np.concatenate([[0], np.cumsum(1 << (self.limit - self.lengths[order]))])
        return order, starts

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits, length) by symbol value."""
        order, starts = self._canonical()
        size = int(self.symbols.max(initial=0)) + 1
        bits, lengths = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        bits[self.symbols[order]] = starts[:-1] >> (self.limit - self.lengths[order])
        lengths[self.symbols] = self.lengths
        return bits, lengths

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) by the next ``limit`` bits."""
        order, _ = self._canonical()
        width = 1 << (self.limit - self.lengths[order])
        symbol, length = np.repeat(self.symbols[order], width), np.repeat(self.lengths[order], width)
        spare = (1 << self.limit) - len(symbol)
        return np.pad(symbol, (0, spare)).astype(np.uint32), np.pad(length, (0, spare), constant_values=1).astype(np.int64)


def pack(ids: np.ndarray, bits: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(code bits, bit offsets of every ``EVERY``-th id) of a block's ids; codes have at most 25 bits."""
    if not len(ids):
        return b"", b""
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    held = bits[ids] << (64 - n - (at & 31)).astype(np.uint64)  # from the begin of the 32-bit word that the code begins in into the next
    first = np.flatnonzero(np.diff(at >> 5, prepend=-1))  # a code begins in every word, but for a last one
    out = np.zeros(len(first) + 1, dtype=np.uint64)  # codes share no bit, so adding is or-ing
    out[:-1] = np.add.reduceat(held >> np.uint64(32), first)
    out[1:] += np.add.reduceat(held & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) >> 3], at[::EVERY].astype("<u8").tobytes()


def unpack(payload: bytes, offsets: bytes, n_ids: int, symbol: np.ndarray, length: np.ndarray, limit: int) -> np.ndarray:
    """The ids of a block."""
    return unpack_all([payload], [offsets], [n_ids], symbol, length, limit)[0]


def unpack_all(payloads: list[bytes], offsets: list[bytes], n_ids: list[int], symbol: np.ndarray, length: np.ndarray, limit: int) -> list[np.ndarray]:
    """The ids of each block; the stretches of all blocks are decoded side by side."""
    raw = np.frombuffer(b"".join([*payloads, b"\0" * 8]), dtype=np.uint8).astype(np.uint32)
    word = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    begin = np.cumsum([0, *map(len, payloads)]) * 8
    starts = [np.frombuffer(x, dtype="<u8").astype(np.int64) + b for x, b in zip(offsets, begin, strict=False)]
    at, both = np.concatenate(starts), (symbol.astype(np.int64) << 6) | length
    out, mask = np.zeros((EVERY, len(at)), dtype=np.uint32), np.uint32((1 << limit) - 1)
    for step in range(EVERY):
        window = word.take(at >> 3, mode="clip")
        window >>= (32 - limit - (at & 7)).astype(np.uint32)
        window &= mask
        found = both[window]
        out[step] = found >> 6
        at += found & 63
    cuts = np.cumsum([0, *map(len, starts)])
    return [out[:, a:b].T.reshape(-1)[:n] for a, b, n in zip(cuts, cuts[1:], n_ids, strict=False)]


#: Encoders of this worker process, kept between its tasks.
_ENCODERS: dict[str, ChunkEncoder] = {}
TOKENS = "counted boolean, doc_id long, ids binary"
BLOCKS = "part int, block int, before long, n_ids long, doc_ids binary, doc_known binary, doc_sizes binary, offsets binary, payload binary"


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(counted, doc_id, ids): the ids of every whole text, null as empty, with ``END_ID`` after the last.

    Special strings of the vocabulary are their own ids, as the library has it. ids are 16-bit if the vocabulary allows it, else 32-bit. Each task adds one row, marked as counted, of
    how often each id came (pairs of 64-bit id and count), so that counting needs no pass of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, ChunkEncoder(vocabulary))
        total = np.zeros(max(len(encoder.spaced), END_ID + 1), dtype=np.int64)
        names = ["counted", "doc_id", "ids"]
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64) + 64)
            cuts = [0, *(np.flatnonzero(np.diff((sizes - 1) // TOGETHER)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, to - at)
                if part.num_rows:
                    ids, many = encoder.encode(part.column(1))
                    total += np.bincount(ids, minlength=len(total))
                    cuts_at = np.append(0, np.cumsum(many * ids.itemsize)).astype("<i8")
                    held = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(cuts_at), pa.py_buffer(ids)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(many), dtype=bool)), part.column(0).cast(pa.int64()), held], names=names)
        at = np.flatnonzero(total)
        if len(at):
            told = np.stack([at, total[at]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([told], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def _id_type(vocabulary: str) -> str:
    from tokenizers import Tokenizer

    return "<u4" if Tokenizer.from_file(vocabulary).get_vocab_size() > 1 << 16 else "<u2"


def count_ids(tokens: DataFrame) -> pd.DataFrame:
    """id and n over the whole table: the tasks' counts, summed by Spark; at most a row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in batch.column(0).to_pylist():
                at, n = np.frombuffer(told, dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["id", "n"])

    counted = tokens.filter("counted").select("ids").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")


def write_blocks(tokens: DataFrame, code: Code, dtype: str) -> DataFrame:
    """The blocks of all documents: parts are ranges of doc_id, blocks follow each other inside a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, (bits, lengths) = TaskContext.get().partitionId(), code.tables()
        held: list[tuple[int | None, np.ndarray]] = []
        size = before = block = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, offsets = pack(ids, bits, lengths)
            values = {
                "part": part, "block": block, "before": before, "n_ids": len(ids), "doc_ids": np.array([d or 0 for d, _ in held], dtype="<i8").tobytes(),
                "doc_known": np.array([d is not None for d, _ in held], dtype=np.uint8).tobytes(), "doc_sizes": np.array([len(x) for _, x in held], dtype="<u8").tobytes(),
                "offsets": offsets, "payload": payload,
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values.values(), kinds, strict=True)], names=list(values))

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, np.frombuffer(ids, dtype=dtype)))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield row()
                    before, block, size, held = before + size, block + 1, 0, []
        if held:
            yield row()

    ordered = tokens.filter("not counted").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, BLOCKS)


def read_documents(blocks: DataFrame, code: Code) -> DataFrame:
    """Decodes files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A part's start is the sum of the parts before it; the table of parts has a row for each range of doc_id,
    as many as shuffle partitions.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    placed = blocks.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "n_ids", "doc_ids", "doc_known", "doc_sizes", "offsets", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, length = code.decoder()

        def decoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            total = np.cumsum(batch.column(1).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff((total - 1) // (SIDE_BY_SIDE * BLOCK_IDS))) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                start, n, docs, known, sizes, offsets, payload = [c.to_pylist() for c in batch.slice(at, to - at).columns]
                yield from zip(start, docs, known, sizes, unpack_all(payload, offsets, n, symbol, length, code.limit), strict=True)

        for batch in batches:
            for start, docs, known, sizes, ids in decoded(batch):
                ends = np.cumsum(np.frombuffer(sizes, dtype="<u8").astype(np.int64))
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)]
                doc = pa.array(np.frombuffer(docs, dtype="<i8"), mask=np.frombuffer(known, dtype=np.uint8) == 0)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_files(docs: DataFrame, vocabulary: str, scratch: Scratch) -> tuple[DataFrame, Code]:
    """(the files as read back, their code) of all documents in ascending doc_id order, null doc_id first."""
    dtype = _id_type(vocabulary)
    tokens = scratch.keep(tokenize(docs, vocabulary), "tokens")
    counts = count_ids(tokens)
    code = Code.of(counts["id"].to_numpy(), counts["n"].to_numpy())
    blocks = scratch.keep(write_blocks(tokens, code, dtype), "blocks")
    scratch.drop("tokens")
    return blocks, code


def encode_and_read_back(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are not read): doc_id, start, n_tokens, ids_crc32.

    All values come from the files read back. A null or empty text is the end id alone. Rows that repeat a
    doc_id are separate documents next to each other. An empty table gives no rows.
    """
    blocks, code = write_files(docs, vocabulary, Scratch(docs.sparkSession, "huffman"))
    return read_documents(blocks, code)
