"""Sampled SentencePiece segmentations that repeat from run to run, and lossless decoding.

A text's lattice has an edge for every vocabulary piece that matches at a place, and one of byte pieces
for every character. Forward filtering sums the weights of all paths to each place; backward
sampling then draws the last piece of the text by its share of that sum, and so on to the start. The draws
come from a counter hashed with the row's key.

Where no piece of the vocabulary reaches over a place (before a word mark, before a closing mark, around a line
end), the lattice falls apart: the forward sums of such a segment are computed once in a task, and the
draws of all segments of a batch advance together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.near_dedup import mix
from quern.llm.scratch import unused

MARK = "▁"
#: Weight of a piece: -TEMPER * log(its place in the vocabulary + OFFSET); of a byte: as of the last place, each.
TEMPER, OFFSET = 1.0, 10.0
#: Lattice places that a worker keeps, and rows of a batch that are drawn together.
PLACES_KEPT, TOGETHER = 1_000_000, 256
_SLOTS, _SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)


def closing_marks(pieces: list[str]) -> str:
    """The ASCII marks that no piece has after a letter or digit."""
    after = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
    return "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after)


class Lattice:
    """Forward sums of segments, grown as segments are met.

    A place is a position in a segment. Its edges lie together from ``first[place]`` on, longest piece first: ``until``
    is the share of the forward sum up to and including the edge, ``piece`` the edge's piece (or -1 - a character's code point
    for its bytes) and ``back`` the place before (-1: the start).
    """

    def __init__(self, model: str, temper: float = TEMPER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte = np.zeros(256, dtype=np.int64)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.surface: list[bytes] = [b""] * n
        weight = lambda i: -temper * float(np.log(i + OFFSET))
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte[value], self.surface[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[text] = (i, weight(i))
                self.surface[i] = text.replace(MARK, " ").encode()
        self.byte_weight = weight(n)
        self.longest = max(map(len, self.pieces))
        # the lattice falls apart where a segment starts: no piece reaches over such a place
        cut, word = re.escape(closing_marks(list(self.pieces))) or "\n", r"[^\W_]"
        self.segments = re.compile(
            rf"{MARK}*{word}+(?=[{MARK}\n{cut}]|\Z)|{MARK}*[^{MARK}\n]+?(?:(?<={word})(?=[{cut}])|(?=[{MARK}\n])|\Z)|{MARK}+|\n"
        ).findall
        self._grow_trie()
        self.clear()

    def _grow_trie(self) -> None:
        """Nodes are the prefixes of pieces; a hashed table leads from (node, class of a character) to the next node."""
        letters = sorted({c for p in self.pieces for c in p})
        self.kind = np.zeros(0x110000, dtype=np.int64)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes = {"": 0}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.node_piece, self.node_weight = np.full(len(nodes), -1, dtype=np.int64), np.zeros(len(nodes))
        for p, (i, w) in self.pieces.items():
            self.node_piece[nodes[p]], self.node_weight[nodes[p]] = i, w
        self.slot_key, self.slot_node = np.full(1 << _SLOTS, -1, dtype=np.int64), np.zeros(1 << _SLOTS, dtype=np.int64)
        for prefix, node in nodes.items():
            if prefix:
                key = nodes[prefix[:-1]] << 21 | int(self.kind[ord(prefix[-1])])
                at = int(self._slot(np.array([key]))[0])
                while self.slot_key[at] >= 0:
                    at = (at + 1) & ((1 << _SLOTS) - 1)
                self.slot_key[at], self.slot_node[at] = key, node

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _next(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The node that follows by a character, -1 if none does."""
        key = node << 21 | kind
        at, out = self._slot(key), np.full(len(key), -1, dtype=np.int64)
        left = np.arange(len(key))
        while len(left):
            held = self.slot_key[at[left]]
            hit = held == key[left]
            out[left[hit]] = self.slot_node[at[left[hit]]]
            left = left[~hit & (held >= 0)]
            at[left] = (at[left] + 1) & ((1 << _SLOTS) - 1)
        return out

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.places = self.edges = 0
        self.first = np.zeros(0, dtype=np.int64)
        self.until, self.piece, self.back = np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held[:at], np.zeros((at + len(values)) * 5 // 4 - at, dtype=held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def learn(self, segments: list[str]) -> None:
        """Forward filtering of new segments, all of them position by position together."""
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        size = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        begin = np.cumsum(size) - size
        n, inside = len(code), np.arange(len(code)) - np.repeat(begin, size)
        stop_at, kind = np.repeat(begin + size, size), self.kind[code]
        starts, widths, pieces, weights = [], [], [], []
        alive, node = np.arange(n), np.zeros(n, dtype=np.int64)
        for d in range(self.longest):
            fits = alive + d < stop_at[alive]
            alive, node = alive[fits], node[fits]
            node = self._next(node, kind[alive + d])
            alive, node = alive[node >= 0], node[node >= 0]
            own = self.node_piece[node] >= 0
            starts.append(alive[own])
            widths.append(np.full(int(own.sum()), d + 1))
            pieces.append(self.node_piece[node[own]])
            weights.append(self.node_weight[node[own]])
            if not len(alive):
                break
        order = slice(None, None, -1)  # longest first; bytes last
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        start, width = np.concatenate([*starts[order], np.arange(n)]), np.concatenate([*widths[order], np.ones(n, dtype=np.int64)])
        piece, weight = np.concatenate([*pieces[order], -1 - code]), np.concatenate([*weights[order], self.byte_weight * n_bytes])
        stop = start + width - 1  # the place is named by the last character before it
        by = np.argsort(inside[stop] * n + stop, kind="stable")
        start, stop, piece, weight = start[by], stop[by], piece[by], weight[by]
        fresh = np.flatnonzero(np.diff(stop, prepend=-1))  # the first edge of each place, places in the order of the walk
        many = np.diff(np.append(fresh, len(stop)))
        place = stop[fresh]
        depth = inside[place]
        cuts = np.searchsorted(depth, np.arange(int(depth.max()) + 2))
        total, part = np.zeros(n), np.empty(len(stop))
        for j in range(len(cuts) - 1):
            p0, p1 = cuts[j], cuts[j + 1]
            e0, e1 = fresh[p0], fresh[p1] if p1 < len(fresh) else len(stop)
            from_start = inside[start[e0:e1]] == 0
            x = weight[e0:e1] + np.where(from_start, 0.0, total[start[e0:e1] - 1])
            at = fresh[p0:p1] - e0
            top = np.maximum.reduceat(x, at)
            share = np.exp(x - np.repeat(top, many[p0:p1]))
            whole = np.add.reduceat(share, at)
            total[place[p0:p1]] = top + np.log(whole)
            part[e0:e1] = share / np.repeat(whole, many[p0:p1])
        sums = np.cumsum(part)
        until = sums - np.repeat(sums[fresh] - part[fresh], many)
        until[np.append(fresh[1:], len(stop)) - 1] = 2.0  # the last edge takes what rounding leaves
        first = np.empty(n, dtype=np.int64)
        first[place] = fresh + self.edges
        back = np.where(inside[start] == 0, -1, start - 1 + self.places)
        self._append("first", self.places, first)
        for name, values in (("until", until), ("piece", piece), ("back", back)):
            self._append(name, self.edges, values)
        self.ends.update(zip(segments, (begin + size - 1 + self.places).tolist(), strict=True))
        self.places += n
        self.edges += len(stop)

    def last_places(self, segments: list[str]) -> np.ndarray:
        """The last place of each segment."""
        ends = self.ends
        new = list({s for s in segments if s not in ends})
        for at in range(0, len(new), 8_000):
            self.learn(new[at : at + 8_000])
        return np.fromiter(map(ends.__getitem__, segments), dtype=np.int64, count=len(segments))

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """The drawn piece ids of each text; the draws depend on key, seed and the place in the text alone."""
        if self.places > PLACES_KEPT:
            self.clear()
        split = [None if MARK in t else self.segments((MARK + t).replace(" ", MARK)) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, s in enumerate(split) if s is not None]
        for i in range(len(texts)):
            if split[i] is None:
                out[i] = self._with_marks(texts[i], keys[i], seed)
        many = np.array([len(split[i]) for i in plain], dtype=np.int64)
        place = self.last_places([s for i in plain for s in split[i]])
        number = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        ids, per_segment = self._draw(place, np.repeat(keys[plain], many), number, seed)
        per_text = np.add.reduceat(np.append(per_segment, 0), np.cumsum(many) - many)[: len(plain)] if len(plain) else many
        for i, part in zip(plain, np.split(ids, np.cumsum(per_text)[:-1]), strict=True) if plain else ():
            out[i] = part
        return out

    def _with_marks(self, text: str, key: int, seed: int) -> np.ndarray:
        """A text that itself holds the mark: its parts between the marks, each with a key of its own, and bytes for the marks."""
        parts, mark = text.split(MARK), self.byte[list(MARK.encode())]  # so that decoding tells it from a space
        keys = mix(np.full(len(parts), key).view(np.uint64), np.arange(len(parts)), 5)
        segments = [self.segments(((" " if k == 0 else "") + p).replace(" ", MARK)) for k, p in enumerate(parts)]
        out = []
        for k, found in enumerate(segments):
            out += [mark] if k else []
            if found:
                out.append(self._draw(self.last_places(found), np.repeat(keys[k : k + 1], len(found)), np.arange(len(found)), seed)[0])
        return np.concatenate(out)

    def _draw(self, place: np.ndarray, keys: np.ndarray, number: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in order, number of ids of each) by backward sampling from each last place."""
        counter = mix(keys, number, seed)
        n, alive, steps = len(place), np.arange(len(place)), []
        place, depth = place.copy(), np.zeros(n, dtype=np.int64)
        while len(alive):
            u = (mix(counter[alive], len(steps)) >> np.uint64(40)) / np.float32(1 << 24)
            at = self.first[place[alive]]
            late = np.flatnonzero(u >= self.until[at])
            while len(late):
                at[late] += 1
                late = late[u[late] >= self.until[at[late]]]
            steps.append((alive, self.piece[at]))
            depth[alive] += 1
            before = self.back[at]
            place[alive] = before
            alive = alive[before >= 0]
        begin = np.cumsum(depth) - depth
        drawn = np.empty(int(depth.sum()), dtype=np.int64)
        for k, (row, ids) in enumerate(steps):  # the last piece was drawn first
            drawn[begin[row] + depth[row] - 1 - k] = ids
        if not (drawn < 0).any():
            return drawn, depth
        width = np.ones(len(drawn), dtype=np.int64)
        spelled = {c: self.byte[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in np.unique(drawn[drawn < 0]).tolist()}
        for c, ids in spelled.items():
            width[drawn == c] = len(ids)
        ids = np.repeat(drawn, width)
        starts = np.cumsum(width) - width
        for c, own in spelled.items():
            for k, value in enumerate(own):
                ids[starts[drawn == c] + k] = value
        total = np.append(np.cumsum(width), 0)
        ends = np.cumsum(depth)
        upto = np.where(ends > 0, total[ends - 1], 0)
        return ids, np.diff(upto, prepend=0)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sampled segmentation: pieces joined, without the mark put before the text."""
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


#: Lattices of this worker process, kept between its tasks.
_LATTICES: dict[tuple[str, float], Lattice] = {}
#: What segmenting adds to a row.
ADDED = {"pieces": "array<int>", "ids_crc32": "bigint", "decoded_crc32": "bigint", "lossless": "boolean"}


def segment(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 17, temper: float = TEMPER) -> DataFrame:
    """``docs`` with a sampled segmentation of each whole text in ``pieces``, its ids_crc32 (of little-endian 32-bit ids),
    the decoded text's decoded_crc32 and whether it is the text (lossless).

    The draw depends on the row's key (a whole number; null counts as -1), its text and ``seed``, not on where the row
    is processed. Null texts have null in all new columns; an empty text has the lone mark that begins every text. Columns of
    ``docs`` with the names of the new ones are replaced. An empty table gives no rows.
    """

    kept = [c for c in docs.columns if c not in ADDED]
    (own_key,) = unused(docs, "sample_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _LATTICES.get((model, temper)) or _LATTICES.setdefault((model, temper), Lattice(model, temper))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column(text).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None]
                keys = np.array([-1 if k is None else k for k in part.column(own_key).to_pylist()], dtype=np.int64).view(np.uint64)
                drawn = lattice.sample([texts[i] for i in known], keys[known], seed) if known else []
                ids, crc, of_text, same = ([None] * len(texts) for _ in range(4))
                for i, own in zip(known, drawn, strict=True):
                    back = lattice.decode(own)
                    ids[i], crc[i] = own.astype(np.int32), zlib.crc32(own.astype("<u4").tobytes())
                    of_text[i], same[i] = zlib.crc32(back.encode("utf-8", "surrogatepass")), back == texts[i]
                new = [pa.array(ids, pa.list_(pa.int32())), pa.array(crc, pa.int64()), pa.array(of_text, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], *ADDED])

    keyed = docs.select(*kept, F.col(key).cast("bigint").alias(own_key))
    schema = T.StructType([*docs.select(*kept).schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in ADDED.items())).fields])
    return keyed.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pieces, ids_crc32, decoded_crc32, lossless."""
    out = segment(docs.select("doc_id", "text"), model, seed=seed)
    return out.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "ids_crc32", "decoded_crc32", "lossless")
