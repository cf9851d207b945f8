"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Documents with the same set are one class, and every
class has a sketch of minwise values. In each of ``TREES`` independent trees the classes branch by minwise values at
coordinates that the node chooses: 1.25 of them on average, one over the threshold, so that a pair at the threshold
keeps one common path in expectation. The number of trees follows from ``RECALL``: the share of pairs at the threshold
that meet in some small node, if a path has ``LEVELS`` levels.

Only components are wanted, so nothing is compared twice to say the same. A first pass over a few trees follows single
paths, compares each class with a few others of its nodes and keeps the best two: the links found so
join most of any large group. The second and the third pass run all trees over what is left: a node whose classes are in one
component already is dropped, one with at most ``LEAF`` classes outside its largest component is compared exhaustively (those
against all of it), and any other branches on. The second keeps the best few pairs between two components, the third all. The
passes compare sketches; a pair is linked only when its full sets are similar enough, and each pass starts from the links so far.
Work is the number of memberships in nodes times a constant, and the pairs that a node gives go to no single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.scratch import Scratch

#: Minwise values of a sketch; classes outside a node's largest component that are compared with all of it.
COORDINATES, LEAF = 128, 16
#: The share of pairs at the threshold that is to meet in a small node, and the levels of a path for which it holds.
RECALL, LEVELS, THRESHOLD = 0.9995, 12, 0.8
#: Classes of a node that one task follows down to the small nodes; a larger one branches in Spark.
NODE = 4096
#: Levels below which a node that one task holds is compared exhaustively whatever it has outside.
DEEP = 24
#: The first pass: its trees, the levels that it follows, the neighbours that a class is compared with in a large node, the best that it keeps.
FIRST_TREES, FIRST_LEVELS, NEIGHBOURS, BEST = 6, 10, 4, 2
#: The best between two components that the second pass keeps.
BETWEEN = 4
#: Pairs whose sketches agree in a smaller share than the threshold less this are not looked at (3.6 standard deviations).
SLACK = 0.13
#: Pairs compared in one step; rows that a task follows together.
TOGETHER, HELD = 1 << 15, 1 << 13
#: Lowest hashes of a set by which the third pass looks closer, and what they may tell too little (3.6 standard deviations; small sets are told whole).
BOTTOM, BOTTOM_SLACK = 256, 0.09
_WORDS_KEPT = 100_000
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(*parts) -> np.ndarray:
    """A 64-bit hash of columns of integers."""
    out = np.full(1, 0x1234567, dtype=np.uint64)
    for part in parts:
        out = (out ^ np.asarray(part).astype(np.uint64)) * _M1
        out = (out ^ (out >> np.uint64(33))) * _M2
        out = out ^ (out >> np.uint64(29))
    return out


class _WordHash(dict):
    """64-bit hashes of words, remembered for the words of one worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHash()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words.

    Words are runs of characters other than space and U+0009 to U+000D after lower-casing A-Z; with
    fewer than ``width`` words the whole sequence is the one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = mix(hashed[:n], width)
    for j in range(1, width):
        out = mix(out, hashed[j : j + n])
    return np.unique(out)


_MULTIPLIERS = mix(np.arange(COORDINATES), 99) | np.uint64(1)


def sketch(values: np.ndarray) -> np.ndarray:
    """``COORDINATES`` minwise values (32 bits) of a set."""
    lowest = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(values), 8192):
        part = values[None, at : at + 8192]
        for k in range(0, COORDINATES, 16):
            low = ((part * _MULTIPLIERS[k : k + 16, None]) >> np.uint64(32)).min(axis=1)
            lowest[k : k + 16] = np.minimum(lowest[k : k + 16], low)
    return lowest.astype(np.uint32)


def survival(levels: int, share: float) -> float:
    """The chance that two classes whose sketches agree in ``share`` of the coordinates have a common path of ``levels`` levels in a tree."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - (1 - share * alive) * (1 - 0.25 * share * alive)
    return alive


def trees_for(recall: float, levels: int, threshold: float) -> int:
    """Independent trees by which a pair at the threshold is met with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - survival(levels, threshold)))


TREES = trees_for(RECALL, LEVELS, THRESHOLD)


def children(nodes: np.ndarray, sketches: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of each branch: a node always takes one coordinate, one in four takes a second (unless ``single``)."""
    rows = np.arange(len(nodes))
    first = (mix(nodes, 7) % np.uint64(COORDINATES)).astype(np.int64)
    more = np.flatnonzero((mix(nodes, 8) % np.uint64(4) == 0) & (not single))
    second = (mix(nodes[more], 9) % np.uint64(COORDINATES)).astype(np.int64)
    row, at = np.concatenate([rows, more]), np.concatenate([first, second])
    return row, mix(nodes[row], at, sketches[row, at])


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, fingerprint of the set (null if empty), low bytes of the sketch, second-level nodes of the first trees and of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in batches:
            for at in range(0, len(part), 1000):
                piece = part.iloc[at : at + 1000]
                sets = [shingle_set(t, width) for t in piece["text"]]
                sketches = np.array([sketch(s) for s in sets], dtype=np.uint32).reshape(len(sets), COORDINATES)
                held: tuple[list, list] = ([[] for _ in sets], [[] for _ in sets])
                for tree in range(TREES):
                    root, at_top = mix(tree, 1)[0], int(mix(tree, 2)[0] % np.uint64(COORDINATES))
                    row, child = children(mix(np.full(len(sets), root), at_top, sketches[:, at_top]), sketches)
                    of = held[tree >= FIRST_TREES]
                    for r, node in zip(row.tolist(), child.view(np.int64).tolist(), strict=True):
                        of[r].append(node)
                yield pd.DataFrame(
                    {
                        "doc_id": piece["doc_id"].to_numpy(),
                        "n": [len(s) for s in sets],
                        "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "low": [s.astype(np.uint8).tobytes() for s in sketches],
                        "first": held[0],
                        "others": held[1],
                    }
                )

    schema = "doc_id long, n long, fp binary, low binary, first array<long>, others array<long>"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


class Members:
    """Classes met in nodes: rep, n, sketch and component, by row."""

    def __init__(self, rep: np.ndarray, n: np.ndarray, low: np.ndarray, component: np.ndarray, threshold: float, bottom: np.ndarray | None = None):
        self.rep, self.n, self.low, self.component, self.threshold, self.bottom = rep, n, low, component, threshold, bottom

    def alike(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows in different components whose sizes and sketches allow a link, and the share in which the sketches agree."""
        fit = (self.component[x] != self.component[y]) & (self.rep[x] != self.rep[y])
        x, y = x[fit], y[fit]
        fit = np.minimum(self.n[x], self.n[y]) >= self.threshold * np.maximum(self.n[x], self.n[y]) - 1e-6
        x, y = x[fit], y[fit]
        share = (self.low[x] == self.low[y]).mean(axis=1)
        fit = share >= self.threshold - SLACK
        x, y, share = x[fit], y[fit], share[fit]
        if self.bottom is not None:
            fit = np.concatenate([np.zeros(0, dtype=bool), *[self._near(x[at : at + 4096], y[at : at + 4096]) for at in range(0, len(x), 4096)]])
            x, y, share = x[fit], y[fit], share[fit]
        return x, y, share

    def _near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By the ``BOTTOM`` lowest hashes of both sets, which are all of a small set: those of the union that are in both."""
        both = np.sort(np.concatenate([self.bottom[x], self.bottom[y]], axis=1), axis=1)
        twice = both[:, 1:] == both[:, :-1]
        real = both[:, :-1] != 0xFFFFFFFF
        rank = np.cumsum(~twice, axis=1)  # distinct hashes up to here; a pair of equal ones counts at the second
        cut = (self.n[x] > BOTTOM) | (self.n[y] > BOTTOM)
        within = np.where(cut, BOTTOM, 2 * BOTTOM)
        common = (twice & real & (rank < within[:, None])).sum(axis=1)
        union = np.where(cut, BOTTOM, self.n[x] + self.n[y] - common)
        return common >= (self.threshold - np.where(cut, BOTTOM_SLACK, 0.005)) * union


def _exhaustive(members: Members, row: np.ndarray, start: np.ndarray, size: np.ndarray, outside: np.ndarray) -> Iterator[tuple]:
    """All pairs of the rows outside their node's largest component with the rows of the node."""
    own = np.flatnonzero(outside)
    group = np.searchsorted(start, own, side="right") - 1
    many = size[group]
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(many) - 1) // TOGETHER)) + 1), len(own)]
    for at, to in zip(cuts, cuts[1:], strict=False):
        m = many[at:to]
        i = np.repeat(own[at:to], m)
        j = np.repeat(start[group[at:to]], m) + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        once = ~outside[j] | (j > i)
        yield members.alike(row[i[once]], row[j[once]])


def follow(node: np.ndarray, members: Members, complete: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, share): pairs of rows that may be linked, found by branching from ``node`` (of each row) down to small nodes."""
    row, found = np.arange(len(node)), [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
    for depth in range(DEEP + 1 if complete else FIRST_LEVELS):
        order = np.lexsort((members.component[row], node))
        node, row = node[order], row[order]
        component = members.component[row]
        new = np.append(True, node[1:] != node[:-1])[: len(node)]
        run = np.flatnonzero(new | np.append(True, component[1:] != component[:-1])[: len(node)])
        group = np.cumsum(new) - 1
        length, of = np.diff(np.append(run, len(node))), group[run]
        largest = np.lexsort((run, -length, of))  # runs of a node, the longest first
        largest = largest[np.append(True, of[largest][1:] != of[largest][:-1])[: len(largest)]]
        in_run = np.repeat(np.arange(len(run)), length)
        outside = in_run != largest[group] if len(node) else new
        start = np.flatnonzero(new)
        size, out = np.diff(np.append(start, len(node))), np.bincount(group[outside], minlength=len(start))
        small = (out <= LEAF) | (complete and depth == DEEP)
        found += _exhaustive(members, row, start, size, outside & small[group] if len(node) else outside)
        on = ~small[group] if len(node) else new
        node, row = node[on], row[on]
        if not len(row):
            break
        order = np.lexsort((mix(members.rep[row], depth, 3), node))
        node, row = node[order], row[order]
        for step in range(1, NEIGHBOURS + 1):
            same = np.flatnonzero(node[step:] == node[:-step])
            found.append(members.alike(row[same], row[same + step]))
        branch, node = children(node, members.low[row], single=not complete)
        row = row[branch]
        if complete:  # two branches of a node may lead to the same child
            order = np.lexsort((row, node))
            node, row = node[order], row[order]
            keep = np.append(True, (node[1:] != node[:-1]) | (row[1:] != row[:-1]))
            node, row = node[keep], row[keep]
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _best(ends: list[np.ndarray], share: np.ndarray, most: int) -> np.ndarray:
    """Marks the pairs that are among the ``most`` best with the same ``ends``."""
    order = np.lexsort((-share, *ends))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for end in ends:
        new[1:] |= end[order][1:] != end[order][:-1]
    first = np.flatnonzero(new)
    keep = np.zeros(len(order), dtype=bool)
    keep[order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most]] = True
    return keep


def _candidates(rows: DataFrame, threshold: float, complete: bool, keep: str) -> DataFrame:
    """(a, b): pairs of classes of the nodes in ``rows`` (node, rep, n, low, component) that may be linked, a < b.

    ``keep`` is ``ends`` (the best of each class), ``between`` (the best of each two components) or ``all``. ``more`` tells
    that two components had others besides. With a column ``bottom`` in ``rows`` pairs are looked at more closely.
    """
    columns = ["node", "rep", "n", "low", "component", *[c for c in rows.columns if c == "bottom"]]

    def pairs(held: pa.Table) -> pa.RecordBatch:
        low = held.column("low").combine_chunks()
        data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[low.offset * COORDINATES : (low.offset + len(low)) * COORDINATES]
        rep, n, component, node = (held.column(c).to_numpy() for c in ("rep", "n", "component", "node"))
        bottom = None
        if "bottom" in held.column_names:
            bottom = np.full((len(rep), BOTTOM), 0xFFFFFFFF, dtype=np.uint32)
            for i, told in enumerate(held.column("bottom").to_pylist()):
                bottom[i, : len(told) // 4] = np.frombuffer(told, dtype="<u4")
        members = Members(rep, n, data.reshape(-1, COORDINATES), component, threshold, bottom)
        x, y, share = follow(node.view(np.uint64), members, complete)
        a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
        order = np.lexsort((b, a))
        a, b, share = a[order], b[order], share[order]
        once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        a, b, share = a[once], b[once], share[once]
        if keep == "ends":
            best = _best([a], share, BEST) | _best([b], share, BEST)
            a, b = a[best], b[best]
        elif keep == "between":
            x, y = x[order][once], y[order][once]
            ends = [np.minimum(component[x], component[y]), np.maximum(component[x], component[y])]
            best, beyond = _best(ends, share, BETWEEN), ~_best(ends, share, BETWEEN + 1)
            over = set(zip(*[e[beyond].tolist() for e in ends], strict=True))
            a, b, more = a[best], b[best], np.array([t in over for t in zip(*[e[best].tolist() for e in ends], strict=True)], dtype=bool)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more if keep == "between" else np.zeros(len(a), dtype=bool))], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:  # whole nodes only: the last may go on in the next batch
                table = pa.Table.from_batches(held)
                node = table.column("node").to_numpy()
                cut = int(np.searchsorted(node, node[-1])) if node[0] != node[-1] else 0
                if cut:
                    yield pairs(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if held:
            yield pairs(pa.Table.from_batches(held))

    ordered = rows.select(*columns).repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def _branch(large: DataFrame) -> DataFrame:
    """(node, rep, component) one level below ``large`` (node, rep, low, component)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                low = np.frombuffer(b"".join(part["low"]), dtype=np.uint8).reshape(len(part), COORDINATES)
                row, child = children(part["node"].to_numpy().view(np.uint64), low)
                yield pd.DataFrame({"node": child.view(np.int64), "rep": part["rep"].to_numpy()[row], "component": part["component"].to_numpy()[row]})

    return large.select("node", "rep", "low", "component").mapInPandas(run, "node long, rep long, component long").distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (node, rep, component) of the nodes with more than one component, with the node's size."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("low_c"), F.max("component").alias("high_c"))
    return rows.join(sizes.filter("low_c != high_c").select("node", "size"), "node")


def _piece(large: DataFrame, salt: int) -> DataFrame:
    """``large`` (node, rep, size) with the node cut into pieces of about half of ``NODE`` classes, dealt by a hash."""
    place = F.pmod(F.xxhash64("rep", "node", F.lit(salt)), F.ceil(F.col("size") / (NODE // 2)))
    return large.withColumn("node", F.xxhash64("node", place))


def _first_pass(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidates of the first trees, the best of each class."""
    rows = _shared(classes.select(F.explode(F.array_distinct("first")).alias("node"), "rep", F.col("rep").alias("component")))
    rows = rows.filter(F.col("size") <= NODE).unionByName(_piece(rows.filter(F.col("size") > NODE), 0))
    return _candidates(rows.join(classes.select("rep", "n", "low"), "rep"), threshold, complete=False, keep="ends")


def _all_trees(level: DataFrame, sketched: DataFrame, threshold: float, scratch: Scratch, keep: str) -> DataFrame:
    """Candidates below the nodes of ``level`` (node, rep, component, size) between classes that are in different components."""
    found = None
    for depth in range(2, LEVELS + DEEP):
        fits = level.filter(F.col("size") <= NODE)
        large = level.filter(F.col("size") > NODE)
        ended = large.limit(1).count() == 0
        if not ended:
            counts = large.groupBy("node", "component").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("bulk"), (F.sum("n") - F.max("n")).alias("out"))
            large = large.join(counts, "node").withColumn("outside", F.col("component") != F.col("bulk"))
            pieces = F.ceil(F.col("size") / (NODE // 2))
            # few outside: every piece of the node gets them all
            everywhere = F.when(F.col("outside"), F.sequence(F.lit(0).cast("bigint"), pieces - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), pieces)))
            few = large.filter(F.col("out") <= LEAF).select("node", "rep", "component", "size", F.explode(everywhere).alias("piece"))
            fits = fits.unionByName(few.withColumn("node", F.xxhash64("node", "piece")).drop("piece"))
            many = scratch.keep(large.filter(F.col("out") > LEAF).select("node", "rep", "component", "size").join(sketched, "rep"), "large")
            near = scratch.keep(_candidates(_piece(many, depth), threshold, complete=False, keep="between"), "near")
            found = near if found is None else found.unionByName(near)
        own = scratch.keep(_candidates(fits.join(sketched, "rep"), threshold, complete=True, keep=keep), "own")
        found = own if found is None else found.unionByName(own)
        if ended:
            return found.groupBy("a", "b").agg(F.max("more").alias("more"))
        level = scratch.keep(_shared(_branch(many)), "level")
    blocks = F.ceil(F.col("size") / (NODE // 2))  # nodes that don't fall apart: every two pieces are compared
    mine = F.pmod(F.xxhash64("rep"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda k: F.xxhash64("node", F.least(k, mine), F.greatest(k, mine)))
    rest = level.select(F.explode(pairs).alias("node"), "rep", "component").join(sketched, "rep")
    return found.unionByName(_candidates(rest, threshold, complete=True, keep=keep)).groupBy("a", "b").agg(F.max("more").alias("more"))


def _relabelled(rows: DataFrame, labels: DataFrame, column: str = "component") -> DataFrame:
    """``rows`` with ``column`` replaced by its component where ``labels`` (id, component) has one."""
    step = labels.select(F.col("id").alias(column), F.col("component").alias("_to"))
    return rows.join(step, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; written before it returns."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    held = scratch.keep(_per_document(docs, wanted, width, lambda found: found.tobytes(), "held"), "sets")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(x) + len(y)
            merged = np.concatenate([x, y])
            merged.sort(kind="stable")
            common = int((merged[1:] == merged[:-1]).sum())
            out.append(100 * common >= percent * (both - common))
        return pd.Series(out, dtype=bool)

    of_a = pairs.join(held.select(F.col("rep").alias("a"), F.col("held").alias("held_a")), "a")
    both = of_a.join(held.select(F.col("rep").alias("b"), F.col("held").alias("held_b")), "b")
    links = scratch.keep(both.filter(linked("held_a", "held_b")).select("a", "b"), "links")
    scratch.drop("sets")
    return links


def _per_document(docs: DataFrame, wanted: DataFrame, width: int, make, name: str) -> DataFrame:
    """(rep, ``name``): ``make`` of the whole shingle set of each document in ``wanted`` (rep)."""
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), 500):
                piece = part.iloc[at : at + 500]
                yield pd.DataFrame({"rep": piece["doc_id"].to_numpy(), name: [make(shingle_set(t, width)) for t in piece["text"]]})

    return texts.mapInPandas(run, f"rep long, {name} binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are not read): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links (100 * intersection >= percent * union of the
    shingle sets), the row's own included. Texts that are null, empty or white space have no shingles and are
    linked with nothing. A row with a null doc_id is linked with nothing and kept. Rows that repeat
    a doc_id are one document with several texts. An empty table gives no rows. Very long texts are read whole.
    """
    scratch, threshold = scratch or Scratch(docs.sparkSession, "near"), percent / 100
    rows = scratch.keep(_shingled(docs, width), "shingled")
    usable = rows.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "low", "first", "others")])
    classes = scratch.keep(classes, "classes")
    sketched, known = classes.select("rep", "n", "low"), classes.select("fp", "rep", F.col("rep").alias("component"), F.concat("first", "others").alias("nodes"))

    def step(found: DataFrame, known: DataFrame) -> DataFrame:
        """``known`` with the components that the links among ``found`` give."""
        links, now = _confirmed(found, docs, width, percent, scratch), known.select("rep", "component")
        links = links.join(now.toDF("a", "c_a"), "a").join(now.toDF("b", "c_b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        return scratch.keep(_relabelled(known, components(links, scratch)), "known")

    tried = scratch.keep(_first_pass(classes, threshold), "candidates")
    known = step(tried, known)
    level = scratch.keep(_shared(known.select(F.explode(F.array_distinct("nodes")).alias("node"), "rep", "component")), "level")
    second = scratch.keep(_all_trees(level, sketched, threshold, scratch, "between"), "candidates")
    known = step(second.join(tried, ["a", "b"], "left_anti"), known)
    # the third pass is for the components between which the second left pairs out and found no link
    now = known.select("rep", "component")
    open_ = second.filter("more").join(now.toDF("a", "x"), "a").join(now.toDF("b", "y"), "b").filter("x != y")
    open_ = scratch.keep(open_.select(F.explode(F.array("x", "y")).alias("component")).distinct(), "open")
    if open_.limit(1).count():
        left = level.select("node", "rep").join(now, "rep").join(open_, "component", "left_semi")
        level = scratch.keep(_shared(left.select("node", "rep", "component")), "level")
        lowest = _per_document(docs, level, width, lambda found: (found[:BOTTOM] >> np.uint64(32)).astype("<u4").tobytes(), "bottom")
        third = _all_trees(level, sketched.join(scratch.keep(lowest, "bottom"), "rep"), threshold, scratch, "all")
        known = step(scratch.keep(third.join(tried.unionByName(second), ["a", "b"], "left_anti"), "candidates"), known)
    of_class = known.select("fp", F.col("component").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stay, one document of each component, with all their columns.

    Rows with a null doc_id and rows whose text has no word stay. Rows that repeat a doc_id stay or go together.
    An empty table stays empty.
    """
    gone = near_duplicates(docs, width, percent).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
