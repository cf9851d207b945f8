"""Structural log analysis. Lines have (line_no, raw); ``annotate`` adds ts, severity and masked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import mask, severity, timestamp
from quern.plans.lineage import cut

#: Tree of the template miner: share of equal places that joins a cluster, children that a node may have, characters of a line that a report reads.
SIMILAR, CHILDREN, LONGEST = 0.4, 120, 4000
#: Line numbers of a range in which lines are numbered before the sums of the ranges are added.
SPAN = 1 << 14
#: Ranges of line numbers in which an even sample counts lines.
RANGES = 4096


def annotate(lines: DataFrame) -> DataFrame:
    return lines.select("*", timestamp(F.col("raw")).alias("ts"), severity(F.col("raw")).alias("severity"), F.trim(mask(F.col("raw"))).alias("masked"))


def masked_counts(lines: DataFrame) -> DataFrame:
    """By masked line: count, first and last line, a stated severity, first and last time."""
    return lines.groupBy("masked").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min_by("severity", F.when(F.col("severity").isNotNull(), F.col("line_no"))).alias("severity"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


class TemplateLeaf:
    """Templates of lines with as many tokens and the same leading ones: a line joins the one with most equal places, of equals the first.

    Templates are found by their tokens at a place. One that fits a line has at least ``SIMILAR`` of its places, so it is among those
    that share one of the line's rarest places, all but so many; only these are compared.
    """

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((8, 0), dtype=np.int32)
        self.size = 0
        self.at: dict[tuple[int, int], list[int]] = {}

    def find(self, tokens: np.ndarray) -> int:
        """The template that fits the tokens best, -1 if none does."""
        n = len(tokens)
        least = int(np.ceil(SIMILAR * n - 1e-9))
        if self.size <= 32:
            near = np.arange(self.size)
        else:
            held = sorted((self.at.get(place, ()) for place in enumerate(tokens.tolist())), key=len)[: n - least + 1]
            near = np.array(sorted(set().union(*held)), dtype=np.int64)
        if not len(near):
            return -1
        equal = (self.rows[near] == tokens).sum(axis=1)
        best = int(equal.argmax())
        return int(near[best]) if equal[best] >= least else -1

    def encode(self, tokens: list[str]) -> list[int]:
        """Numbers of the tokens, 0 for a wildcard."""
        return [0 if t == "<*>" else self.numbers.setdefault(t, len(self.numbers) + 1) for t in tokens]

    def append(self, row: np.ndarray) -> int:
        if self.size == len(self.rows) or self.rows.shape[1] != len(row):
            self.rows = np.concatenate([self.rows[: self.size].reshape(self.size, len(row)), np.zeros((max(8, self.size), len(row)), dtype=np.int32)])
        self.rows[self.size] = row
        for place in enumerate(row.tolist()):
            if place[1] > 0:
                self.at.setdefault(place, []).append(self.size)
        self.size += 1
        return self.size - 1

    def _take(self, row: np.ndarray) -> int:
        k = self.find(np.where(row == 0, -1, row))
        if k < 0:
            return self.append(row)
        self.rows[k][self.rows[k] != row] = 0
        return k

    def add(self, lines: list[list[str]]) -> list[int]:
        """The numbers of the templates that the lines, one after the other, join or found.

        While there are few templates, runs of lines that change none of them are told by one comparison; runs are tried at growing lengths.
        """
        rows = np.array([self.encode(t) for t in lines], dtype=np.int32).reshape(len(lines), len(lines[0]) if lines else 0)
        least, out, at, run = int(np.ceil(SIMILAR * rows.shape[1] - 1e-9)), [], 0, 1
        while at < len(rows):
            if 0 < self.size <= 32:
                piece, held = rows[at : at + run], self.rows[: self.size]
                equal = ((piece[:, None, :] == held[None]) & (piece != 0)[:, None, :]).sum(axis=2)
                best = equal.argmax(axis=1)
                same = (equal.max(axis=1) >= least) & ((held[best] == piece) | (held[best] == 0)).all(axis=1)
                kept = len(piece) if same.all() else int(same.argmin())
                out += best[:kept].tolist()
                at, run = at + kept, min(2 * run, 4096) if kept == len(piece) else 1
                if kept == len(piece):
                    continue
            out.append(self._take(rows[at]))
            at += 1
        return out

    def templates(self) -> list[str]:
        words = ["<*>", *self.numbers]
        return [" ".join(words[i] for i in row) for row in self.rows[: self.size].tolist()]


LEAF = ["_log", "_n", "_a", "_b"]


def _led(lines: DataFrame) -> DataFrame:
    """``lines`` (masked) that have tokens, with these, their number, and the first two, ``<*>`` where one has a digit or a mask in it."""
    told = lines.withColumn("_tokens", F.filter(F.split("masked", r"\s+"), lambda t: t != "")).filter(F.size("_tokens") > 0)
    lead = lambda k: F.when(F.get("_tokens", k).rlike("<[A-Z]+>|[0-9]"), "<*>").otherwise(F.coalesce(F.get("_tokens", k), F.lit("")))
    return told.withColumns({"_n": F.size("_tokens"), "_a": lead(F.lit(0)), "_b": lead(F.lit(1))})


def _own(heads: DataFrame, node: list[str], token: str) -> DataFrame:
    """``heads`` with the child of ``node`` that ``token`` leads to in its place.

    A node's children are its first ``CHILDREN`` tokens in the order of their first lines, up to a wildcard; the others go there.
    """
    of_token, of_node = Window.partitionBy(*node, token), Window.partitionBy(*node)
    placed = heads.withColumn("_at", F.min("_first").over(of_token)).withColumn("_r", F.dense_rank().over(of_node.orderBy("_at")))
    placed = placed.withColumn("_wild", F.min(F.when(F.col(token) == "<*>", F.col("_r"))).over(of_node))
    own = (F.col("_r") <= CHILDREN) & (F.col("_wild").isNull() | (F.col("_r") <= F.col("_wild")))
    return placed.withColumn(token, F.when(own, F.col(token)).otherwise("<*>")).drop("_at", "_r", "_wild")


def _by_leaf(counted: DataFrame) -> DataFrame:
    """``counted`` (log, masked, first_line and more) with its leaf's columns in place of the leading tokens; the input is read twice, so it should be written."""
    led = _led(counted).withColumn("_log", F.coalesce(F.concat(F.lit("="), "log"), F.lit("")))
    # a row for each pair of leading tokens: both levels of the tree are laid out over these alone
    heads = led.groupBy(*LEAF).agg(F.min(F.struct("first_line", "masked")).alias("_first")).repartition("_log", "_n").withColumns({"_a0": F.col("_a"), "_b0": F.col("_b")})
    heads = _own(_own(heads, ["_log", "_n"], "_a"), ["_log", "_n", "_a"], "_b").drop("_first")
    led = led.withColumnsRenamed({"_a": "_a0", "_b": "_b0"})
    return led.join(heads, ["_log", "_n", "_a0", "_b0"]).drop("_a0", "_b0")


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, tuple, pd.DataFrame]]:
    """(whether it begins a leaf, the leaf, rows) of batches that are sorted by leaf."""
    last = None
    for part in batches:
        for key, own in part.groupby(LEAF, sort=False):
            yield key != last, key, own
            last = key


def mine_templates(lines: DataFrame, by: str | None = None, share_of: Column | None = None) -> DataFrame:
    """Log templates of annotated ``lines`` (per value of ``by`` if given): template, n, first_line, last_line, severity.

    Repeats are counted by Spark first; each distinct masked line is seen once, in the order of its first appearance among
    those of its leaf: the lines of a log with as many tokens and the same two leading ones. Leaves are dealt over tasks, where their lines stream past
    the templates so far. Blank lines have no template. With ``share_of``, a condition on lines, the template's leaf and number in it and the lines that
    meet the condition (``part``) are told too: a model for ``match_templates``.
    """
    log = F.col(by).cast("string") if by else F.lit("")
    part = F.count_if(share_of) if share_of is not None else F.lit(0).cast("long")
    counted = lines.withColumn("log", log).groupBy("log", "masked").agg(
        F.count("*").alias("n"), part.alias("part"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.min_by("severity", F.when(F.col("severity").isNotNull(), F.col("line_no"))).alias("severity"),
    )
    dealt = _by_leaf(cut(counted)).repartition(*LEAF).sortWithinPartitions(*LEAF, "first_line", "masked")

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, key, told = TemplateLeaf(), None, []

        def finished() -> Iterator[pd.DataFrame]:
            if not told:
                return
            rows = pd.concat(told)
            stated = rows.dropna(subset=["severity"]).drop_duplicates("k").set_index("k")["severity"]
            out = rows.groupby("k", as_index=False).agg(sums)
            told_of = {"log": key[0][1:] if key[0] else None, **dict(zip(LEAF, key, strict=True))}
            yield out.assign(template=leaf.templates(), severity=pd.Series([stated.get(k) for k in out["k"]], dtype=object), **told_of)[columns].astype(dict.fromkeys(texts, object))

        for new, now, own in _leaves(batches):
            if new:
                yield from finished()
                leaf, key, told = TemplateLeaf(), now, []
            own = own[["n", "part", "first_line", "last_line", "severity"]].assign(k=leaf.add([list(t) for t in own["_tokens"]]))
            # counts of a template so far are one row, so a leaf of any size takes as much room as its templates
            rest = own.dropna(subset=["severity"]).drop_duplicates("k").set_index("k")["severity"]
            own = own.groupby("k", as_index=False).agg(sums)
            told.append(own.assign(severity=pd.Series([rest.get(k) for k in own["k"]], dtype=object)))
        yield from finished()

    sums = {"n": "sum", "part": "sum", "first_line": "min", "last_line": "max"}
    columns, texts = ["log", "template", *sums, "severity", *LEAF, "k"], ["log", "template", "severity", "_log", "_a", "_b"]
    found = dealt.mapInPandas(mine, "log string, template string, n long, part long, first_line long, last_line long, severity string, _log string, _n int, _a string, _b string, k int")
    if share_of is not None:
        return found
    told = found.groupBy("log", "template").agg(
        F.sum("n").alias("n"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.min_by("severity", F.when(F.col("severity").isNotNull(), F.col("first_line"))).alias("severity")
    )
    return told if by else told.drop("log")


def template_model(lines: DataFrame) -> DataFrame:
    """The templates of a log as a table that other logs are matched against: template, n, first_line, last_line, severity, the leaf (_n, _a, _b) and the number in it (k)."""
    return mine_templates(lines, share_of=F.lit(False)).drop("log", "part", "_log")


def match_templates(model: DataFrame, lines: DataFrame) -> DataFrame:
    """(masked, n, first_line, template, _n, _a, _b, k): the distinct masked lines of ``lines`` with the template of ``model`` that they fit; null if none does.

    Nothing is learned: a line goes down the model's tree and takes the template with most equal places, if they are enough.
    """
    counted = _led(cut(lines.groupBy("masked").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))))
    first, second = model.select("_n", "_a").distinct(), model.select("_n", "_a", "_b").distinct()
    down = counted.join(first.withColumn("_in", F.lit(True)), ["_n", "_a"], "left").withColumn("_a", F.when(F.col("_in"), F.col("_a")).otherwise("<*>")).drop("_in")
    down = down.join(second.withColumn("_in", F.lit(True)), ["_n", "_a", "_b"], "left").withColumn("_b", F.when(F.col("_in"), F.col("_b")).otherwise("<*>")).drop("_in")
    nothing = {"masked": "string", "n": "long", "first_line": "long"}
    known = model.select("_n", "_a", "_b", "k", F.split("template", " ").alias("_tokens"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    both = known.unionByName(down.select("_n", "_a", "_b", F.lit(None).cast("int").alias("k"), "_tokens", *nothing)).withColumn("_log", F.lit(""))
    dealt = both.repartition(*LEAF).sortWithinPartitions(*LEAF, F.col("k").asc_nulls_last())

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, numbers, words = TemplateLeaf(), [], []
        for new, _, own in _leaves(batches):
            if new:
                leaf, numbers, words = TemplateLeaf(), [], []
            for k, tokens in zip(own["k"], own["_tokens"], strict=True):
                if not pd.isna(k):
                    leaf.append(np.array(leaf.encode(tokens), dtype=np.int32))
                    numbers.append(int(k))
                    words.append(" ".join(tokens))
            asked = own[own["masked"].notna()]
            if len(asked):
                hit = [leaf.find(np.array([leaf.numbers.get(w, -1) for w in t], dtype=np.int32)) for t in asked["_tokens"]]
                told = asked[["masked", "n", "first_line", "_n", "_a", "_b"]].reset_index(drop=True)
                told["template"] = pd.Series([words[h] if h >= 0 else None for h in hit], dtype=object)
                yield told.astype({"masked": object, "_a": object, "_b": object}).assign(k=pd.array([numbers[h] if h >= 0 else None for h in hit], dtype="Int32"))

    return dealt.mapInPandas(match, "masked string, n long, first_line long, template string, _n int, _a string, _b string, k int")


def mine_report(lines: DataFrame, least: int = 30, most: float = 0.6) -> DataFrame:
    """The templates of a log with their share of its lines; no rows where it has under ``least`` lines or a template for over ``most`` of them.

    Lines of over ``LONGEST`` characters are left out, as they are mostly data and not messages.
    """
    mined = cut(mine_templates(lines.filter(F.length("raw") <= LONGEST)))
    whole = mined.agg(F.sum("n").alias("_lines"), F.count("*").alias("_templates"))
    fits = (F.col("_lines") >= least) & (F.col("_templates") <= most * F.col("_lines"))
    return mined.crossJoin(F.broadcast(whole)).filter(fits).withColumn("share", F.round(F.col("n") / F.col("_lines"), 4)).drop("_lines", "_templates")


def severity_mix(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.coalesce("severity", F.lit("UNLABELLED")).alias("severity")).agg(F.count("*").alias("n"))


def rare_events(templates: DataFrame, n: int = 12) -> DataFrame:
    """Templates with at most max(2, 0.05 % of all lines) lines, rarest first."""
    whole = templates.agg(F.greatest(F.lit(2), F.floor(F.sum("n") * 0.0005)).alias("most"))
    return templates.crossJoin(F.broadcast(whole)).filter(F.col("n") <= F.col("most")).drop("most").orderBy("n", "first_line").limit(n)


def error_templates(templates: DataFrame, n: int = 10) -> DataFrame:
    return templates.filter(F.col("severity").isin("ERROR", "FATAL")).orderBy(F.desc("n"), "first_line").limit(n)


def bursts(lines: DataFrame, bucket_s: int | None = None, n: int = 5) -> DataFrame:
    """Buckets of time with unusually many lines: over median + 4 MAD and over 1.5 times the median of the occupied buckets.

    Without ``bucket_s`` the span is cut in 60, a bucket being a second at least. The upper middle counts as
    median, a MAD of 0 as 1. Under 20 stamped lines or 4 occupied buckets there is no burst.
    """
    stamped = lines.filter("ts is not null").select(F.unix_millis("ts").alias("ms"), F.col("severity").isin("ERROR", "FATAL").alias("bad"))
    span = stamped.agg(F.min("ms").alias("start"), F.max("ms").alias("stop"), F.count("*").alias("stamped"))
    width = F.lit(bucket_s * 1000) if bucket_s else F.greatest(F.lit(1000), F.ceil((F.col("stop") - F.col("start")) / 60))
    origin = F.lit(0) if bucket_s else F.col("start")
    placed = stamped.crossJoin(F.broadcast(span)).filter("stamped >= 20 and stop > start").withColumn("bucket", F.floor((F.col("ms") - origin) / width) * width + origin)
    held = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("bad").alias("errors"))
    # occupied buckets are at most as many as the time span has, not as the log has lines
    middle = held.agg(F.count("*").alias("occupied"), F.expr("-percentile_disc(0.5) within group (order by -n)").alias("median"))
    off = held.crossJoin(F.broadcast(middle)).withColumn("off", F.abs(F.col("n") - F.col("median")))
    mad = off.agg(F.expr("-percentile_disc(0.5) within group (order by -off)").alias("mad")).select(F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")).alias("mad"))
    high = off.crossJoin(F.broadcast(mad)).filter((F.col("occupied") >= 4) & (F.col("n") > F.col("median") + 4 * F.col("mad")) & (F.col("n") > 1.5 * F.col("median")))
    return high.select(F.timestamp_millis(F.col("bucket").cast("bigint")).alias("at"), "n", "errors", "median", "mad").orderBy(F.desc("n"), "at").limit(n)


def read_rows(lines: DataFrame, first: int, last: int, most: int = 150) -> DataFrame:
    """Lines of a range of line numbers, at most ``most``."""
    return lines.filter(F.col("line_no").between(first, last)).orderBy("line_no").limit(most)


def read_around(lines: DataFrame, at: str, seconds: int, most: int = 150) -> DataFrame:
    """Lines within so many seconds of a time, in line order."""
    near = F.abs(F.unix_timestamp("ts") - F.unix_timestamp(F.lit(at))) <= seconds
    return lines.filter(near).orderBy("line_no").limit(most)


def compare(baseline: DataFrame, current: DataFrame, factor: float = 3.0, least: int = 5) -> DataFrame:
    """Templates that appeared, vanished or whose share of the log changed at least ``factor``-fold: template, before, after, ratio, change.

    Both logs go through one miner, the baseline first, so that an event has the same template in either. No rows where one of them
    has under ``least`` lines. Lines of over ``LONGEST`` characters are left out.
    """
    keep = ["masked", "severity", "line_no"]
    first = baseline.filter(F.length("raw") <= LONGEST).select(*keep, F.lit(False).alias("_new"))
    second = current.filter(F.length("raw") <= LONGEST).select(*keep, F.lit(True).alias("_new"))
    # line numbers of the current log come after all of the baseline's
    ordered = first.unionByName(second).withColumn("line_no", F.when(F.col("_new"), F.col("line_no") + (1 << 52)).otherwise(F.col("line_no")))
    mined = mine_templates(ordered, share_of=F.col("_new")).select("template", (F.col("n") - F.col("part")).alias("before"), F.col("part").alias("after"))
    counted = cut(mined)
    whole = counted.agg(F.sum("before").alias("all_before"), F.sum("after").alias("all_after"))
    ratio = (F.col("after") / F.col("all_after")) / (F.col("before") / F.col("all_before"))
    told = counted.crossJoin(F.broadcast(whole)).filter((F.col("all_before") >= least) & (F.col("all_after") >= least))
    told = told.withColumn("_r", F.when((F.col("before") > 0) & (F.col("after") > 0), ratio))
    change = F.when(F.col("before") == 0, "appeared").when(F.col("after") == 0, "vanished").when(F.col("_r") >= factor, "more").when(F.col("_r") <= 1 / factor, "less")
    return told.withColumn("change", change).filter("change is not null").select("template", "before", "after", F.round("_r", 4).alias("ratio"), "change")


def incident_context(lines: DataFrame, before: int = 3, after: int = 4) -> DataFrame:
    """Lines around each ERROR or FATAL line, overlapping neighbourhoods merged: cluster, line_no, incident.

    A line's level is told once. Lines are dealt to ranges of ``SPAN`` line numbers, incidents also to the range that their neighbourhood reaches into, and
    each line looks for incidents around it inside its range. Clusters are numbered in two steps: starts are counted inside the ranges, then those of
    the ranges before are added; a range that goes on where the one before it ends has no start at its first line.
    """
    of = lambda c: F.floor(c / SPAN)
    marked = lines.select("line_no", F.coalesce(F.col("severity").isin("ERROR", "FATAL"), F.lit(False)).alias("incident"))
    home = of(F.col("line_no"))
    reached = F.when(F.col("incident"), F.array_distinct(F.array(home, of(F.col("line_no") - before), of(F.col("line_no") + after)))).otherwise(F.array(home))
    dealt = marked.select("line_no", "incident", F.explode(reached).alias("range"))
    around = F.max("incident").over(Window.partitionBy("range").orderBy("line_no").rangeBetween(-after, before))
    near = dealt.withColumn("_near", around).filter((home == F.col("range")) & F.col("_near")).drop("_near")
    inside, ranges = Window.partitionBy("range").orderBy("line_no"), Window.orderBy("range")
    starts = near.withColumn("new", F.coalesce(F.col("line_no") - F.lag("line_no").over(inside) > 1, F.lit(True)).cast("int"))
    local = starts.withColumn("local", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each range: the window without a partition is over these alone
    held = starts.groupBy("range").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.sum("new").alias("starts"))
    held = held.withColumn("joined", F.coalesce(F.col("first") - F.lag("last").over(ranges) <= 1, F.lit(False)).cast("int"))
    earlier = F.sum(F.col("starts") - F.col("joined")).over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("starts")
    return local.join(held.select("range", earlier.alias("earlier")), "range").select((F.col("earlier") + F.col("local")).alias("cluster"), "line_no", "incident")


def sampled(lines: DataFrame, k: int) -> DataFrame:
    """``k`` lines evenly spread over the lines given: places floor(i * n / k).

    Lines are counted in ``RANGES`` ranges of line numbers, and only those of ranges that hold a wanted place are numbered.
    """
    span = lines.agg(F.min("line_no").alias("_low"), (F.floor((F.max("line_no") - F.min("line_no")) / RANGES) + 1).alias("_width"))
    ranged = lines.crossJoin(F.broadcast(span)).withColumn("_range", F.coalesce(F.floor((F.col("line_no") - F.col("_low")) / F.col("_width")), F.lit(-1)))
    # at most RANGES + 1 rows: the window without a partition is over these alone
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.groupBy("_range").agg(F.count("*").alias("_held")).withColumn("_earlier", F.sum("_held").over(order) - F.col("_held"))
    places = lines.agg(F.count("*").alias("_n")).select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"), "_n").selectExpr("_i * _n div %d as _place" % k).distinct()
    wanted = held.join(F.broadcast(places), (F.col("_place") >= F.col("_earlier")) & (F.col("_place") < F.col("_earlier") + F.col("_held")))
    wanted = wanted.groupBy("_range", "_earlier").agg(F.collect_set("_place").alias("_places"))
    placed = ranged.join(F.broadcast(wanted), "_range").withColumn("_p", F.col("_earlier") + F.row_number().over(Window.partitionBy("_range").orderBy("line_no")) - 1)
    return placed.filter(F.array_contains("_places", F.col("_p"))).select(*lines.columns)


def dump_sections(files: DataFrame, headers: list[str]) -> DataFrame:
    """(file, section, line_no, raw) of lines under the section headers of dumps (file, line_no, raw)."""
    pattern = "(?i)^\\s*(" + "|".join(headers) + ")\\b"
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = files.withColumn("_h", F.when(F.col("raw").rlike(pattern), F.regexp_extract("raw", pattern, 1)))
    return named.withColumn("section", F.last("_h", ignorenulls=True).over(order)).filter("section is not null and _h is null").select("file", "section", "line_no", "raw")
