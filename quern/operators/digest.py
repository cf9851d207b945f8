"""The parts of a long log that tell an incident: its head and tail, and lines around fatal events and other errors under quotas.

Neighbourhoods are taken in line order: an event that a neighbourhood before it holds makes none of its own. What is taken in a range of line numbers
therefore hangs on the lines before it only through how far the last neighbourhood reaches in, which is at most ``AFTER`` lines. Each range is folded
once for every such reach in a task of its own, the ranges' results are put together in order, and then the wanted ones are looked up by their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import cut

#: Lines before and after an event; fatal neighbourhoods and all; lines of the head and the tail; lines and characters up to which a log is told whole.
BEFORE, AFTER, FATAL, ALL, HEAD, TAIL, WHOLE = 3, 4, 25, 35, 120, 150, (1200, 250_000)
#: Line numbers of a range.
SPAN = 1 << 14
# Words of fatal events and of other errors.
FATAL_PATTERNS = [
    r"(?i)\b(out of memory|oom[-_]?killer|killed\s+process|killing\s+process|sigkill|sigterm|sigsegv|sigbus|core dumped|segmentation fault|segfault|kernel panic|panic|stack overflow)\b",
    r"(?i)\b(fatal|critical|emergency|severe|deadlock|lock wait timeout|corruption|corrupted|assertion failed)\b",
    r"(?i)\b(crashed|crash|crashing|stopped unexpectedly|terminated unexpectedly|shutting down unexpectedly|service down|server terminated)\b",
    r"(?i)\b(cannot allocate memory|disk full|no space left on device|read-only file system|hardware error|bus error)\b",
    r"(?i)\b(runtime error|short dump|rabax|rabax_state|message_type_x|tsv_tnew_page_alloc_failed|cx_sy_[a-z0-9_]+)\b",
    r"(?i)\b(work process (?:killed|terminated|halted)|system_failure|communication_failure)\b",
]
GENERAL_PATTERNS = [
    r"(?i)\b(exception|unhandled|traceback|abort|aborted)\b",
    r"(?i)\b(resource temporarily unavailable|i\/o error|device error)\b",
    r"(?i)\b(connection refused|connection reset|timed out|timeout|max connections reached|too many open files|broken pipe|network unreachable)\b",
    r"(?i)\b(failed to start|down|offline)\b",
    r"(?i)\b(error:?|err:?|failure:?|failed:?)\b",
    r"(?i)\b(sm21|transaction cancelled|disp\+work|enqueue error|rfc_error_[a-z0-9_]+|gateway error|abap dump)\b",
    r"(?i)\b(xsuaa|cf-appstopped|destination service|cloud connector|hana cloud|hdb_error|hdb sql error|sqlstate|db error|oauth token failed)\b",
]


def kind(line: Column) -> Column:
    """``fatal``, ``general`` or null by the words of a line."""
    any_of = lambda patterns: line.rlike("(?i)" + "|".join(p.removeprefix("(?i)") for p in patterns))
    return F.when(any_of(FATAL_PATTERNS), "fatal").when(any_of(GENERAL_PATTERNS), "general")


def taken(lines: np.ndarray, reach: int) -> np.ndarray:
    """Of ascending line numbers those that make a neighbourhood, when the last one before reaches up to the line ``reach``."""
    out, at = [], int(np.searchsorted(lines, reach + 1))
    while at < len(lines):
        out.append(lines[at])
        at = int(np.searchsorted(lines, lines[at] + AFTER + 1))
    return np.array(out, dtype=np.int64)


def _neighbourhoods(events: DataFrame) -> tuple[DataFrame, int]:
    """((line_no, number) of the ``events`` (line_no, distinct) that make a neighbourhood, numbered from 0 in line order; how many there are)."""
    ranged = cut(events.select("line_no", F.floor(F.col("line_no") / SPAN).alias("range")))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        held, r = np.sort(part["line_no"].to_numpy()), int(part["range"].iloc[0])
        rows = []
        for into in range(AFTER + 1):  # lines of this range that are held by the range before
            own = taken(held, r * SPAN + into - 1)
            rows.append((r, into, len(own), max(0, int(own[-1]) + AFTER + 1 - (r + 1) * SPAN) if len(own) else 0))
        return pd.DataFrame(rows, columns=["range", "into", "n", "out"])

    # a few rows for each range of 16,384 line numbers are put in order by the driver
    told = ranged.groupBy("range").applyInPandas(fold, "range long, into int, n long, out int").toPandas().sort_values(["range", "into"])
    starts, number, last, reach = [], 0, None, 0
    for r, own in told.groupby("range"):
        into = reach if last is not None and r == last + 1 else 0
        row = own[own["into"] == into].iloc[0]
        starts.append((int(r), int(into), number))
        number, last, reach = number + int(row["n"]), r, int(row["out"])
    begun = events.sparkSession.createDataFrame(starts, "range long, into int, before long")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        own = taken(np.sort(part["line_no"].to_numpy()), int(part["range"].iloc[0]) * SPAN + int(part["into"].iloc[0]) - 1)
        return pd.DataFrame({"line_no": own, "number": int(part["before"].iloc[0]) + np.arange(len(own))})

    return ranged.join(begun, "range").groupBy("range").applyInPandas(pick, "line_no long, number long"), number


def digest(lines: DataFrame) -> DataFrame:
    """(section, cluster, fatal, line_no, raw) of a log (line_no from 1, raw): section ``whole`` for a short one, else ``head``, ``incident`` and ``tail``.

    Clusters, numbered in line order, are the lines from ``BEFORE`` before to ``AFTER`` after an event. The first ``FATAL`` fatal ones are taken, then
    others up to ``ALL``, evenly spread over all that there are outside the fatal ones. A line of two clusters is told in both. An empty log gives no rows.
    """
    spark, marked = lines.sparkSession, cut(lines.select("line_no", kind(F.col("raw")).alias("kind"), F.length("raw").alias("size")).select("line_no", "kind", "size"))
    n, last, size = marked.agg(F.count("*"), F.max("line_no"), F.coalesce(F.sum("size"), F.lit(0)) + F.count("*")).first()
    none = lambda c: F.lit(None).cast("int" if c == "cluster" else "boolean").alias(c)
    part = lambda name, where: lines.filter(where).select(F.lit(name).alias("section"), none("cluster"), none("fatal"), "line_no", "raw")
    if n <= WHOLE[0] and size <= WHOLE[1]:
        return part("whole", F.lit(True))
    numbered, _ = _neighbourhoods(marked.filter("kind = 'fatal'").select("line_no"))
    fatal = sorted(r["line_no"] for r in numbered.filter(F.col("number") < FATAL).select("line_no").collect())
    held = {k for f in fatal for k in range(f - BEFORE, f + AFTER + 1)}
    others = marked.filter("kind = 'general'").filter(~F.col("line_no").isin(sorted(held))) if held else marked.filter("kind = 'general'")
    numbered, many = _neighbourhoods(others.select("line_no"))
    room = ALL - len(fatal)
    wanted = sorted({min(many - 1, int(s * (many / room))) for s in range(room)}) if many > room else list(range(many))
    general = [r["line_no"] for r in numbered.filter(F.col("number").isin(wanted)).select("line_no").collect()] if wanted else []
    chosen = sorted([(f, True) for f in fatal] + [(g, False) for g in general])
    near = spark.createDataFrame([(c + 1, is_fatal, k) for c, (at, is_fatal) in enumerate(chosen) for k in range(max(1, at - BEFORE), min(last, at + AFTER) + 1)], "cluster int, fatal boolean, line_no long")
    incident = lines.join(F.broadcast(near), "line_no").select(F.lit("incident").alias("section"), "cluster", "fatal", "line_no", "raw")
    return part("head", F.col("line_no") <= HEAD).unionByName(incident).unionByName(part("tail", F.col("line_no") > last - TAIL))
