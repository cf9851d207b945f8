"""Functions of the caller's own over batches of rows: rerankers, embeddings, summaries, entity extraction.

A callback is made once a task by a ``setup`` without arguments, so that models and connections are opened where they are used, and then gets
batches. A batch that fails doesn't fail the job: its rows get nothing, and what that means the operator says.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a batch.
BATCH = 64


def _told(call: Callable, *given):
    """What the callback returns, or nothing if it fails."""
    try:
        return call(*given)
    except Exception as e:  # noqa: BLE001 - whatever the caller's function raises
        logging.getLogger(__name__).warning("a batch failed: %s", e)
        return None


def mapped(df: DataFrame, column: str, setup: Callable[[], Callable[[list], Sequence]], name: str, kind: str, batch: int = BATCH) -> DataFrame:
    """``df`` with column ``name`` of type ``kind``: what the callback makes of ``column``, a list of values in, one of as many out.

    Where a batch fails or comes back with another number of values it is null. Embedding, summary and entity functions are called so.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{name}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = setup()
        for part in batches:
            out = []
            for at in range(0, len(part), batch):
                values = part[column].iloc[at : at + batch].tolist()
                made = _told(call, values)
                out += list(made) if made is not None and len(made) == len(values) else [None] * len(values)
            yield part.assign(**{name: pd.Series(out, index=part.index, dtype=object)})

    return df.mapInPandas(run, schema)


def rerank(candidates: DataFrame, queries: DataFrame, setup: Callable[[], Callable[[str, list[str]], Sequence[tuple[int, float]]]], calibrated: bool, k: int | None = None, most: int = 1000) -> DataFrame:
    """``candidates`` (query_id, id, rank, text) in the order of a scorer: query_id, id, rank, old_rank, rerank, calibrated.

    The scorer gets a query's text and its candidates' texts in their old order, and returns (place, score) pairs in any order; pairs with a place that
    isn't there and repeats of a place are dropped, scores are put between 0 and 1, one that is no number is 0. Rows that it says nothing of come after the others
    in their old order, without a score; so do all rows of a query whose batch fails, and those past the first ``most``, which aren't shown to it. A query
    without words isn't scored. With ``k`` the first so many stay. ``calibrated`` says whether scores mean the same for all queries, as ``relevance_gate`` asks.
    """
    asked = candidates.select("query_id", "id", "rank", "text").join(queries.select("query_id", F.col("text").alias("asked")), "query_id", "left")
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    placed = asked.withColumn("place", F.row_number().over(order) - 1)
    # a batch is a query's first candidates; the rest needs no scorer
    shown = placed.filter(F.col("place") < most).repartition("query_id").sortWithinPartitions("query_id", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, rest = setup(), None
        for part in batches:
            part = pd.concat([rest, part]) if rest is not None else part
            last = part["query_id"] == part["query_id"].iloc[-1]
            rest = part[last]
            yield from scored(call, part[~last])
        if rest is not None:
            yield from scored(call, rest)

    def scored(call, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in part.groupby("query_id", sort=False):
            query, texts, held = own["asked"].iloc[0], own["text"].fillna("").tolist(), {}
            made = _told(lambda q=query, t=texts: list(call(q, t))) if query and query.strip() else None
            for place, score in made or []:
                if isinstance(place, int) and 0 <= place < len(texts) and place not in held:
                    score = float(score) if isinstance(score, (int, float)) and math.isfinite(score) else 0.0
                    held[place] = min(1.0, max(0.0, score))
            yield own[["query_id", "id", "place"]].assign(rerank=pd.array([held.get(p) for p in range(len(own))], dtype="Float64"))

    scores = shown.select("query_id", "id", "place", "text", "asked").mapInPandas(run, "query_id long, id long, place int, rerank double")
    told = placed.select("query_id", "id", "rank", "place").join(scores, ["query_id", "id", "place"], "left")
    new = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "place")
    out = told.select("query_id", "id", F.row_number().over(new).alias("_n"), F.col("rank").alias("old_rank"), "rerank", F.lit(calibrated).alias("calibrated")).withColumnRenamed("_n", "rank")
    return out if k is None else out.filter(F.col("rank") <= k)
