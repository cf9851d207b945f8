"""Nearest rows for many query vectors at once, by products of blocks.

Rows and queries are dealt to blocks by hash. Each pair of blocks is one matrix product in a task, which keeps the best rows of each of its queries; the
best of a query's pairs are merged. The product of the blocks' numbers is the size of the stated query set times the table, nothing else is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block.
ROWS, ASKED = 8192, 1024


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(sim) > 4 * k:
        kept = np.flatnonzero(sim >= -np.partition(-sim, k - 1)[k - 1])
        return kept[np.lexsort((ids[kept], -sim[kept]))[:k]]
    return np.lexsort((ids, -sim))[:k]


def similar_to_each(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -2.0, inclusive: bool = False, own: bool = False) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) most similar to each of ``queries`` (query_id, embedding): query_id, rank, vec_id, similarity.

    Similarity is the cosine to 6 places, 0 for a vector of length zero; rows above the threshold count, from it on if ``inclusive``; ties go to the smaller
    id. A row whose id is the query's counts only if ``own``. Vectors of another length than the query, null ones and those with null or
    non-finite components are left out.
    """

    def fit(df: DataFrame, name: str) -> DataFrame:
        v = df.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.size("v") > 0)
        return v.filter(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))).withColumn("dims", F.size("v"))

    rows, asked = fit(vectors, "vec_id"), fit(queries, "query_id")
    n_rows, n_asked = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // ASKED))
    block = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n))
    of_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("a", block(rows, n_rows)).withColumn("b", of_all(n_asked)).withColumn("query", F.lit(False))
    right = asked.withColumn("b", block(asked, n_asked)).withColumn("a", of_all(n_rows)).withColumn("query", F.lit(True))

    def near(part: pd.DataFrame) -> pd.DataFrame:
        q, x = part[part["query"]], part[~part["query"]]
        found = [np.zeros((3, 0))]
        if len(q) and len(x):
            v, w = np.array(q["v"].tolist(), dtype=np.float64), np.array(x["v"].tolist(), dtype=np.float64)
            both = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((w * w).sum(axis=1))[None, :]
            sim = np.divide(v @ w.T, both, out=np.zeros_like(both), where=both > 0).round(6)
            ids = x["id"].to_numpy()
            for i, query in enumerate(q["id"]):
                ok = np.flatnonzero((sim[i] >= threshold if inclusive else sim[i] > threshold) & (own | (ids != query)))
                best = ok[_best(sim[i, ok], ids[ok], k)]
                found.append(np.stack([np.full(len(best), i), best, sim[i, best]]))
        i, j, s = np.concatenate(found, axis=1)
        return pd.DataFrame({"query_id": q["id"].to_numpy()[i.astype(int)], "vec_id": x["id"].to_numpy()[j.astype(int)], "similarity": s})

    told = left.unionByName(right).groupBy("dims", "a", "b").applyInPandas(near, "query_id long, vec_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
