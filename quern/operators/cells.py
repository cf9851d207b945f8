"""Clustering of groups of vectors that are too large for one task.

A large group is cut into cells by k-means with few centres: a round deals the vectors over parts of bounded size, copies
the centres of a cell to each of its parts, and adds up the means of the parts. Cells that are still large are cut again. Each
cell is then clustered by one task as a small group is.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.chunking import kmeans
from quern.plans.lineage import cut

#: Key tables of up to so many rows are sent to all tasks; larger ones are joined.
SENT = 100_000


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys


def split_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(rows with one of ``keys``, the others); None and ``rows`` themselves where there is no key."""
    keys = cut(keys.select(*on))
    if keys.isEmpty():
        return None, rows
    few = _sent(keys)
    return rows.join(few, on, "left_semi"), rows.join(few, on, "left_anti")


def _nearest(points: pd.DataFrame, centres: pd.DataFrame) -> np.ndarray:
    """Each point's cluster by cosine, the first among ties."""
    centres = centres.sort_values("cluster")
    c = np.array(centres["centre"].tolist(), dtype=float)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return centres["cluster"].to_numpy()[(np.array(points["embedding"].tolist(), dtype=float) @ c.T).argmax(axis=1)]


def _centres(dealt: DataFrame, sizes: DataFrame, key: list[str], kind: str, ways: int, rounds: int) -> DataFrame:
    """(key, part, cluster, centre) after ``rounds`` rounds, each centre copied to all parts of its cell.

    A cell gets two starts for each part that it must be cut in at least, up to ``ways``: its rows with the least hash, out of more.
    """
    place = F.pmod(F.xxhash64("row", F.lit("start")), F.col("size"))
    order = Window.partitionBy(*key).orderBy("place", "row")
    starts = dealt.withColumn("place", place).filter(F.col("place") < 4 * ways).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.least(F.lit(ways), 2 * F.col("parts")))
    own = [F.col(c).alias(c) for c in key]  # names of their own, as both sides of the rounds come from one table
    centres = starts.select(*own, (F.col("at") - 1).cast("int").alias("cluster"), F.col("embedding").alias("centre"))
    parts = sizes.select(*own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def means(points: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if points.empty or centre.empty:
            return pd.DataFrame(columns=[*key, "cluster", "n", "mean"])
        found, x = _nearest(points, centre), np.array(points["embedding"].tolist(), dtype=float)
        rows = [(*points.iloc[0][key], int(j), int((found == j).sum()), x[found == j].mean(axis=0).tolist()) for j in np.unique(found)]
        return pd.DataFrame(rows, columns=[*key, "cluster", "n", "mean"])

    for _ in range(rounds):
        copies = centres.join(parts, key)
        by = [*key, "part"]
        added = dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(means, f"{kind}, cell string, cluster int, n double, mean array<double>")
        mean = Summarizer.mean(array_to_vector("mean"), F.col("n"))
        centres = cut(added.groupBy(*key, "cluster").agg(vector_to_array(mean).alias("centre")))
    return centres.join(parts, key)


def cells(points: DataFrame, group: str, most: int, ways: int = 64, rounds: int = 4, depth: int = 12) -> DataFrame:
    """``points`` (group, id, embedding, weight) with ``cell``: close vectors of a group in cells of about ``most`` rows or less.

    A cell whose rows all fall to one centre (equal vectors), or that is large still after ``depth`` cuts, is dealt by a hash of the
    row, so no cell stays large and no row is lost.
    """
    key, kind = [group, "cell"], f"{group} {points.schema[group].dataType.simpleString()}"
    columns = [group, "cell", "row", "id", "embedding", "weight"]
    # row numbers are fixed by the written rows
    rows = cut(points.select(group, F.lit("").alias("cell"), F.monotonically_increasing_id().alias("row"), "id", "embedding", "weight"))
    done, before = [], None
    for level in range(depth + 1):
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > most)
        sizes = sizes.withColumn("parts", F.ceil(F.col("size") / most).cast("int"))
        if before is not None:  # the size of the cell that a cell was cut from
            sizes = sizes.withColumn("above", F.regexp_replace("cell", r"\.\d+$", "")).join(before, [group, "above"]).select(*key, "size", "parts", (F.col("size") == F.col("was")).alias("stuck"))
        else:
            sizes = sizes.withColumn("stuck", F.lit(False))
        sizes = cut(sizes)
        if sizes.isEmpty():
            break
        few = _sent(sizes)
        done.append(rows.join(few, key, "left_anti"))
        part = F.pmod(F.xxhash64("row", F.lit(level)), F.col("parts")).cast("int")
        dealt = cut(rows.join(few, key).withColumn("part", part).repartition(*key, "part"))
        hashed = dealt if level == depth else dealt.filter("stuck")
        done.append(hashed.withColumn("cell", F.concat("cell", F.lit(".p"), "part")).select(*columns))
        if level == depth:
            return _union(done)
        dealt = dealt.filter("not stuck")
        copies = _centres(dealt, sizes.filter("not stuck"), key, kind, ways, rounds)

        def placed(some: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
            if some.empty or centre.empty:  # a cell has starts, as row numbers are spread by their hash; were there none, parts would do
                return some.assign(cell=some["cell"] + "." + some["part"].astype(str))[columns]
            return some.assign(cell=some["cell"] + "." + pd.Series(_nearest(some, centre), index=some.index).astype(str))[columns]

        by = [*key, "part"]
        before = sizes.select(group, F.col("cell").alias("above"), F.col("size").alias("was"))
        rows = cut(dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(placed, rows.schema))
    return _union([*done, rows])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def _level(points: DataFrame, group: str, level: int, fan: int, most: int) -> DataFrame:
    """(group, level, node, n, centroid) of one level; nodes are numbered by cell, then inside it.

    Each cell of n rows has ceil(n / fan) nodes, so a group has up to one more a cell than it would have as a whole.
    """

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"])
        x = np.array(part["embedding"].tolist(), dtype=float)
        found = kmeans(x, ceil(len(x) / fan))
        n = np.bincount(found, weights=part["weight"])
        rows = [(part[group].iloc[0], part["cell"].iloc[0], j, int(n[j]), x[found == j].mean(axis=0).tolist()) for j in range(found.max() + 1)]
        return pd.DataFrame(rows, columns=[group, "cell", "at", "n", "centroid"])

    kind = points.schema[group].dataType.simpleString()
    nodes = cut(cells(points, group, most).groupBy(group, "cell").applyInPandas(build, f"{group} {kind}, cell string, at int, n long, centroid array<double>"))
    held = nodes.groupBy(group, "cell").agg(F.count("*").alias("held"))
    first = held.withColumn("first", F.sum("held").over(Window.partitionBy(group).orderBy("cell")) - F.col("held"))
    return nodes.join(first, [group, "cell"]).select(group, F.lit(level).alias("level"), (F.col("first") + F.col("at")).cast("int").alias("node"), "n", "centroid")


def _kept(df: Callable[[], DataFrame], like: DataFrame, folder: str | None, level: int) -> DataFrame:
    """The level as written, made only where it isn't whole yet."""
    if folder is None:
        return cut(df())
    spark, path = like.sparkSession, f"{folder}/level={level}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("level", F.lit(level))


def large_tree(chunks: DataFrame, group: str, levels: int, least: int, fan: int, most: int, folder: str | None = None) -> DataFrame:
    """What ``chunking.summary_tree`` gives, for groups of any size: (group, level, node, n, centroid)."""
    points, out = chunks.select(group, "id", "embedding", F.lit(1.0).alias("weight")), []
    for level in range(1, levels + 1):
        few = least if level == 1 else 2
        enough = lambda points=points, few=few: points.join(points.groupBy(group).count().filter(F.col("count") >= few).select(group), group, "left_semi")
        nodes = _kept(lambda level=level: _level(enough(), group, level, fan, most), chunks, folder, level)
        out.append(nodes.select(group, "level", "node", "n", "centroid"))
        points = nodes.select(group, F.col("node").alias("id"), F.col("centroid").alias("embedding"), F.col("n").cast("double").alias("weight"))
    return _union(out)
