"""Exact nearest neighbours by dot product, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about.
BLOCK_ROWS = 2000


def _block(k: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "neighbour": [], "score": []}).astype({"node": "int64", "neighbour": "int64"})
        right = right.sort_values("other")
        ids, mine = right["other"].to_numpy(), left["node"].to_numpy()
        scores = np.stack(left["x"].tolist()) @ np.stack(right["y"].tolist()).T
        scores[(mine[:, None] == ids[None, :]) | np.isnan(scores)] = -np.inf
        low = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
        row, column = np.nonzero(scores >= low[:, None] - 2e-6)  # all that may be among the first k once rounded
        score = np.round(scores[row, column], 6)
        order = np.lexsort((column, -score, row))  # ties go to the lower id
        row, column, score = row[order], column[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out = pd.DataFrame({"node": mine[row[first]], "neighbour": ids[column[first]], "score": score[first]})
        return out[np.isfinite(out["score"])]

    return best


def nearest(vectors: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """node, neighbour, score: the k other nodes of the highest dot product (to 6 digits), ties to the lower id, of vectors (node, x).

    Every pair of blocks is one group; a pair yields k rows a node, and these are merged.
    """
    n = blocks or max(1, -(-vectors.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("node", "x", own.alias("a"), every.alias("b"))
    right = vectors.select(F.col("node").alias("other"), F.col("x").alias("y"), every.alias("c"), own.alias("d"))
    parts = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInPandas(_block(k), "node long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "neighbour"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
