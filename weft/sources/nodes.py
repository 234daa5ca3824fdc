"""Node data sets as Parquet: nodes (node, x, y, and masks or a split) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, normalise: bool = True, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, y, split) and edges; rows of x with absolute sum 1 if asked for (zeros stay). split: the position to take where `splits` holds several."""
    nodes, edges = spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet").select("src", "dst")
    x = F.transform("x", lambda v: v.cast("double"))
    if normalise:
        total = F.nullif(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)), F.lit(0.0))
        x = F.transform(x, lambda v: v / F.coalesce(total, F.lit(1.0)))
    part = F.col("splits")[split] if split is not None else F.col("split")
    return nodes.select("node", x.alias("x"), "y", part.alias("split")), edges
