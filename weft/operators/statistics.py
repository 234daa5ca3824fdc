"""Paired tests over folds."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signed_rank_sums(pairs: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """keys, n, w_plus, w_minus, mean_a, mean_b of (keys, fold, a, b): rank sums of the non-zero differences by sign, tied ranks averaged."""
    d = pairs.withColumn("d", F.round(F.col("a") - F.col("b"), 9))
    size = Window.partitionBy(*keys, F.abs("d"))
    moved = d.where("d <> 0").withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy(F.abs("d"))) + (F.count("*").over(size) - 1) / 2)
    sums = moved.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    means = d.groupBy(*keys).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    return means.join(sums, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), "mean_a", "mean_b")


def exact_p(ranks: list[float], smaller: float) -> float:
    """Two-sided probability of a rank sum this small under random signs."""
    sums: dict[float, int] = {0.0: 1}
    for r in ranks:
        new = dict(sums)
        for s, c in sums.items():
            new[s + r] = new.get(s + r, 0) + c
        sums = new
    return min(1.0, 2 * sum(c for s, c in sums.items() if s <= smaller + 1e-9) / 2 ** len(ranks))


def wilcoxon(pairs: DataFrame, level: float = 0.05, most_folds: int = 60) -> DataFrame:
    """dataset, n, p, result of (dataset, fold, a, b): 'a', 'b' or 'n.s.'; p is 1 without differences. Folds are a bounded few."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most_folds:
            raise ValueError(f"more than {most_folds} folds")
        d = (group["a"] - group["b"]).round(9)
        d = d[d != 0]
        ranks = d.abs().rank()
        p = exact_p(ranks.tolist(), min(ranks[d > 0].sum(), ranks[d < 0].sum())) if len(d) else 1.0
        return pd.DataFrame({"dataset": [group["dataset"].iloc[0]], "n": [len(d)], "p": [p], "result": ["n.s." if p >= level else "a" if group["a"].mean() > group["b"].mean() else "b"]})

    return pairs.groupBy("dataset").applyInPandas(run, "dataset string, n long, p double, result string")


def label_gain(with_labels: DataFrame, without: DataFrame) -> DataFrame:
    """fold, with, without, gain: both runs' folds side by side, also where one is missing."""
    return with_labels.toDF("fold", "with").join(without.toDF("fold", "without"), "fold", "full").withColumn("gain", F.col("with") - F.col("without"))
