"""Scaling and column functions. Features are (node, dim, val), scores (node, class, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_tanh(x: DataFrame, train: DataFrame, eps: float = 1e-8) -> DataFrame:
    """tanh((x - median) / (MAD + eps)) by dimension; median and MAD of the training nodes alone (train: node)."""
    known = x.join(train.select("node"), "node", "left_semi")
    middle = known.groupBy("dim").agg(F.median("val").alias("med"))
    spread = known.join(middle, "dim").groupBy("dim").agg(F.first("med").alias("med"), F.median(F.abs(F.col("val") - F.col("med"))).alias("mad"))
    return x.join(spread, "dim").select("node", "dim", F.tanh((F.col("val") - F.col("med")) / (F.col("mad") + eps)).alias("val"))


def angle(x: Column, margin: float = 1e-7) -> Column:
    """Arc cosine within 1 - margin."""
    return F.acos(F.greatest(F.lit(-1 + margin), F.least(F.lit(1 - margin), x)))


def angular(x: DataFrame) -> DataFrame:
    return x.withColumn("val", angle(F.col("val")))


def angular_tanh(x: DataFrame, bound: float = 10.0) -> DataFrame:
    """acos(tanh(x)) with x within +-bound."""
    return x.withColumn("val", F.acos(F.tanh(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("val"))))))


def zscore(x: DataFrame, train: DataFrame, clip: float | None = 3.0) -> DataFrame:
    """(x - mean) / deviation of the training nodes by dimension (population deviation, 1 if below 1e-8), within +-clip."""
    s = x.join(train.select("node"), "node", "left_semi").groupBy("dim").agg(F.avg("val").alias("m"), F.stddev_pop("val").alias("s"))
    z = (F.col("val") - F.col("m")) / F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))
    return x.join(s, "dim").select("node", "dim", (z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).alias("val"))


def correlations(x: DataFrame, nodes: DataFrame) -> DataFrame:
    """dim, score: the largest absolute correlation of a dimension with a class's indicator over training nodes; 0 where undefined.

    Sums by (dim, class) and by dim give every correlation, so no pairing of rows with all classes is needed.
    """
    known = x.join(nodes.where("split = 'train'").select("node", "y"), "node")
    by_class = known.groupBy("dim", "y").agg(F.count("*").alias("nc"), F.sum("val").alias("sc"))
    total = known.groupBy("dim").agg(F.count("*").alias("n"), F.avg("val").alias("m"), F.var_pop("val").alias("var"))
    p = F.col("nc") / F.col("n")
    r = F.abs(F.col("sc") / F.col("n") - p * F.col("m")) / F.nullif(F.sqrt(F.col("var") * p * (1 - p)), F.lit(0.0))
    return by_class.join(total, "dim").groupBy("dim").agg(F.max(F.coalesce(r, F.lit(0.0))).alias("score"))


def prescreen(x: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """The features of the `top` dimensions of the highest score, ties to the higher dimension."""
    best = correlations(x, nodes).orderBy(F.desc("score"), F.desc("dim")).limit(top).select("dim")
    return x.join(F.broadcast(best), "dim", "left_semi")


def minmax(x: DataFrame) -> DataFrame:
    """Each dimension on -1..1 by its least and largest value; -1 if they are equal."""
    w = x.groupBy("dim").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    return x.join(w, "dim").select("node", "dim", (2 * (F.col("val") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) - 1).alias("val"))


def softmax(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("node")
    e = scores.withColumn("e", F.exp(F.col("val") - F.max("val").over(w)))
    return e.select("node", "class", (F.col("e") / F.sum("e").over(w)).alias("val"))


def one_hot(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """node, class, val of training nodes; classes: class, a row each."""
    return nodes.where("split = 'train'").join(F.broadcast(classes)).select("node", "class", (F.col("y") == F.col("class")).cast("double").alias("val"))


def row_normalised(scores: DataFrame) -> DataFrame:
    """Rows that sum to 1; rows that sum to 0 stay."""
    s = F.sum("val").over(Window.partitionBy("node"))
    return scores.withColumn("s", s).select("node", "class", F.when(F.col("s") > 0, F.col("val") / F.col("s")).otherwise(F.col("val")).alias("val"))


def l1_rows(x: DataFrame) -> DataFrame:
    """Features with rows of absolute sum 1; rows of zeros stay."""
    s = F.sum(F.abs("val")).over(Window.partitionBy("node"))
    return x.withColumn("s", s).select("node", "dim", F.when(F.col("s") > 0, F.col("val") / F.col("s")).otherwise(F.col("val")).alias("val"))


def argmax(scores: DataFrame) -> DataFrame:
    """node, class of the highest score, ties to the lower class."""
    return scores.groupBy("node").agg(F.min_by("class", F.struct(-F.col("val"), F.col("class"))).alias("class"))


def soft_angles(scores: DataFrame, scale: float = 1.0) -> DataFrame:
    """Probabilities as angles: acos(2p - 1) x scale."""
    return scores.select("node", F.col("class").alias("dim"), (angle(2 * F.col("val") - 1) * scale).alias("val"))
