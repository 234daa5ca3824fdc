"""Stored results: fold scores as Parquet, tables as CSV, pivots to print."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_folds(scores: DataFrame, path: str) -> None:
    """scores: dataset, method, fold, acc; only the written data sets and methods are replaced."""
    spark = scores.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        scores.write.mode("overwrite").partitionBy("dataset", "method").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fold int, acc double, dataset string, method string").parquet(path).select("dataset", "method", "fold", "acc")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def results_table(results: DataFrame, methods: list[str]) -> DataFrame:
    """A row a data set, a column a method: the mean score. The methods are named, so no job looks for them."""
    return results.groupBy("dataset").pivot("method", methods).agg(F.avg("acc"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """dataset, method, mean and population deviation of the folds."""
    return scores.groupBy("dataset", "method").agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std"))
