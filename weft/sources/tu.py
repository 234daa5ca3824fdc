"""Text files of graph collections: NAME_A.txt, NAME_graph_indicator.txt, NAME_graph_labels.txt, and optional node labels or attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value. zipWithIndex keeps the order of the file's lines."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("line", T.LongType())])
    return spark.createDataFrame(spark.read.text(path).rdd.zipWithIndex().map(lambda r: (r[0]["value"], r[1] + 1)), schema)


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _lines(spark, path)
    except AnalysisException:
        return None


def load(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs (graph_id, label), nodes (graph_id, node_id, feat), edges (graph_id, u < v). Attributes win over labels; graph labels become 0, 1, ... in order."""
    base = f"{folder}/{name}_"
    nodes = _lines(spark, base + "graph_indicator.txt").select(F.col("line").alias("node_id"), F.trim("value").cast("long").alias("graph_id"))
    raw = _lines(spark, base + "graph_labels.txt").select(F.col("line").alias("graph_id"), F.trim("value").cast("long").alias("raw"))
    ranks = raw.select("raw").distinct().withColumn("label", F.row_number().over(Window.orderBy("raw")) - 1)  # a row a class
    graphs = raw.join(F.broadcast(ranks), "raw").select("graph_id", "label")
    feat = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double"))
    for part in ("node_attributes.txt", "node_labels.txt"):
        if (found := _optional(spark, base + part)) is not None:
            nodes = nodes.join(found.select(F.col("line").alias("node_id"), feat.alias("feat")), "node_id", "left")
            break
    else:
        nodes = nodes.withColumn("feat", F.lit(None).cast("array<double>"))
    ends = F.split("value", ",")
    pairs = spark.read.text(base + "A.txt").select(F.trim(ends[0]).cast("long").alias("a"), F.trim(ends[1]).cast("long").alias("b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    edges = pairs.join(nodes.select(F.col("node_id").alias("u"), "graph_id"), "u").select("graph_id", "u", "v")
    return graphs, nodes.select("graph_id", "node_id", "feat"), edges


def node_label(feat):
    """The largest entry's place, or the only entry; null without features."""
    return F.when(F.size(feat) > 1, F.array_position(feat, F.array_max(feat)) - 1).when(F.size(feat) == 1, F.round(feat[0]).cast("long"))


def statistics(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_graphs, n_classes, avg_nodes, avg_edges, has_features."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.max(F.col("feat").isNotNull()).alias("f"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("e"))
    per = graphs.join(n, "graph_id", "left").join(e, "graph_id", "left").na.fill(0, ["n", "e"])
    return per.agg(F.count("*").alias("n_graphs"), F.countDistinct("label").alias("n_classes"), F.avg("n").alias("avg_nodes"), F.avg("e").alias("avg_edges"), F.coalesce(F.max("f"), F.lit(False)).alias("has_features"))
