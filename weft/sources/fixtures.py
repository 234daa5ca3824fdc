"""Graphs made from the test tables.

The node graph joins each embedding to its nearest ones; the graph collection has a graph for each user,
whose nodes are the user's events in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.neighbours import nearest

from .storage import table


def gnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x (array of doubles), y, split."""
    e = table(spark, sf_dir, "embeddings")
    last = F.pmod("vec_id", F.lit(10))
    split = F.when(last < 4, "train").when(last < 6, "val").otherwise("test")
    return e.select(F.col("vec_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").alias("y"), split.alias("split"))


def features(nodes: DataFrame) -> DataFrame:
    """node, dim, val of nodes (node, x)."""
    return nodes.select("node", F.posexplode("x").alias("dim", "val")).withColumn("dim", F.col("dim").cast("long"))


def gedges(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """src, dst: each node's k nearest by dot product, and back."""
    near = nearest(gnodes(spark, sf_dir).select("node", "x"), k).select(F.col("node").alias("src"), F.col("neighbour").alias("dst"))
    return near.unionAll(near.select("dst", "src")).distinct()


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node_id, label: a user's events, numbered in order; labels are dense ranks of the event types."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().withColumn("label", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))  # a row a type
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ranked = events.select("user_id", "event_type", F.row_number().over(order).cast("long").alias("node_id"))
    return ranked.join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("graph_id"), "node_id", "label")


def event_edges(nodes: DataFrame) -> DataFrame:
    """graph_id, u < v: each event to the next one, and to the next one of its label."""
    after = F.lead("node_id").over(Window.partitionBy("graph_id").orderBy("node_id"))
    again = F.lead("node_id").over(Window.partitionBy("graph_id", "label").orderBy("node_id"))
    both = nodes.withColumns({"after": after, "again": again})
    ends = both.select("graph_id", F.col("node_id").alias("u"), F.explode(F.array("after", "again")).alias("v"))
    return ends.where("v IS NOT NULL").distinct()


def with_features(nodes: DataFrame) -> DataFrame:
    """Nodes with feat: an event's type and place as two numbers."""
    return nodes.withColumn("feat", F.array((F.col("label") + 1).cast("double"), F.col("node_id").cast("double")))


def graph_labels(nodes: DataFrame, label: int = 2) -> DataFrame:
    """graph_id, label: 1 where the graph has more nodes of that label than the median graph."""
    n = nodes.groupBy("graph_id").agg(F.count_if(F.col("label") == label).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.median("n").alias("m")))).select("graph_id", (F.col("n") > F.col("m")).cast("int").alias("label"))
