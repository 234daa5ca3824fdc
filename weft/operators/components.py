"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.sources.storage import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of edges (a, b), by alternating large and small stars, until the edges stay the same by count and hash. A star of any size is split over tasks."""

    def state(edges: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())

    now = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(now)
    for _ in range(most_rounds):
        # large star: larger neighbours go to the least of the neighbourhood; small star: the smaller ones and the node itself
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")  # so that the join can split a star
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("n"), F.col("a").alias("low"))
        floor = down.groupBy("n").agg(F.min("low").alias("m"))
        small = down.join(floor, "n").select(F.col("m").alias("a"), F.explode(F.array("low", "n")).alias("b")).where("a <> b").distinct()
        now = settle(small, "edges")
        if (after := state(now)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
