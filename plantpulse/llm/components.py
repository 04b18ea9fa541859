"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of ``edges`` (columns a, b; any order).

    Each round makes every node point at the smallest of its neighbours; rounds stop when nothing moves.
    Every round is a table in the shared folder, so neither plans nor lost executors add up. Nothing but
    a count and a sum goes to the driver. No edges: no rows.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs, before = written(pairs.distinct(), "edges"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                pairs.select(F.col("b"), F.col("b")).distinct()
            )
        before = state
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        low = pairs.groupBy(F.col("b").alias("u")).agg(F.min("b").alias("m")).union(pairs.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        low = low.groupBy("u").agg(F.min("m").alias("m"))
        large = pairs.join(low, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("u", "m"))
        pairs = written(small.distinct(), "edges")
