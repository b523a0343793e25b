"""Connected components of a large sparse graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tidewater.llm.common import let_go, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (a, b).

    Rounds of large stars (each node hangs its larger neighbours on its smallest one) and small stars (each node
    hangs its smaller neighbours on the smallest of them) shrink every component to one star, in a number of rounds
    that grows as the logarithm of its size. Smallest neighbours are minima with map-side combination; a hub's edges
    meet its minimum in a join, which can be split. Each round is written, so that lineage doesn't grow. Only two
    numbers come to the driver each round. Repeated edges count once, an edge from a node to itself is ignored, and no
    edges give no rows.
    """
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        hung = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
        seen = Observation()
        current = materialize(hung.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        state = seen.get
        let_go(current.sparkSession)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components didn't settle")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
