"""Connected components of an edge table, in rounds of grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import compact_checkpoint, ensure_checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for each node of ``edges`` (a, b).

    Alternating large-star and small-star steps, about log(nodes) rounds: each node's smallest neighbour is a map-side combined
    minimum, and each edge is moved to it by a join. Every round is written to the checkpoint folder, in files by its edges, so a lost
    executor costs one round and plans stay short. Edges whose ends are equal or null only add their node.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    loops = edges.where("a = b").select("a")
    pairs, before, size = edges.where("a <> b"), None, edges.count()
    state = F.struct(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"))
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = compact_checkpoint(small.select("e.a", "e.b").where("a <> b").distinct(), size)
        now = pairs.agg(state.alias("s")).first()["s"]
        if now == before:
            break
        before, size = now, now["n"]
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(pairs.select("b", "b")).union(loops.select("a", F.col("a"))).groupBy("node").agg(F.min("component").alias("component"))
