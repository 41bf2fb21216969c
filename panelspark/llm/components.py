"""Connected components of a large edge table: every node ends up pointing at the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stage import stage


def _state(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); self loops keep a node that has no other edge.

    Rounds of large-star and small-star: all links of a node are pointed at its
    smallest neighbour. Minima are partial sums, and no neighbourhood is ever
    gathered. Each round is a written table, so lineage stays short. Null ends
    are dropped; repeated and reversed edges do no harm; no edges, no rows.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stage(low.select("a", F.col("m").alias("b")).union(small).distinct())
        old, state = state, _state(e)
        if state == old:
            break
    found = e.select(F.col("a").alias("node"), F.col("b").alias("low"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("low", "node").alias("component"))
