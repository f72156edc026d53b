"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """u, v -> node, root: the smallest node reachable, for every node with an edge to another.

    Each round points nodes at the smallest neighbour they know, until nothing changes: about the
    logarithm of the longest path. Minima are pre-aggregated, no neighbourhood is ever gathered,
    and each round is written to the shared folder, so a lost executor costs one round at most.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    e = common.table(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), label)
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.table(large.distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(least, F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = common.table(moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), label)
        common.drop(large)
        common.drop(e)
        e, before = small, mark
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
