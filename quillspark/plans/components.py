"""Connected components of an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.storage import Workspace


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Components by alternating large-star and small-star rounds.

    Every round hooks each node's larger neighbours to its smallest one; rounds needed grow with the logarithm
    of the longest path. Each is two aggregations (min by node, combined before the shuffle) and two equi-joins
    whose hot nodes adaptive execution splits. Rows with a null end and loops are ignored, repeated edges count
    once. An empty table gives an empty result.

    Returns ``node, component`` for every node with an edge; ``component`` is the smallest node reachable.
    """
    work = Workspace(edges.sparkSession, "components")
    both_ends = F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))
    e = work.save(edges.where(both_ends).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after_edges = work.save(_small_star(_large_star(e)))
        work.drop(e)
        e, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(row)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
