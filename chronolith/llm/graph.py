"""Connected components by alternating large-star and small-star steps.

No vertex gathers its neighbours in one task: minima are aggregated before the shuffle,
and the join that hands them out is one that Spark can split where a vertex is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _with_least(edges: DataFrame) -> DataFrame:
    """Rows (u, v, least): ``least`` is the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("least"))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _with_least(down)
    return star.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(star.select("u", F.col("least").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (two integer columns); a component's name is its smallest node.

    Null ends, loops and repeated edges count for nothing; nodes with loops only are not returned.
    """
    u, v = edges.columns[:2]
    current = checkpointed(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(limit):
        current = checkpointed(_small_star(_large_star(current).distinct()).distinct())
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
