"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) that goes back to the edges. Nodes with many edges are told by
the same aggregate: there are at most 200 000 of them, as each has at least one in 100 000 of the edges, so their minima
are broadcast and their edges stay where they are; the edges of all other nodes are joined by a shuffle. Under a million
edges, which one task could hold, all are. Each round is
written to the shared folder, with a checksum gathered as it is written; the driver sees that one row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import new_path


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and checksum."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    path = new_path(edges.sparkSession, "components")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), checksum.alias("sum")).write.parquet(path)
    got = seen.get
    return edges.sparkSession.read.schema(edges.schema).parquet(path), (got["n"] or 0, got["sum"])


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours among these edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    if n < 1_000_000:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") >= max(1000, n // 100_000)).select("u", F.col("m").alias("hub")))
    told = edges.join(hubs, "u", "left")
    known = told.where("hub is not null").select("u", "v", F.col("hub").alias("m"))
    return known.unionByName(told.where("hub is null").select("u", "v").join(least.select("u", "m"), "u"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: two columns of one orderable type.

    Nodes that no edge names are not listed; loops and edges with a null end count for nothing.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now, seen = _written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = _with_least(large, 2 * seen[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        was = seen
        now, seen = _written(small)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    return stars.unionByName(roots.withColumn("component", F.col("node")))
