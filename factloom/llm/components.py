"""Connected components over an edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Both kinds of round are a minimum
per node, which combines before the shuffle, and a join back to the edges. The
minima are written first, so either side of that join is a plain scan and
adaptive execution can split the partitions of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v) of one orderable type, in either direction, repeats and
    loops allowed. Returns one row (node, root) for each node with an edge to
    another node; root is the smallest node of the component."""
    e = scratch.write(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = scratch.write(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        scratch.drop(low)
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        linked = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(linked.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(low, large, e)
        e, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
