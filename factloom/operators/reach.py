"""Reachability labels, so that everything below a node is a filter on ranges of numbers.

Each node takes one of its parents as its tree parent, which gives a forest that is numbered in preorder: what lies below a node
in its tree is an interval. A node's other descendants come through edges that the forest leaves out: such an edge gives its
parent, and whatever is above that, the child's interval. Those inherited intervals are kept by node. Labels are
made once for a graph and written; cycles need no care but in the forest, where one of them is cut at its smallest node.

Depths, sizes of subtrees and numbers all come by doubling: after round k a node knows what is within 2^k steps,
so a chain of a million nodes takes twenty rounds. The number of inherited intervals is that of pairs of a node and a tree that it reaches
by other edges; in type hierarchies that is small, in graphs of other kinds it can be as large as the closure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import scratch_path

#: Groups of siblings, whose sums come before those of single ones; intervals that are put into a plan one by one.
GROUPS, LITERALS = 256, 200
#: Levels that a walk goes down before labels are made instead.
WALK_LEVELS = 48
#: Numbers that one task of a sweep looks at, about.
SPAN = 1 << 16


class _Tables:
    """Tables of one labelling, written in turn."""

    def __init__(self, spark):
        self.spark, self.root, self.n = spark, scratch_path(spark, "reach"), 0

    def write(self, df: DataFrame, *order: str) -> DataFrame:
        self.n += 1
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")


def _climb(nodes: DataFrame, tables: _Tables) -> list[DataFrame]:
    """Round by round (node, up): the 2^k-th ancestor of each node that has one, in a forest given as (node, up)."""
    rounds, step = [], tables.write(nodes.where("up is not null"))
    while not step.isEmpty():
        rounds.append(step)
        step = tables.write(step.join(step.select(F.col("node").alias("up"), F.col("up").alias("further")), "up").select("node", F.col("further").alias("up")))
    return rounds


def _forest(nodes: DataFrame, tables: _Tables) -> DataFrame:
    """(node, up) without cycles: of each cycle the smallest node loses its parent."""
    limit, size = 1, nodes.count()
    step = tables.write(nodes.where("up is not null").withColumn("low", F.col("node")))
    while limit <= size and not step.isEmpty():
        far = step.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("low").alias("low2"))
        step = tables.write(step.join(far, "up").select("node", F.col("further").alias("up"), F.least("low", "low2").alias("low")))
        limit *= 2
    if step.isEmpty():
        return nodes
    # who still points on after as many steps as there are nodes points into a cycle
    on_cycle = step.select(F.col("up").alias("node")).distinct()
    cut = step.join(on_cycle, "node", "left_semi").where("low = node").select("node", F.lit(True).alias("cut"))
    return tables.write(nodes.join(cut, "node", "left").select("node", F.when(F.col("cut").isNull(), F.col("up")).alias("up")))


def walk(edges: DataFrame, seed: str, levels: int = WALK_LEVELS) -> DataFrame | None:
    """(fqn) of the seed and everything below it over (child, parent), level by level; None if ``levels`` don't reach
    the end. It costs a join of the edges for each level, and no labels."""
    spark = edges.sparkSession
    tables = _Tables(spark)
    e = tables.write(edges.where("child is not null and parent is not null and child <> parent").select("child", "parent"))
    seen = level = tables.write(spark.createDataFrame([(seed,)], "fqn string"))
    for _ in range(levels):
        met = e.join(level.select(F.col("fqn").alias("parent")), "parent", "left_semi").select(F.col("child").alias("fqn")).distinct()
        level = tables.write(met.join(seen, "fqn", "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.union(level)
    return None


@dataclass
class Labels:
    #: (node, pre, post) and (pre, lo, hi): intervals that the node of that number inherits.
    nodes: DataFrame
    inherited: DataFrame

    def below(self, seed: str) -> DataFrame:
        """(fqn) of the seed and everything below it. A seed without edges is alone."""
        own = self.nodes.where(F.col("node") == seed).select("pre", "post").first()
        spark = self.nodes.sparkSession
        if own is None:
            return spark.createDataFrame([(seed,)], "fqn string")
        more = self.inherited.where(F.col("pre") == own["pre"]).select("lo", "hi")
        some = more.limit(LITERALS + 1).collect()
        if len(some) <= LITERALS:
            held = F.col("pre").between(own["pre"], own["post"])
            for lo, hi in some:
                held = held | F.col("pre").between(lo, hi)
            return self.nodes.where(held).select(F.col("node").alias("fqn"))
        # a sweep over spans of numbers: a node is below if an interval that began before it hasn't ended
        at = lambda c: F.floor(c / SPAN)
        every = more.union(spark.createDataFrame([(own["pre"], own["post"])], "lo long, hi long")).select("lo", "hi", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))).alias("span"))
        events = every.select("span", F.col("lo").alias("pre"), "hi", F.lit(None).cast("string").alias("node"))
        rows = self.nodes.select(at(F.col("pre")).alias("span"), "pre", F.lit(None).cast("long").alias("hi"), "node")
        so_far = Window.partitionBy("span").orderBy("pre", F.col("node").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        swept = events.unionByName(rows).withColumn("reach", F.max("hi").over(so_far))
        return swept.where(F.col("node").isNotNull() & (F.col("reach") >= F.col("pre"))).select(F.col("node").alias("fqn"))


def label(edges: DataFrame) -> Labels:
    """Labels of a graph of (child, parent) names; edges with a null end or from a node to itself say nothing."""
    spark = edges.sparkSession
    tables = _Tables(spark)
    e = tables.write(edges.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct())
    chosen = e.groupBy("child").agg(F.min("parent").alias("up")).select(F.col("child").alias("node"), "up")
    tops = e.select(F.col("parent").alias("node")).distinct().join(chosen, "node", "left_anti")
    nodes = _forest(tables.write(chosen.unionByName(tops.withColumn("up", F.lit(None).cast("string")))), tables)
    jumps = _climb(nodes, tables)
    size = nodes.select("node", F.lit(1).cast("long").alias("size"))
    for jump in jumps:  # what is within 2^k steps below, and what is as far below those that are 2^k steps away
        far = jump.join(size, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        size = tables.write(size.join(far, "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    # places among siblings in two levels, so that no task orders all children of a node
    sized = nodes.join(size, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(GROUPS)).cast("int"))
    sized = tables.write(sized.withColumn("family", F.struct("up")))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("family", "part").agg(F.sum("size").alias("size"))
    parts = parts.select("family", "part", before(Window.partitionBy("family").orderBy("part")).alias("start"))
    placed = sized.withColumn("place", before(Window.partitionBy("family", "part").orderBy("node"))).join(parts, ["family", "part"])
    total = tables.write(placed.select("node", "size", (F.col("start") + F.col("place") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("pre")))
    for jump in jumps:
        far = jump.join(total.select(F.col("node").alias("up"), F.col("pre").alias("more")), "up").select("node", "more")
        total = tables.write(total.join(far, "node", "left").select("node", "size", (F.col("pre") + F.coalesce("more", F.lit(0))).alias("pre")))
    labels = tables.write(total.select("node", "pre", (F.col("pre") + F.col("size") - 1).alias("post")), "node")
    child, parent = (labels.select(F.col("node").alias(n), F.col("pre").alias(f"{n}_pre"), F.col("post").alias(f"{n}_post")) for n in ("child", "parent"))
    numbered = tables.write(e.join(child, "child").join(parent, "parent").drop("child", "parent"))
    outside = ~F.col("lo").between(F.col("parent_pre"), F.col("parent_post"))
    up = numbered.select(F.col("child_pre").alias("pre"), "parent_pre", "parent_post")
    new = tables.write(numbered.select(F.col("parent_pre").alias("pre"), F.col("child_pre").alias("lo"), F.col("child_post").alias("hi"), "parent_pre", "parent_post").where(outside).select("pre", "lo", "hi").distinct())
    found = new
    while not new.isEmpty():
        passed = new.join(up, "pre").where(outside).select(F.col("parent_pre").alias("pre"), "lo", "hi").distinct()
        new = tables.write(passed.join(found, ["pre", "lo", "hi"], "left_anti"))
        found = found.union(new)
    return Labels(labels, tables.write(found, "pre", "lo"))
