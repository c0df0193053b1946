"""Closures over type and annotation edges, duplicate classes, dependency trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Session
from ..shared import ensure_checkpoint_dir

def find_implementations(s: Session, fqn: str, direct: bool = False) -> DataFrame:
    """Classes below ``fqn``: one level, or all levels without ``fqn`` itself."""
    if direct:
        found = s.type_edges.where(F.col("parent") == fqn).select(F.col("child").alias("fqn")).distinct()
    else:
        found = s.types_below(fqn).where(F.col("fqn") != fqn)
    return s.with_jar(s.classes.select("fqn", "kind", "shard_id").join(found, "fqn", "left_semi"))


def find_by_annotation(s: Session, fqn: str, direct: bool = False) -> DataFrame:
    """Classes that carry ``fqn``, or an annotation type that carries it at any depth."""
    marks = s["annotations"].where("target_kind = 'class'")
    if direct:
        marks = marks.where(F.col("annotation_fqn") == fqn)
    else:
        marks = marks.join(s.annotations_below(fqn).withColumnRenamed("fqn", "annotation_fqn"), "annotation_fqn", "left_semi")
    classes = s["classes"].select("shard_id", F.col("fqn").alias("class_fqn"), "kind")
    return s.with_jar(marks.join(classes, ["shard_id", "class_fqn"]).select("class_fqn", "kind", F.col("annotation_fqn").alias("matched_annotation"), "attributes", "shard_id"))


def class_conflicts(s: Session) -> DataFrame:
    """Pairs of shards that share classes, with their number. Pairs come from the shards
    of one class, so rows grow with the copies of a class and not with its shards squared beyond them."""
    owned = s.classes.where(~F.col("simple_name").isin("package-info", "module-info")).select("fqn", "shard_id").distinct()
    many = owned.groupBy("fqn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fqn")
    dup = owned.join(many, "fqn", "left_semi")
    a, b = dup.alias("a"), dup.alias("b")
    pairs = a.join(b, (F.col("a.fqn") == F.col("b.fqn")) & (F.col("a.shard_id") < F.col("b.shard_id")))
    return pairs.groupBy(F.col("a.shard_id").alias("jar_a"), F.col("b.shard_id").alias("jar_b")).agg(F.count(F.lit(1)).alias("shared_classes"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(coordinate, depth, path, direct) of a forest given as (coordinate, parent): roots have no parent.
    It may be of any depth; a cycle below a root is an error."""
    ensure_checkpoint_dir(nodes.sparkSession)
    level = nodes.where("parent is null").select("coordinate", F.lit(0).alias("depth"), F.array("coordinate").alias("trail")).checkpoint()
    out, depth, n = level, 0, nodes.alias("n")
    while True:
        depth += 1
        step = n.join(level.alias("l"), F.col("n.parent") == F.col("l.coordinate"))
        step = step.select("n.coordinate", F.lit(depth).alias("depth"), "l.trail", F.array_contains("l.trail", F.col("n.coordinate")).alias("met")).checkpoint()
        if step.isEmpty():
            break
        if not step.where("met").isEmpty():
            raise ValueError("the dependencies form a cycle")
        level = step.select("coordinate", "depth", F.concat("trail", F.array("coordinate")).alias("trail"))
        out = out.union(level)
    return out.select("coordinate", "depth", F.array_join("trail", " > ").alias("path"), (F.col("depth") == 1).alias("direct"))


def merge_reactor(sections: DataFrame) -> DataFrame:
    """Of artifacts (coordinate, depth, section, path) listed by several modules the shallowest, then the first."""
    best = sections.groupBy("coordinate").agg(F.min(F.struct("depth", "section", "path")).alias("b"))
    return best.select("coordinate", "b.depth", "b.section", "b.path")


def trails(resolved: DataFrame) -> DataFrame:
    """(coordinate, parent, depth, path, direct) of artifacts whose ``trail`` lists coordinates from the root to
    the artifact; the root alone is left out."""
    t, depth = F.col("trail"), F.size("trail") - 1
    below = resolved.where(depth > 0)
    return below.select(F.element_at(t, -1).alias("coordinate"), F.element_at(t, -2).alias("parent"), depth.alias("depth"), F.array_join(t, " > ").alias("path"), (depth == 1).alias("direct"))


def first_visit(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth, path) of a breadth-first walk down (parent, child, position) edges from
    ``root``, of any depth: a node counts where it is met first, by depth and then by the parent's path and position."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    seen = spark.createDataFrame([(root, 0, root)], "node string, depth int, path string")
    level, depth = seen, 0
    while True:
        depth += 1
        step = edges.join(level, edges["parent"] == level["node"]).select(F.col("child").alias("node"), F.struct("path", "position").alias("o"))
        best = step.groupBy("node").agg(F.min("o").alias("o")).select("node", F.lit(depth).alias("depth"), F.concat("o.path", F.lit(" > "), "node").alias("path"))
        level = best.join(seen.select("node"), "node", "left_anti").checkpoint()
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen
