"""Embedding near-duplicates: an exact metric range join.

On the unit sphere cosine >= c is distance <= sqrt(2 - 2c). Pivots cut the
sphere into cells (the points nearest to a pivot); a vector is at home in one
cell and a guest in every other that may hold a vector within the distance. By the
triangle inequality in its Euclidean form, that is a cell no further than the
distance behind the plane halfway between its pivot and the own one. Cells of
one label join on their own, block by block as matrix products in double precision, and return counts and spanning
edges, never pairs.

Equal vectors of a label are merged first with their number, so a group of
exact copies costs one row. A cell that the bounds leave large is cut into blocks:
each pair of blocks, or block with itself, is a task, so no task holds more than
two blocks however many vectors lie close together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks
from .common import Scratch, table
from .components import connected_components

COSINE = 0.98
#: Vectors that pivots are chosen from, at most; vectors a label's cell should hold; pivots at most.
SAMPLE = 4096
CELL_VECTORS = 4096
MAX_PIVOTS = 256
#: Vectors of a block, about, where a cell is cut into blocks.
BLOCK_VECTORS = 16_384
#: Room for rounding in the bounds, in distance.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_pivots(vectors: np.ndarray, k: int) -> np.ndarray:
    """k vectors, each the furthest from those before, over a sample."""
    chosen = [0]
    least = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def cells(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of every visit."""
    cos = vectors @ pivots.T
    home = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))  # between pivots
    # distance behind the plane halfway between pivot q and the own pivot p: (|v-q|^2 - |v-p|^2) / (2 |p-q|)
    with np.errstate(divide="ignore", invalid="ignore"):
        behind = (cos[np.arange(len(vectors)), home][:, None] - cos) / apart[home]
    visit = ~(behind > reach + SLACK)  # 0/0, twin pivots, counts as a visit
    row, cell = np.nonzero(visit)
    return row, cell, cell == home[row]


def join_cell(vectors: np.ndarray, home: np.ndarray, count: np.ndarray, least: float, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the number of others that it links with (for those at home), and a class label.
    Those at home are compared with all, or, of two blocks (not ``whole``), with those not at home."""
    links = np.zeros(len(vectors), np.int64)
    labels = np.arange(len(vectors))
    at_home = np.flatnonzero(home)
    others = np.arange(len(vectors)) if whole else np.flatnonzero(~home)
    step = max(1, (1 << 22) // max(1, len(others)))
    for at in range(0, len(at_home), step):
        rows = at_home[at : at + step]
        near = vectors[rows] @ vectors[others].T >= least
        if whole:
            near[np.arange(len(rows)), rows] = True
        links[rows] = near @ count[others] - whole
        for r, hit in zip(rows, near, strict=True):
            if hit.sum() > whole:
                names = np.unique(labels[np.append(others[hit], r)])
                if len(names) > 1:
                    labels[np.isin(labels, names)] = names[0]
    return links, labels


def near_classes(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK_VECTORS, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows without a label or with a vector that is null, empty, zero or holds nulls or
    non-finite numbers link with nothing: 0 links, their own id, kept. Vectors of
    different lengths don't link. A null id is kept only if its whole component has null ids.
    Repeated ids are separate rows; other columns are not read. ``cell_vectors`` and ``block`` set
    how the work is cut up, which changes no result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = F.col("label").isNotNull() & F.coalesce(fit, F.lit(False))
    valid = rows.where(good)
    distinct = valid.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    reps = scratch.write(distinct.select(F.monotonically_increasing_id().alias("gid"), "label", F.size("v").alias("dim"), "v", "n", "rep"), "reps")
    sizes = reps.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "dim").limit(64).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim, most in sizes:  # other lengths, if any, are one cell for each label
        k = min(MAX_PIVOTS, math.ceil(most / cell_vectors))
        some = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "gid").limit(SAMPLE).select("v").collect()
        pivots[dim] = choose_pivots(unit(np.array([r[0] for r in some], float)), k)
    shared = spark.sparkContext.broadcast(pivots)
    reach = math.sqrt(2 - 2 * least)
    kind = vectors.schema[label_col].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = unit(np.array(part["v"].tolist(), float))
                p = shared.value.get(dim)
                row, cell, home = cells(x, p, reach) if p is not None else (np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool))
                part = part.iloc[row]
                yield pd.DataFrame({"label": part["label"].to_numpy(), "dim": dim, "cell": cell, "gid": part["gid"].to_numpy(), "n": part["n"].to_numpy(), "home": home, "v": part["v"].to_numpy()})

    def join(b: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(b["v"].tolist(), float))
        home, gid = b["home"].to_numpy(bool), b["gid"].to_numpy()
        links, labels = join_cell(x, home, b["n"].to_numpy(), least, bool((b["i"] == b["j"]).all()))
        return pd.DataFrame({"gid": gid, "links": np.where(home, links, 0), "root": gid[labels]})

    dealt = reps.mapInPandas(deal, f"label {kind}, dim int, cell int, gid long, n long, home boolean, v array<double>")
    joined = scratch.write(in_blocks(dealt, ["label", "dim", "cell"], "gid", block, scratch).groupBy("label", "dim", "cell", "i", "j").applyInPandas(join, "gid long, links long, root long"), "joined")
    classes = connected_components(joined.select(F.col("gid").alias("u"), F.col("root").alias("v")), scratch)
    links = joined.groupBy("gid").agg(F.sum("links").alias("links"))
    rooted = scratch.write(reps.join(links, "gid").join(classes, reps["gid"] == classes["node"], "left").select("gid", "label", "v", "rep", "links", F.coalesce("root", "gid").alias("root")), "rooted")
    least_id = scratch.write(rooted.groupBy("root").agg(F.min("rep").alias("component")), "least")
    named = scratch.write(rooted.join(least_id, "root").select("label", "v", "links", "component"), "named")
    linked = valid.join(named, ["label", "v"]).select("id", "links", "component")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.union(alone).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP6_SQL = f"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), g AS MATERIALIZED (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.r, b.r AS o, b.vec_id AS other FROM g a JOIN g b
  ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}
), c(r, o) AS (
  SELECT r, r FROM e UNION SELECT c.r, l.o FROM c JOIN l ON c.o = l.r
), n AS (
  SELECT r, count(*) AS n FROM l GROUP BY r
)
SELECT e.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(x.vec_id) AS component_id, e.vec_id IS NOT DISTINCT FROM min(x.vec_id) AS kept
FROM e JOIN c ON c.r = e.r JOIN e x ON x.r = c.o LEFT JOIN n ON n.r = e.r GROUP BY e.r, e.vec_id
"""
