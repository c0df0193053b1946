"""Hard negatives by inner product, with a table of pivot distances.

One more component, sqrt(M^2 - |x|^2) with M the largest norm, turns the inner product with an
anchor (whose own extra component is 0) into a Euclidean distance: d^2 = M^2 + |a|^2 - 2 <a, x>. Distances of all
rows to a few pivots are stored once. For an anchor, the triangle inequality over them brackets every row's distance, hence its score;
rows whose bracket lies outside what can still be wanted are dropped, and the others' scores are computed exactly.

The anchors are a stated set of queries against all rows. They are taken in blocks of at most ``ANCHORS``, so
what is sent to the tasks is bounded; in each block every task streams its rows and keeps the few best for each
anchor, which combine in a window of a few rows a task. First the positives are found, then, with their scores, the negatives between two limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .embedding_dedup import choose_pivots

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is wanted between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Anchors of a block; pivots; rows that pivots are chosen from, at most.
ANCHORS, PIVOTS, SAMPLE = 16_384, 16, 4096
#: Cells (anchor x row) that a task looks at together.
CELLS = 1 << 19
#: Below this bound of scores, sums in double precision are exact.
EXACT = 2.0**52


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(256 * x) < EXACT, F.floor(256 * x).cast("double")).otherwise(256 * x))


def augment(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that gives all of them the length sqrt(``most``)."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)))


def bracket(to_row: np.ndarray, to_anchor: np.ndarray, norm: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (rows) with each row (columns), given both's distances to the pivots and the anchors' squared norms."""
    near = np.zeros((len(to_anchor), len(to_row)))
    far = np.full_like(near, np.inf)
    for p in range(to_row.shape[1]):
        a, x = to_anchor[:, p, None], to_row[None, :, p]
        np.maximum(near, np.abs(a - x), out=near)
        np.minimum(far, a + x, out=far)
    base, slack = (most + norm)[:, None], 1 + 1e-6 * most  # room for rounding
    return (base - far * far) / 2 - slack, (base - near * near) / 2 + slack


def exact_scores(anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted cells; whole products where many are wanted."""
    a, r = np.nonzero(wanted)
    if not exact:  # scores beyond what doubles hold
        big = [[int(v) for v in x] for x in (*anchors, *rows)]
        score = np.array([sum(p * q for p, q in zip(big[i], big[len(anchors) + j], strict=True)) for i, j in zip(a, r, strict=True)], object)
        if len(score) and max(abs(s) for s in score) >= 1 << 63:
            raise ValueError("a score doesn't fit a long")
        return a, r, score.astype(np.int64)
    if len(a) * 8 > wanted.size:
        return a, r, (anchors @ rows.T)[a, r].astype(np.int64)
    return a, r, np.einsum("ij,ij->i", anchors[a], rows[r]).astype(np.int64)


class Best:
    """The first ``k`` rows of each query by score, then by id (null last), then by number."""

    def __init__(self, queries: int, k: int):
        self.k, self.kept = k, pd.DataFrame({"q": np.array([], np.int64), "score": np.array([], np.int64), "missing": np.array([], bool), "id": np.array([], np.int64), "gid": np.array([], np.int64)})
        self.least = np.full(queries, -np.inf)  # the score of the k-th

    def add(self, **found: np.ndarray) -> None:
        if not len(found["q"]):
            return
        both = pd.concat([self.kept, pd.DataFrame(found)], ignore_index=True)
        both = both.iloc[np.lexsort((both["gid"], both["id"], both["missing"], -both["score"], both["q"]))]
        place = both.groupby("q").cumcount().to_numpy()
        self.kept = both[place < self.k].reset_index(drop=True)
        kth = both[place == self.k - 1]
        self.least[kth["q"].to_numpy()] = kth["score"]


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block: int = ANCHORS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that ``is_anchor``, an expression over ``vectors``.

    ``label`` may replace the label column. Rows whose label or vector is null, or whose vector holds nulls or non-finite numbers, take no part. Scores are inner products of floor(256 x); higher
    ones come first, ties by smaller id, a null id last; rows that repeat are rows of their own. Vectors of different lengths don't score with each other. A score that doesn't fit a long is an
    error. Ids are integers. Other columns are not read. ``block`` and ``pivots`` set how the work is done, which changes no result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    fit = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.when(fit, quantised(F.col(vector_col))).alias("v")
    ).where("label is not null and v is not null")
    rows = scratch.write(given.select(F.monotonically_increasing_id().alias("gid"), "*", F.size("v").alias("dim")), "rows")
    kind = rows.schema["label"].dataType.simpleString()
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    found = None
    for dim, top in rows.groupBy("dim").agg(F.max(norm).alias("top")).orderBy("dim").collect():
        of_dim = rows.where(F.col("dim") == dim)
        exact = top < EXACT
        some = of_dim.orderBy(F.xxhash64("v"), "gid").limit(SAMPLE).select("v").collect() if exact and dim else []
        points = choose_pivots(augment(np.array([r[0] for r in some], float), top), pivots) if some else np.zeros((0, dim + 1))
        stored = scratch.write(of_dim.mapInArrow(_measure(top, points), f"gid long, id long, label {kind}, anchor boolean, v array<double>, d array<double>"), "pivots")
        anchors = scratch.write(stored.where("anchor").select("gid", "id", "label", "v").repartitionByRange("id", "gid").sortWithinPartitions("id", "gid").select(F.monotonically_increasing_id().alias("at"), "*"), "anchors")
        for chunk in _chunks(anchors, block):
            part = _block(scratch, stored, chunk, points, top, exact, positives, negatives, least, most)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def _measure(top: float, points: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), points.shape[1] - 1)
            d = distances(augment(x, top), points) if len(points) else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("gid", "id", "label", "anchor", "v")] + [lists], ["gid", "id", "label", "anchor", "v", "d"])

    return run


def _matrix(lists, width: int) -> np.ndarray:
    return np.asarray(lists.flatten(), float).reshape(len(lists), width)


def _chunks(anchors: DataFrame, block: int) -> Iterator[list]:
    """The anchors in turn, at most ``block`` at once."""
    last = -1
    while True:
        some = anchors.where(F.col("at") > last).orderBy("at").limit(block).collect()
        if not some:
            return
        last = some[-1]["at"]
        yield some


def _block(scratch, stored: DataFrame, chunk: list, points: np.ndarray, top: float, exact: bool, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    spark = stored.sparkSession
    number = np.array([r["gid"] for r in chunk], np.int64)
    labels = np.array([r["label"] for r in chunk])
    a = np.array([r["v"] for r in chunk], float).reshape(len(chunk), -1)
    d = distances(np.hstack([a, np.zeros((len(a), 1))]), points) if len(points) else np.zeros((len(a), 0))
    sent = spark.sparkContext.broadcast((number, labels, a, d, (a * a).sum(axis=1)))

    def searched(windows, k: int):
        """Streams rows: the best ``k`` of each query. Without ``windows`` a query is an anchor, wanting its own label; with (anchor, low, high) it wants other labels and scores between the two."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, labels, a, d, norm = sent.value
            of, low, high = (np.arange(len(a)), np.full(len(a), -np.inf), np.full(len(a), np.inf)) if windows is None else windows.value
            best = Best(len(of), k)
            if not len(of):
                return
            begin = np.searchsorted(of, np.arange(len(a) + 1))  # an anchor's queries lie together
            for batch in batches:
                gid, ids = batch.column("gid").to_numpy(), batch.column("id")
                missing = np.asarray(ids.is_null())
                ids = ids.fill_null(0).to_numpy()
                tags = np.array(batch.column("label").to_pylist())
                x, dx = _matrix(batch.column("v"), a.shape[1]), _matrix(batch.column("d"), d.shape[1])
                step = max(1, CELLS // max(1, len(x)))
                for at in range(0, len(a), step):
                    to = min(len(a), at + step)
                    mine = slice(begin[at], begin[to])
                    if mine.start == mine.stop:
                        continue
                    floor = np.full(to - at, np.inf)  # what the anchor's least demanding query needs
                    np.minimum.at(floor, of[mine] - at, np.maximum(low[mine], best.least[mine]))
                    ceiling = np.full(to - at, -np.inf)
                    np.maximum.at(ceiling, of[mine] - at, high[mine])
                    wanted = (labels[at:to, None] == tags) != (windows is not None)
                    if windows is None:
                        wanted &= number[at:to, None] != gid
                    if exact and d.shape[1]:
                        under, over = bracket(dx, d[at:to], norm[at:to], top)
                        wanted &= (over >= floor[:, None]) & (under <= ceiling[:, None])
                    i, j, score = exact_scores(a[at:to], x, wanted, exact)
                    for n in range(int((begin[at + 1 : to + 1] - begin[at:to]).max())):  # the n-th query of each anchor
                        q = begin[at:to][i] + n
                        fits = q < begin[at + 1 : to + 1][i]
                        q = np.where(fits, q, mine.start)
                        fits &= (score >= np.maximum(low[q], best.least[q])) & (score <= high[q])
                        best.add(q=q[fits], score=score[fits], missing=missing[j[fits]], id=ids[j[fits]], gid=gid[j[fits]])
            kept = best.kept
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept["q"].to_numpy()), pa.array(kept["score"].to_numpy()), pa.array(kept["id"].to_numpy(), mask=kept["missing"].to_numpy()), pa.array(kept["gid"].to_numpy())], ["q", "score", "id", "gid"]
            )

        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "gid")
        some = stored.select("gid", "id", "label", "v", "d").mapInArrow(run, "q long, score long, id long, gid long")
        return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = searched(None, positives).orderBy("q", "rank").collect()  # at most ``positives`` for each anchor of the block
    of = np.array([r["q"] for r in first], np.int64)
    scores = [r["score"] for r in first]
    low, high = np.array([-(-least * s // 100) for s in scores], float), np.array([most * s // 100 for s in scores], float)
    windows = spark.sparkContext.broadcast((of, low, high))
    second = scratch.write(searched(windows, negatives), "negatives")
    sent.unpersist()
    windows.unpersist()
    positive = spark.createDataFrame(
        [(n, chunk[r["q"]]["id"], r["id"], r["score"]) for n, r in enumerate(first)], "q long, anchor_id long, positive_id long, positive_score long"
    )
    return second.join(positive, "q").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The query's anchors, and rows whose label is changed.
ANCHOR_EVERY, CHANGED_EVERY, LABELS = 100, 7, 10


def op12(spark, sf_dir: str) -> DataFrame:
    ident, label = F.col("vec_id"), F.col("label")
    changed = F.when(ident % CHANGED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), ident % ANCHOR_EVERY == 0, changed)


OP12_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {CHANGED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % {ANCHOR_EVERY} = 0
), p AS MATERIALIZED (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= {POSITIVES}
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score
QUALIFY rank <= {NEGATIVES}
"""
