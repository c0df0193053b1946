"""Hard negatives against SQL, with blocks of few anchors, hot vectors, awkward rows and scores beyond what doubles hold."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from factloom.llm import hard_negatives

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def test_query_matches_sql(spark):
    same(hard_negatives.op12(spark, SF), hard_negatives.OP12_SQL, SF)


def run(spark, ids, vectors, labels, **how):
    rows = [(i, [None if x is None else float(x) for x in v] if v is not None else None, label, "x", 1, 2.0) for i, v, label in zip(ids, vectors, labels, strict=True)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, gid int, score double").withColumns({n: F.lit("y") for n in ("d", "q", "anchor", "id")})
    d = d.repartition(4)
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(d, F.col("vec_id") % 100 == 0, changed, **how)


def against_sql(spark, ids, vectors, labels, **how):
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    return same(run(spark, ids, vectors, labels, **how), hard_negatives.OP12_SQL, embeddings=table)


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"pivots": 1}, {"block": 1, "pivots": 40}])
def test_blocks_and_pivots_change_nothing(spark, how):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    x[200:400] = x[200] + 0.01 * rng.normal(size=(200, 6))  # near one another
    x[400:600] = x[100]  # a hot vector
    assert against_sql(spark, list(range(700)), x.tolist(), rng.integers(0, 4, 700).tolist(), **how)


def test_awkward_rows(spark):
    good = [[1, 2, 3], [2, 2, 2], [3, 1, 0.5], [-1, -2, 0], [0, 0, 0], [0.1, 0.2, 0.3], [1, 2, 3], [1.5, 1, 1]]
    ids = list(range(100, 108)) + [0, 0, 200, 300, 400, 500, 600, 700, 800, 1, 2, 3, 4]
    vectors = good + [[1, 1, 1], [1, 1, 1], [1, None, 1], [NAN, 1, 1], [INF, 0, 0], None, [], [1, 1], [1, 1, 1], [1, 2], [2, 1], [1, 1], [1, 1]]
    labels = [1, 1, 2, 2, 1, 3, 2, 1, 1, 1, 1, 1, 1, 1, 1, 5, None, 5, 5, 6, 6]
    assert against_sql(spark, ids, vectors, labels)


def test_a_null_id_comes_last_and_nothing_gives_nothing(spark):
    found = run(spark, [100, 101, None, 102], [[1.0, 0], [1, 0], [0.5, 0], [0.5, 0]], [1, 1, 2, 2]).orderBy("rank").collect()
    assert [(r["positive_id"], r["negative_id"], r["negative_score"]) for r in found] == [(101, 102, 32768), (101, None, 32768)]
    assert run(spark, [], [], []).collect() == []
    assert run(spark, [1, 2], [[1.0], [1.0]], [1, 1]).collect() == []  # no anchor


def test_scores_beyond_doubles(spark):
    ids, vectors = [100, 101, 102, 103], [[2.0**20 + 1, 2.0**18 + 0.25], [2.0**20 + 1, 2.0**18], [2.0**19 + 1, 2.0**18 + 0.5], [2.0**19 + 1, 2.0**18 + 0.75]]
    q = [[int(256 * x) for x in v] for v in np.array(vectors, np.float32).tolist()]
    dot = lambda i, j: sum(a * b for a, b in zip(q[i], q[j], strict=True))
    found = run(spark, ids, vectors, [1, 1, 2, 2]).orderBy("rank").collect()
    assert [(r["negative_id"], r["positive_score"], r["negative_score"]) for r in found] == [(103, dot(0, 1), dot(0, 3)), (102, dot(0, 1), dot(0, 2))]
    with pytest.raises(Exception, match="fit a long"):
        run(spark, [100, 101, 102], [[1e30], [1e30], [5e29]], [1, 1, 2]).collect()


def test_brackets_hold_scores():
    rng = np.random.default_rng(1)
    x, a = np.floor(256 * rng.normal(size=(300, 8))), np.floor(256 * rng.normal(size=(20, 8)))
    top = max((x * x).sum(axis=1).max(), (a * a).sum(axis=1).max())
    points = hard_negatives.choose_pivots(hard_negatives.augment(x, top), 8)
    low, high = hard_negatives.bracket(hard_negatives.distances(hard_negatives.augment(x, top), points), hard_negatives.distances(np.hstack([a, np.zeros((20, 1))]), points), (a * a).sum(axis=1), top)
    assert (low <= a @ x.T).all() and (a @ x.T <= high).all()
    assert (high < np.percentile(a @ x.T, 99)).any()  # and leave something out
