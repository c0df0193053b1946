"""How the work is cut up changes no result: many cells, shards and buckets where the given tables need one."""

import numpy as np
from conftest import cells

from factloom.llm import embedding_dedup, mixing, simhash

SF = "/root/testdata/sf0.01"


def test_many_pivots(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(k, (base[k % 30] + rng.normal(size=8) * rng.choice([0.02, 0.3])).tolist(), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = cells(embedding_dedup.near_classes(df).collect())
    assert sum(int(float(r[1])) > 0 for r in whole) > 100
    assert cells(embedding_dedup.near_classes(df, cell_vectors=12).collect()) == whole
    assert cells(embedding_dedup.near_classes(df, cell_vectors=25, block=9).collect()) == whole


def test_many_leaves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = cells(simhash.near_classes(docs).collect())
    assert cells(simhash.near_classes(docs, shard_points=32).collect()) == whole


def test_many_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = cells(mixing.mix(docs).collect())
    assert cells(mixing.mix(docs, bucket_rows=16, chunk=16).collect()) == whole
