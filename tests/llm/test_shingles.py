"""The exact join on shingle sets, and the pipeline's stage on it, against brute force."""

import random

import corpus_pipeline
from factloom.llm import shingles

SF = "/root/testdata/sf0.01"


def brute(texts, n=5, percent=80):
    """The smallest row number of each row's component."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if x == y or x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_classes_by_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    chain = [f"c{k}" for k in range(120)]
    texts = [" ".join(chain[k : k + 30]) for k in range(0, 90, 2)]  # neighbours link, others don't
    base = [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(25)]
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", " \n", "X y", "x  Y"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.component for r in shingles.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_digests_are_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        bits = int(np.bitwise_count((shingles.digest(x) ^ shingles.digest(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y)) and (n != 50 or bits > 30)


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted({rows[c][0] for c in brute([t for _, t in rows])})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_rare_elements_come_first_whatever_a_sample_holds(spark):
    """Pairs to compare don't grow with the square of a passage that some texts share: it isn't in any prefix."""
    import numpy as np

    passage = " ".join(f"p{k}" for k in range(40))
    texts = [f"{passage} " + " ".join(f"x{i}y{k}" for k in range(60)) for i in range(200)] + [f"z{i} {k}" for i in range(9000) for k in range(2)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = shingles.element_counts(docs)
    shared = shingles.elements(passage)
    assert not any(np.isin(shared, shingles.prefix(shingles.elements(t), counts)).any() for t in texts[:200])


def test_blocks_and_rounds_change_no_class(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(k) for k in range(60)]
    texts = []
    for _ in range(60):  # near copies of one text that differ too much from most others
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(60)] = f"n{rng.randrange(9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute(texts)
    for few_rows, block in ((0, 8192), (0, 7), (8, 16), (1000, 8192)):
        got = {r.id: r.component for r in shingles.near_classes(docs, few_rows=few_rows, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_pairs_of_a_group_span_its_components():
    import numpy as np
    import pyarrow as pa

    n = 300
    full = shingles.elements(" ".join(f"w{k}" for k in range(100)))
    table = pa.table({"node": np.arange(n), "size": np.full(n, len(full)), "pos": np.zeros(n, np.int64), "root": np.arange(n), "home": np.ones(n, bool), "i": np.full(n, -1), "j": np.full(n, -1), "digest": pa.array([shingles.digest(full)] * n, pa.list_(pa.int64()))})
    assert shingles.may_be_near(table).num_rows == n * (n - 1) // 2
    assert n - 1 <= shingles.may_be_near(table, spanning=True).num_rows < 3 * n
