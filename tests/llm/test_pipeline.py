"""The pipeline against a version that walks rows in plain Python."""

import hashlib

import pyarrow as pa
from conftest import cells
from test_shingles import brute

import corpus_pipeline
from factloom.llm import bpe, mixing, quality, toxicity

SF = "/root/testdata/sf0.001"


def keeps(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    windows = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)})
    if n < 10 or 100 * repeated > 20 * n:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    metrics = {
        "mean_word_length": sum(map(len, words)) / n,
        "symbol_ratio": sum(text.count(c) for c in quality.SYMBOLS) / n,
        "exclamation_ratio": text.count("!") / n,
        "stop_word_ratio": (1 + sum(w in quality.STOP_WORDS or w[0].lower() + w[1:] in quality.STOP_WORDS and w[0].isupper() for w in words)) / n,
        "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
    }
    return all((r.least is None or metrics[r.metric] >= r.least) and (r.most is None or metrics[r.metric] <= r.most) for r in quality.RULES)


def test_pipeline_by_brute_force(spark):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if keeps(r["text"])]
    model = toxicity.train(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if model.score(r["text"]) < 0.5]
    rows.sort(key=lambda r: r["doc_id"])
    rows = [r for i, (r, c) in enumerate(zip(rows, brute([r["text"] for r in rows]), strict=True)) if i == c]
    c = duckdb.connect()
    c.register("documents", pa.Table.from_pylist(rows))
    taken = {i: -(-t // n) for i, n, t in c.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP1_SQL}) WHERE taken > 0").fetchall()}
    lib = bpe.encoder(bpe.default_path()).v.library
    want = []
    for r in rows:
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want += [(r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] * taken.get(r["doc_id"], 0)
    assert want and cells(corpus_pipeline.run(spark, SF).collect()) == cells(want)


def test_stages_keep_columns_and_take_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
