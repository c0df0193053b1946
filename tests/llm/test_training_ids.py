"""Token ids in binary: op7's encoder packed, and what op8 writes."""

import base64

import numpy as np

from factloom.llm import bpe, training_order
from factloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_packed_ids_are_the_encoders(spark):
    texts = ["The quick, brown fox.", None, "", " \n", "Ünï 日本語 \x00 x", "a [UNK] b 123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in bpe.packed(docs).collect()}
    e = bpe.encoder(bpe.default_path())
    assert got == {i: e.encode(t) for i, t in enumerate(texts)}


def ranks():
    with open(training_order.default_path(), "rb") as f:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}


def test_ids_decode_to_the_text(spark):
    texts = ["The quick, brown fox.", None, "", " \n", "Ünï 日本語 \x00 x", "<|endoftext|> b 123", "x" * 600_000, "ab  cd\t" * 90_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = ranks()
    for r in training_order.bpe_ids(docs).collect():
        assert b"".join(names[i] for i in np.frombuffer(bytes(r.ids), "<u2").tolist()).decode() == (texts[r.id] or "")
    assert max(names) < training_order.BPE_END


def test_op8_holds_every_document(spark, monkeypatch):
    folders = []
    keep = Scratch.folder
    monkeypatch.setattr(Scratch, "folder", lambda s, name: folders.append(keep(s, name)) or folders[-1])
    done = training_order.op8(spark, SF)
    read, rows, names = training_order.read_slots(folders[0], 0, 10**7), done.orderBy("sequence").collect(), ranks()
    documents, one = [], []
    for r in rows:
        for x in read[r.slot][: r.n_tokens].tolist():
            if x == training_order.BPE_END:
                documents.append(b"".join(map(names.get, one)).decode())
                one = []
            else:
                one.append(x)
    assert sorted(documents) == sorted(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_shards_by_ranges_ids_of_any_kind_and_a_second_attempt(spark, monkeypatch):
    import datetime

    from pyarrow import fs as pafs
    from pyspark.sql import functions as F

    monkeypatch.setattr(training_order, "TASK_SHARDS", 3)
    day = datetime.date(2020, 1, 1)
    docs = spark.createDataFrame([(day + datetime.timedelta(k), "t" * (k % 40)) for k in range(3000)], "doc_id date, text string")
    done, folder = training_order.materialise(docs, training_order.byte_ids(F.col("text")), Scratch(spark, "s"), length=16, per_shard=4)
    n = done.count()
    read = training_order.read_slots(folder, 0, n)
    assert len(read) == n and (read == training_order.END).sum() == 3000 and (read == ord("t")).sum() == sum(k % 40 for k in range(3000))
    assert done.schema["first_doc_id"].dataType.simpleString() == "date" and done.agg(F.max("shard")).first()[0] > 3 * 4 * 8
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{root}/shard-00000000-0.bin") as f:  # what a task that failed may leave
        f.write(b"half")
    assert (training_order.read_slots(folder, 0, n) == read).all()
