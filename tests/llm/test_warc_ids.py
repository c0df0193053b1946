"""WARC records with odd ids, copies over many tasks, and files that roll over."""

import hashlib

import pytest

from factloom.llm import warc
from factloom.llm.common import Scratch

ODD = ["a>b", "null", "", "x\r\nWARC-Type: y", "é %41", "<urn:page:1>", "a\x00b", None]


def brute(rows, least=0):
    largest = {}
    for i, html in rows:
        p = (html or "").encode()
        if p not in largest or (i is not None and (largest[p] is None or i > largest[p])):
            largest[p] = i
    out = []
    for i, html in rows:
        p = (html or "").encode()
        own = len(p) < least or largest[p] == i
        out.append((i, len(p), warc.b32(hashlib.sha1(p).digest()), "response" if own else "revisit", None if own else largest[p]))
    return sorted(out, key=repr)


def test_ids_come_back_as_they_are(spark):
    rows = [(i, f"page {k}") for k, i in enumerate(ODD)] + [(i, "the same") for i in ODD]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id string, url string, html string")
    assert sorted(map(tuple, warc.archive(pages).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("least", [0, 6, 10_000_000])
def test_copies_over_many_tasks(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "CHUNK", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "SENT", 3)
    texts = ["", None, "short", "exactly", "a popular payload of several chunks", "another one, ünïcode"]
    rows = [(k if k % 11 else None, texts[4] if k % 3 == 0 else texts[k % 6] if k % 5 else f"page {k}") for k in range(400)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id bigint, url string, html string").repartition(9)
    scratch = Scratch(spark, "t")
    files = warc.write(pages, scratch, min_revisit=least)
    assert files.count() > 9 and files.groupBy().sum("records").collect()[0][0] == len(rows)
    found = {}
    for c in sorted(warc.read(files).collect(), key=lambda c: c.chunk):
        if c.kind == "response" and c.id is not None:
            found[c.id] = found.get(c.id, b"") + bytes(c.data)
    ends = [(c.id and int(c.id), c.bytes, c.digest, c.kind, c.refers_to and int(c.refers_to)) for c in warc.read(files, last_only=True).collect()]
    assert sorted(ends, key=repr) == brute(rows, least)
    own = {i: h for i, h in rows if i is not None}
    assert all(v.decode() == (own[int(i)] or "") for i, v in found.items())
