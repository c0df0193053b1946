"""Spelling variants against SQL and brute force."""

import random
import zlib

import pyarrow as pa
from conftest import same
from pyspark.sql import functions as F

from factloom.llm import spelling
from factloom.llm.common import Scratch

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, word string, n string, id string"


def test_query_matches_sql(spark):
    assert len(same(spelling.op13(spark, SF), spelling.OP13_SQL, SF)) > 1000


def test_awkward_texts_match_sql(spark):
    rows = [(1, "Receive receive RECEIVE " * 40 + "recieve Recieve receeve receeve"), (2, None), (3, ""), (4, "x" * 30_000 + " " + "x" * 30_000), (5, "ÀÉÎÕÜßà ÀÉÎÕÜßà àéîõüß× àéîõüß×"), (None, "receeve without an id receeve"), (6, "short words only a b c"), (6, "receives receives receives'receives-receives_receives9receives")]
    rows += [(i, f"abcdefgh abcdefgi{'j' * (i % 2)} straßeñ strasseñ naïveté") for i in range(100, 160)] * 2
    d = spark.createDataFrame([(i, t, "w", "n", "i") for i, t in rows], DOCS)
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
    assert len(same(spelling.variants(spelling.word_counts(d)), spelling.OP13_SQL, documents=table)) > 10
    assert spelling.variants(spelling.word_counts(d.limit(0))).collect() == []


def test_runs_by_brute_force(spark):
    import re

    texts = [(i, "Über naïve Schifffahrtsgesellschaft ÀÀÀÀÀÀÀ aaaaaaa aaaaaab" + "z" * i) for i in range(200)]
    want = []
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want += [run] if len(run) >= 7 else []
    assert sorted(r[0] for r in spelling.runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()) == sorted(want)


def edits(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(4)
    letters = "abcàéÿz日é"
    words = {"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(900)} | {"a" * k for k in range(1, 12)} | {"ab" * 6, "ba" * 6}
    words |= {w[:i] + rng.choice(letters) + w[i + rng.randrange(2) :] for w in list(words) for i in [rng.randrange(len(w))]}
    words = sorted(words)
    want = {(a, b) if (len(a), a.encode()) < (len(b), b.encode()) else (b, a) for n, a in enumerate(words) for b in words[n + 1 :] if abs(len(a) - len(b)) < 2 and edits(a, b)}
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark, "t")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_lead_to_the_last_form(spark):
    rows = [("aaaaaaaa", 1), ("aaaaaaab", 10), ("aaaaaabb", 100), ("aaaaabbb", 1000), ("aaaabbbb", 10_000), ("aaabbbbb", 10_000), ("zzzzzzzz", 5), ("zzzzzzzy", 49)]
    d = spark.createDataFrame(rows, "word string, n long").withColumns({c: F.lit(1) for c in ("form", "m", "l", "near", "top")})
    found = {r["word"]: r.asDict() for r in spelling.variants(d).collect()}
    assert {w: (r["form"], r["root"]) for w, r in found.items()} == {
        "aaaaaaaa": ("aaaaaaab", "aaaabbbb"), "aaaaaaab": ("aaaaaabb", "aaaabbbb"), "aaaaaabb": ("aaaaabbb", "aaaabbbb"), "aaaaabbb": ("aaaabbbb", "aaaabbbb"),
        "aaaabbbb": (None, "aaaabbbb"), "aaabbbbb": (None, "aaabbbbb"), "zzzzzzzz": (None, "zzzzzzzz"), "zzzzzzzy": (None, "zzzzzzzy"),
    }
    assert found["aaaaaaab"]["n_near"] == 2 and found["aaaaaaab"]["form_n"] == 100
