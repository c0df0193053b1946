"""Chat formatting against SQL, trees against a walk in Python, escapes by round trip."""

import hashlib
import random

import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from factloom.llm import chat_format
from factloom.llm.common import Scratch

SF = "/root/testdata/sf0.01"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 5000), (1, 1, "assistant", "x" * 5000), (1, 1, "assistant", "a tie"), (1, None, "system", "no turn comes first"),
    (2, 5, None, None), (2, 3, "assistant", None), (2, 9, "tool", "[ROLE]tool[TEXT]"), (None, 1, "user", "no id"), (None, 1, "user", "no id"), (None, 2, "assistant", ""),
    (3, 0, "<s>[TEXT]", r"</s> <\s> <\\s> [\INST] [/\INST] <\[INST] \<s> <s"), (3, 1, "assistant", "[INST] é 日本 \x00 \n[/INST]</s>"), (4, 2, "assistant", "alone"),
]
KIND = "conv_id bigint, turn bigint, role string, text string"


def extra(df):
    """Columns whose names the operator uses inside."""
    return df.withColumns({n: F.lit("x") for n in ("tree", "id", "parent", "branch", "depth", "piece", "t", "i", "up")})


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("part_chars", [chat_format.PART_CHARS, 12])
def test_chains_match_sql(spark, rows, part_chars):
    given = extra(spark.createDataFrame(rows + [(-7, i, r, chat_format.HOSTILE_TEXT) for i, r in enumerate(("user", "assistant"))], KIND))
    found = chat_format.digests(chat_format.format_chains(given, part_chars=part_chars)).drop("branch").withColumnRenamed("tree", "conv_id")
    names = ("conv_id", "turn", "role", "text")
    table = pa.table({n: pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.string()) for k, n in enumerate(names)})
    same(found, chat_format.OP11_SQL, conversations=table)


def test_query_matches_sql(spark):
    same(chat_format.op11(spark, SF), chat_format.OP11_SQL, SF)


def test_nothing_said(spark):
    assert chat_format.digests(chat_format.format_chains(spark.createDataFrame([], KIND))).collect() == []


def test_escapes_give_texts_back(spark):
    rng = random.Random(3)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "TEXT]", "ROLE]", "SYS]", "x", "\n", "</s>", "[INST]"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(3000)]
    for text, escaped in spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat_format.escape(F.col("text"))).collect():
        assert chat_format.unescape(escaped) == text
        assert not any(mark in escaped for pair in chat_format.MARKS.values() for mark in pair)
        assert not any(mark in escaped for mark in (chat_format.OPEN_ROLE, chat_format.OPEN_TEXT, chat_format.CLOSE_TEXT))


def walked(links, branches):
    """Paths by a walk from every leaf."""
    best = {}
    for tree, i, parent, score in links:
        p, s = best.get((tree, i), (None, None))
        parents = [x for x in (p, parent) if x is not None]
        best[tree, i] = (min(parents) if parents else None, max(s or -9e9, score if score is not None else -9e9))
    up = {(t, i): (t, p) if p is not None and (t, p) in best else None for (t, i), (p, _) in best.items()}
    for node in sorted(best):
        seen = []
        while node is not None and node not in seen:
            seen.append(node)
            node = up[node]
        if node is not None:
            up[min(seen[seen.index(node) :])] = None
    parents, rows, ranked = set(up.values()), [], {}
    for node in best:
        if node not in parents:
            path = [node]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            ranked.setdefault(node[0], []).append((-sum(s if (s := best[n][1]) > -9e9 else 0 for n in path), node[1], path[::-1]))
    for tree, found in ranked.items():
        for branch, (_, _, path) in enumerate(sorted(found)[:branches], 1):
            rows += [(tree, n[1], branch, depth) for depth, n in enumerate(path)]
    return sorted(rows)


@pytest.mark.parametrize("branches", [1, 3, 100])
def test_paths_by_a_walk(spark, branches):
    rng = random.Random(branches)
    links = []
    for tree in range(12):
        n = rng.choice([1, 2, 9, 30])
        for i in range(n):  # parents of any number, so circles, too; some lie in no tree
            links.append((tree, i, rng.choice([None, i - 1, rng.randrange(n), i, 99]) if tree % 3 else (i - 1 if i else None), rng.choice([None, 1.0, 2.0, -1.0])))
    links += rng.sample(links, 20) + [(0, 0, None, 5.0)]
    given = spark.createDataFrame(links, "tree long, id long, parent long, score double").withColumns({n: F.lit("x") for n in ("t", "i", "up", "branch", "depth", "total")})
    got = sorted(map(tuple, chat_format.paths(given, branches).collect()))
    assert got == walked(links, branches)


def test_branches_become_conversations(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.5, "assistant", "bad"), (1, 4, 2, 0.0, "user", "thanks"), (None, 7, None, None, "user", "lone")]
    d = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string")
    found = chat_format.format_paths(d.select("tree", "id", "role", "text"), chat_format.paths(d.select("tree", "id", "parent", "score"), 2)).orderBy("tree", "branch").collect()
    assert [(r["tree"], r["branch"], r["text"], r["turns"]) for r in found] == [
        (None, 1, "[INST]lone[/INST]", 1),
        (1, 1, "[INST]q[/INST]<s>good</s>[INST]thanks[/INST]", 3),
        (1, 2, "[INST]q[/INST]<s>bad</s>", 2),
    ]
    assert [r["text"][x["begin"] : x["end"]] for r in found for x in r["loss"]] == ["good", "bad"]


def test_a_long_chain_is_cut_into_pieces(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), ((F.col("id") * 7919) % 3000).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), (F.col("id") * 7919) % 3000).alias("text"))
    links = chat_format.chain_links(rows.repartition(8), "conv_id", "turn", Scratch(spark, "t"))
    assert {(r["id"], r["parent"]) for r in links.collect()} == {(i, i - 1 if i else None) for i in range(3000)}
    found = chat_format.digests(chat_format.format_chains(rows, part_chars=500)).collect()
    said = {r["turn"]: f"{r['role']}\n{r['text']}\n" for r in rows.collect()}
    assert [(r["n_turns"], r["turns_sha256"]) for r in found] == [(3000, hashlib.sha256("".join(said[i] for i in range(3000)).encode()).hexdigest())]
