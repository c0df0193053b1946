"""Reachability labels against a walk, on random graphs with cycles, loops and parts apart."""

import random

import pytest

from factloom.operators import reach


def walk(edges, seed):
    seen, todo = {seed}, [seed]
    while todo:
        at = todo.pop()
        for c, p in edges:
            if p == at and c not in seen:
                seen.add(c)
                todo.append(c)
    return seen


@pytest.mark.parametrize("kind", ["cycles", "ranks"])
def test_below_by_a_walk(spark, monkeypatch, kind):
    rng = random.Random(kind)
    if kind == "cycles":
        edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(48)] + [("n1", None), ("n2", "n2")]
    else:  # a hierarchy: parents have smaller numbers
        edges = [(f"n{k}", f"n{rng.randrange(k)}") for k in range(1, 70) for _ in range(rng.choice([1, 1, 2, 3]))]
    labels = reach.label(spark.createDataFrame(edges, "child string, parent string"))
    nodes = labels.nodes.collect()
    assert sorted(r["pre"] for r in nodes) == list(range(len(nodes)))
    # every node at once, by the labels alone
    inherited = {}
    for pre, lo, hi in labels.inherited.collect():
        inherited.setdefault(pre, []).append((lo, hi))
    for r in nodes:
        held = [(r["pre"], r["post"]), *inherited.get(r["pre"], [])]
        assert {x["node"] for x in nodes if any(lo <= x["pre"] <= hi for lo, hi in held)} == walk(edges, r["node"]), r
    for literals, span in ((200, 1 << 16), (-1, 1 << 16), (-1, 8)):  # as a filter, as a sweep, as a sweep over several spans
        monkeypatch.setattr(reach, "LITERALS", literals)
        monkeypatch.setattr(reach, "SPAN", span)
        for seed in ("n0", "n7", "elsewhere"):
            got = [r.fqn for r in labels.below(seed).collect()]
            assert len(got) == len(set(got)) and set(got) == walk(edges, seed)


def test_a_long_chain_and_no_edges(spark):
    chain = spark.range(300).selectExpr("concat('n', id + 1) child", "concat('n', id) parent")
    labels = reach.label(chain)
    assert labels.inherited.isEmpty() and labels.below("n100").count() == 201
    assert [r.fqn for r in reach.label(chain.limit(0)).below("x").collect()] == ["x"]
