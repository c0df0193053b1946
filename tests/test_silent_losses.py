"""Deep graphs, cycles, changed files and ambiguous names: what must not be lost without a word."""

import pytest

from factloom.operators import envelope, graph, provenance, store
from factloom.schema import RELATIONS
from factloom.session import Session


def made(spark, **tables):
    out = {n: spark.createDataFrame([], RELATIONS[n]) for n in RELATIONS}
    return Session(out | tables)


def test_walks_have_no_depth_limit(spark):
    nodes = spark.createDataFrame([("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 70)], "coordinate string, parent string").coalesce(1)
    rows = graph.tree_paths(nodes).collect()
    assert len(rows) == 70 and max(r.depth for r in rows) == 69 and sum(r.direct for r in rows) == 1
    edges = nodes.where("parent is not null").selectExpr("parent", "coordinate child", "0 position")
    assert graph.first_visit(edges, "n0").count() == 70


def test_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("b", "c")], "coordinate string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        graph.tree_paths(nodes)


def test_a_file_of_equal_size_and_another_time_is_hashed(spark):
    files = spark.createDataFrame([("p", 3, 20, bytearray(b"new")), ("q", 3, 10, bytearray(b"old")), ("r", 3, None, bytearray(b"x"))], "path string, size int, mtime int, content binary")
    cache = spark.createDataFrame([("p", 3, 10, "d"), ("q", 3, 10, "d"), ("r", 3, None, "d")], "path string, size int, mtime int, digest string")
    assert {r.path: (r.digest == "d", r.hashed) for r in store.digest_plan(files, cache).collect()} == {"p": (False, True), "q": (True, False), "r": (False, True)}


def test_the_name_is_chosen_before_the_owner(spark):
    classes = spark.createDataFrame([("s1", "a.B.C", "class", None, 1, False, None), ("s2", "a.B$C", "class", None, 1, False, None), ("s3", "a.B$C", "class", None, 1, False, None)], RELATIONS["classes"])
    shards = spark.createDataFrame([("s1", None, "s1.jar", "", 1, ""), ("s2", "g:a:1", "s2.jar", "", 1, ""), ("s3", "g:b:1", "s3.jar", "", 1, "")], "shard_id string, coordinate string, filename string, sha256 string, size_bytes long, source string")
    artifacts = spark.createDataFrame([("g:b:1",)], "coordinate string")
    s = made(spark, classes=classes, shards=shards, artifacts=artifacts)
    pick = lambda name: [tuple(r) for r in provenance.source_owner(s, name).collect()]
    assert pick("a.B.C") == [("a.B.C", "s1", "s1.jar", 1)]
    s.tables["classes"] = classes.where("shard_id <> 's1'")
    s = Session(s.tables)
    assert pick("a.B.C") == [("a.B$C", "s3", "g:b:1", 2)]
    assert [tuple(r) for r in provenance.source_owner(s, "a.B.C", pinned="g:a:1").collect()] == [("a.B$C", "s2", "g:a:1", 2)]


def test_coverage_says_what_it_does_not_name(spark):
    wanted = spark.createDataFrame([(f"{k}.jar",) for k in range(5)] + [("0.jar",)], "filename string")
    s = made(spark, shards=spark.createDataFrame([("3.jar",)], "filename string"))
    assert envelope.coverage(wanted, s, named=2) == {"jars_total": 5, "jars_indexed": 1, "jars_missing": ["0.jar", "1.jar"], "jars_missing_unnamed": 2}


def test_a_page_and_its_total_take_one_job(spark):
    df = spark.range(57).selectExpr("id", "if(id % 2 = 0, null, id) odd")
    out = envelope.respond({"q": 1}, df, ["id"], page=3, size=20, covered={"jars_total": 1})
    assert (out["total"], out["has_more"], len(out["results"]), out["results"][0], out["coverage"]) == (57, False, 17, {"id": 40}, {"jars_total": 1})
    assert envelope.respond({}, df.limit(0), ["id"])["total"] == 0
    assert envelope.answered({"q": 2}, lambda: df, ["id"], page=0) == {"query": {"q": 2}, "error": "bad_request", "message": "page starts at 1 and page_size is 1 to 1000"}
    assert envelope.answered({}, lambda: df, ["no such"])["error"] == "internal"


def test_sizes_and_ages():
    from factloom.functions.text import parse_age, parse_size

    assert [parse_size(t) for t in ("123", " 5k", "500M ", "2 G")] == [123, 5 << 10, 500 << 20, 2 << 30]
    assert [parse_age(t) for t in ("30d", " 12H ")] == [720, 12]
    for parse, bad in ((parse_size, ("", "x", "-1", "1T", "1.5G", "²")), (parse_age, ("", "30", "d", "-1d", "1w"))):
        for text in bad:
            with pytest.raises(ValueError):
                parse(text)


def test_a_pin_must_name_one_archive(spark):
    classes = spark.createDataFrame([(s, "a.B", "class", None, 1, False, None) for s in ("s1", "s2", "s3")] + [("s1", "z.B", "class", None, 1, False, None)], RELATIONS["classes"])
    shards = spark.createDataFrame([("s1", "g:a:1", "a.jar"), ("s2", "g:a:2", "a2.jar"), ("s3", None, "c.jar")], "shard_id string, coordinate string, filename string")
    s = made(spark, classes=classes, shards=shards, artifacts=spark.createDataFrame([("g:a:1",), ("g:a:2",)], "coordinate string"))
    pick = lambda name, pin=None: [(r["fqn"], r["shard_id"], r["how"], bool(r["note"])) for r in provenance.source_choice(s, name, pin).collect()]
    assert pick("a.B") == [("a.B", "s1", "first", True)]  # the build resolves two of them
    assert pick("B") == [("a.B", "s1", "first", True)] and pick("z.B") == [("z.B", "s1", "", False)] and pick("Q") == []
    assert pick("B", "c.jar") == [("a.B", "s3", "pinned", True)] and pick("B", "g:a:2") == [("a.B", "s2", "pinned", True)]
    for pin in ("a", "g:a", "nothing"):
        with pytest.raises(ValueError, match="archives that hold the class"):
            pick("B", pin)
