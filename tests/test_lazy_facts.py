"""A query makes the facts that it reads and no others; closures by a walk agree with labels."""

from pyspark.sql import functions as F

from factloom.operators import reach
from factloom.plans import catalog, facts

SF = "/root/testdata/sf0.001"


def test_a_query_makes_only_what_it_reads(spark, monkeypatch):
    monkeypatch.setattr(facts, "_SESSIONS", {})
    catalog.queries()["coordinates"](spark, SF).collect()
    catalog.queries()["shard_reuse"](spark, SF).collect()
    s = facts.load(spark, SF)
    assert set(s.tables) == {"supplier", "shards"} and "made" not in s.index.__dict__
    assert catalog.queries()["find_implementations"](spark, SF).count() and "type_labels" not in s.__dict__


def test_a_walk_gives_what_labels_give(spark):
    rows = [("b", "a"), ("c", "b"), ("a", "c"), ("d", "b"), ("d", "a"), ("e", "d"), ("x", "x"), ("n", None)]
    edges = spark.createDataFrame(rows, "child string, parent string")
    labels = reach.label(edges)
    for seed in ("a", "d", "x", "nowhere"):
        assert sorted(r.fqn for r in reach.walk(edges, seed).collect()) == sorted(r.fqn for r in labels.below(seed).collect())
    assert reach.walk(edges, "a", levels=2) is None


def test_first_visit_makes_names_alone(spark, monkeypatch):
    monkeypatch.setattr(facts, "_SESSIONS", {})
    assert catalog.queries()["first_visit"](spark, SF).count()
    assert set(facts.load(spark, SF).tables) == {"part", "part_names"}


def test_names_that_many_rows_share_are_cut_into_ranges(spark, monkeypatch):
    """annotation_fqn has five frequent values, class_fqn of conditions is null where they are a bean's: no task holds all rows of one."""
    monkeypatch.setattr(facts, "_SESSIONS", {})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = facts.load(spark, SF)
        for name in ("annotations", "conditions"):
            sizes = [r["count"] for r in s[name].groupBy(F.input_file_name()).count().collect()]
            assert max(sizes) < 3 * sum(sizes) / 40, name
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_facts_made_distinct_first_are_those_of_their_sql(spark):
    base = {
        "part_names": spark.createDataFrame([(k, f"a.P{k}") for k in range(8)] + [(3, "a.P3"), (3, "b.Q"), (None, "a.N"), (9, None)], "p_partkey long, fqn string"),
        "events": spark.createDataFrame([(k % 6, t, p) for k in range(20) for t, p in (("view", "1"), ("view", "1"), (None, "2"), ("click", None))] + [(None, "view", "1"), (9, "view", "1")], "user_id long, event_type string, props string"),
        "classes": spark.createDataFrame([(s, f"a.P{k}", kind) for s in ("s1", "s2", None) for k in range(1, 8) for kind in ("class", "annotation", "annotation")] + [("s1", "b.Q", "annotation"), ("s1", None, "annotation")], "shard_id string, fqn string, kind string"),
    }
    for name, sql in facts.DISTINCT_FIRST.items():
        made, want = (spark.sql(text, **base) for text in (sql, facts.FACTS[name]))
        assert made.dtypes == want.dtypes and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
