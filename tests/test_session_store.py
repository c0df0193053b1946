"""Sessions in versions: any sequence of updates gives what a rebuild gives, failures leave the version before; the kept index finds what a scan finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import indexing, search, session_store, symbol_index
from factloom.schema import RELATIONS
from factloom.session import Session

SHARDS = [f"s{k}" for k in range(12)]


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(8)
    made = {n: spark.createDataFrame([], RELATIONS[n]) for n in RELATIONS if n not in ("artifacts", "lines")}
    words = ["Harbour", "quay", "Mooring", "TIDE", "kelp%", "ebb_", "漢", "å"]
    classes = sorted({(s, f"p{rng.randrange(4)}.{rng.choice(words)}{rng.randrange(9)}") for s in SHARDS for _ in range(40)})
    made["classes"] = spark.createDataFrame([(s, f, "class", None, 1, False, None) for s, f in classes], RELATIONS["classes"])
    made["strings"] = spark.createDataFrame([(*rng.choice(classes), "run", "()V", " ".join(rng.choices(words, k=rng.randrange(4)))) for _ in range(600)], RELATIONS["strings"])
    made["methods"] = spark.createDataFrame([(*rng.choice(classes), f"get{rng.choice(words)}", "()V", None, 1) for _ in range(300)], RELATIONS["methods"])
    made["shards"] = spark.createDataFrame([(s, None, f"{s}.jar", s, 1, None, "local") for s in SHARDS], RELATIONS["shards"])
    return made


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "shard_id string")


def rows(session, name):
    return sorted(map(str, session[name].collect()))


def plain(facts, spark, names):
    return Session({n: df.join(ids(spark, names), "shard_id", "left_semi") for n, df in facts.items()})


def test_updates_give_what_a_rebuild_gives(spark, facts, tmp_path):
    kept = session_store.SessionStore(spark, str(tmp_path / "s"))
    assert kept.head() is None
    now, chain, actions = set(SHARDS[:8]), 0, []
    for step in range(3):
        v = kept.update(facts, ids(spark, sorted(now)))
        s, want = kept.session(), plain(facts, spark, now)
        for name in ("classes", "strings"):
            assert rows(s, name) == rows(want, name), (step, name)
        assert rows({"x": search.search_symbol(s, "quay")}, "x") == rows({"x": search.search_symbol(want, "quay")}, "x")
        assert rows({"x": search.find_string(s, "kelp%")}, "x") == rows({"x": search.find_string(want, "kelp%")}, "x")
        actions.append(v.action)
        chain = chain + 1 if v.action == "delta" else 0
        assert v.chain == chain and v.number == step + 1
        # one more shard, one less
        now = now | {SHARDS[8]} if step == 0 else now - {SHARDS[2]}
    assert actions[:3] == ["rebuild", "delta", "delta"]
    assert kept.update(facts, ids(spark, [r.shard_id for r in kept.manifest().collect()])).number == 3  # reuse writes nothing
    old = set(kept.head().live)
    assert kept.update(facts, ids(spark, SHARDS[:3])).action == "rebuild"
    assert old <= set(kept.vacuum()) and rows(kept.session(), "classes") == rows(plain(facts, spark, SHARDS[:3]), "classes")


def test_long_chains_and_large_changes_are_rebuilt(spark, facts, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "DELTA_CHAIN", 2)
    kept = session_store.SessionStore(spark, str(tmp_path / "s"), indexed=False)
    sizes = [8, 9, 10, 11, 3]
    found = [kept.update(facts, ids(spark, SHARDS[:n])) for n in sizes]
    assert [(v.action, v.chain) for v in found] == [("rebuild", 0), ("delta", 1), ("delta", 2), ("rebuild", 0), ("rebuild", 0)]
    assert sum(found[2].live.values()) == 10 and len(found[2].live) == 3 and len(found[3].live) == 1


def test_a_failed_delta_is_a_rebuild_and_a_failed_rebuild_leaves_the_version(spark, facts, tmp_path, monkeypatch):
    kept = session_store.SessionStore(spark, str(tmp_path / "s"), indexed=False)
    first = kept.update(facts, ids(spark, SHARDS[:8]))
    write, calls = kept._write_segment, []

    def failing(tables, added, segment, times):
        calls.append(segment)
        if len(calls) <= times:
            write({"classes": tables["classes"]}, added, segment)  # dies half way
            raise OSError("the disk is full")
        write(tables, added, segment)

    monkeypatch.setattr(kept, "_write_segment", lambda *a: failing(*a, 9))
    with pytest.warns(UserWarning, match="the disk is full"), pytest.raises(OSError):
        kept.update(facts, ids(spark, SHARDS[:9]))
    assert kept.head() == first and rows(kept.session(), "classes") == rows(plain(facts, spark, SHARDS[:8]), "classes")
    calls.clear()
    monkeypatch.setattr(kept, "_write_segment", lambda *a: failing(*a, 1))
    with pytest.warns(UserWarning):
        assert kept.update(facts, ids(spark, SHARDS[:9])).action == "rebuild"
    assert rows(kept.session(), "classes") == rows(plain(facts, spark, SHARDS[:9]), "classes")


def test_of_two_writers_the_second_fails(spark, facts, tmp_path):
    a, b = (session_store.SessionStore(spark, str(tmp_path / "s"), indexed=False) for _ in range(2))
    first = a.update(facts, ids(spark, SHARDS[:8]))
    a.update(facts, ids(spark, SHARDS[:9]))
    b.head = lambda: first  # read before a's second update
    with pytest.raises(session_store.Conflict):
        b.update(facts, ids(spark, SHARDS[:7]))
    assert a.head().number == 2


def test_shards_without_facts_are_left_out(spark, facts, tmp_path):
    kept = session_store.SessionStore(spark, str(tmp_path / "s"), indexed=False)
    assert sum(kept.update(facts, ids(spark, [*SHARDS[:3], "no such shard"])).live.values()) == 3


def test_added_shards_are_sent_to_the_tasks_up_to_a_number(spark, facts, tmp_path, monkeypatch):
    sent = []
    for most, path in ((8, "a"), (7, "b")):
        monkeypatch.setattr(session_store, "MAX_SENT", most)
        kept = session_store.SessionStore(spark, str(tmp_path / path), indexed=False)

        def watched(tables, added, segment, write=kept._write_segment):
            sent.append("strategy=broadcast" in added._jdf.queryExecution().analyzed().toString())
            write(tables, added, segment)

        monkeypatch.setattr(kept, "_write_segment", watched)
        kept.update(facts, ids(spark, SHARDS[:8]))
        assert rows(kept.session(), "classes") == rows(plain(facts, spark, SHARDS[:8]), "classes")
    assert sent == [True, False]


def test_the_index_finds_what_a_scan_finds(spark, facts, tmp_path, monkeypatch):
    monkeypatch.setattr(symbol_index, "BLOCK_ROWS", 7)
    monkeypatch.setattr(symbol_index, "RANGE_ROWS", 200)
    scanned = Session(facts)
    tables = symbol_index.write(scanned.symbols, lambda n: str(tmp_path / n))
    few, indexed = (Session(facts, symbol_index.SymbolIndex(*tables, max_blocks=most)) for most in (1, 10_000))
    for term in ("Quay", "quay3", "kelp%", "p2.漢", "qu", "å", "x\0y", "()V", "none of them"):
        for ask in (search.search_symbol, search.find_string):
            assert rows({"x": ask(indexed, term)}, "x") == rows({"x": ask(scanned, term)}, "x"), term
    assert rows({"x": search.search_symbol(few, "quay")}, "x") == rows({"x": search.search_symbol(scanned, "quay")}, "x")
    narrow = indexed.index
    assert narrow.blocks("none of them") == [] and narrow.blocks("qu") is None and few.index.blocks("quay") is None
    ranges = {r["range"] for r in narrow.blocks("p3.kelp%")}
    assert 0 < len(ranges) < tables[0].select("range").distinct().count()  # the files of other ranges aren't read
    assert "PartitionFilters: [range" in narrow.candidates("p3.kelp%")[0]._jdf.queryExecution().toString()


def test_what_comes_back_in_a_block_is_cut_into_grams_once(spark):
    """Texts are folded after they are dealt to ranges, and the fields of a block are made distinct before grams are taken; the grams are those of whole texts."""
    symbols = spark.createDataFrame([("class", n, o, d, f"s{k}") for k in range(9) for n, o, d in (("Ab\n.Cde", None, "x|y*"), ("\U0001f600ab\U0001f600", "", "漢字éZ"), ("q", "ab", "(I)Lx;"))], "kind string, name string, owner string, detail string, shard_id string")
    rows_ = symbol_index.symbol_rows(symbols)
    plan = rows_._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in plan and "translate" not in plan[plan.index("RepartitionByExpression") :]
    kept = rows_.collect()
    table = spark.createDataFrame(kept, rows_.schema)
    whole = F.explode(F.regexp_extract_all("folded", F.lit(r"(?s)(?=([^\x00]{3}))"), F.lit(1))).alias("gram")
    want = {tuple(r) for r in table.select("range", "block", whole).collect()}
    posted = symbol_index.postings(table)
    found = [(r["range"], r["block"], r["gram"]) for r in posted.collect()]
    assert len(found) == len(want) and set(found) == want and any("\U0001f600" in g for _, _, g in found)
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"regexp_extract_all[\s\S]*Aggregate \[range#\d+, block#\d+L?, field", plan)
