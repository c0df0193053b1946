"""Nested class details, what open-symbol falls back on, and what an argument means to the classpath."""

import pytest

from factloom.operators import detail, provenance, search
from factloom.schema import RELATIONS
from factloom.session import Session


@pytest.fixture(scope="module")
def session(spark):
    rows = {
        "shards": [("s1", "g:lib:1", "lib-1.jar", None, 1, None, None), ("s2", None, "plain.jar", None, 1, None, None)],
        "classes": [("s1", "a.Conf", "class", "a.Base", 1, False, None), ("s2", "a.Conf", "class", None, 1, True, None), ("s2", "a.Other", "class", None, 1, False, None)],
        "class_interfaces": [("s1", "a.Conf", "z.I"), ("s1", "a.Conf", "b.I")],
        "methods": [("s1", "a.Conf", "make", "()V", None, 1), ("s1", "a.Conf", "load", "()V", "x.R", 1), ("s2", "a.Other", "Conf", "()V", None, 1)],
        "annotations": [("s1", "class", "a.Conf", None, None, "m.B", "{broken"), ("s1", "class", "a.Conf", None, None, "m.A", '{"k":1}'), ("s1", "method", "a.Conf", "make", "()V", "m.C", None)],
        "beans": [("s1", 7, "a.Conf", "x.T", "t", "make", "()V"), ("s1", 8, "a.Conf", "x.U", None, None, None)],
        "conditions": [("s1", "bean_method", None, 7, "OnX", '"v"'), ("s1", "class", "a.Conf", None, "OnY", "no json"), ("s2", "bean_method", None, 7, "OnZ", None)],
        "artifacts": [("g:lib:1", "g", "lib", "1", "root", 1, "root > g:lib:1"), ("h:lib:2", "h", "lib", "2", "root", 1, "root > h:lib:2")],
    }
    return Session({n: spark.createDataFrame(rows.get(n, []), RELATIONS[n]) for n in RELATIONS})


def test_a_class_has_its_parts_nested_and_in_order(session):
    one, two = (r.asDict(recursive=True) for r in detail.get_class(session, "a.Conf").orderBy("shard_id").collect())
    assert one["interfaces"] == ["b.I", "z.I"] and one["source_jar"] == "g:lib:1"
    assert one["annotations"] == [{"fqn": "m.A", "attributes": '{"k":1}'}, {"fqn": "m.B", "attributes": None}]
    assert [(m["name"], [a["fqn"] for a in m["annotations"]]) for m in one["methods"]] == [("load", []), ("make", ["m.C"])]
    assert [(b["bean_id"], b["method"], b["conditions"]) for b in one["beans"]] == [(8, None, []), (7, "make()V", [{"type": "OnX", "ref_value": '"v"'}])]
    assert one["conditions"] == [{"type": "OnY", "ref_value": None}]
    assert two["is_abstract"] and not any(two[k] for k in ("interfaces", "annotations", "methods", "beans", "conditions"))
    assert detail.get_class(session, "a.None").isEmpty()


def test_a_symbol_is_a_method_then_a_class_then_a_search(session):
    assert [r.symbol for r in search.open_symbol(session, "a.Conf#make").collect()] == ["a.Conf#make"]
    assert search.open_symbol(session, "a.Conf").count() == 2
    assert [(r.symbol, r.match_reason) for r in search.open_symbol(session, "Conf").orderBy("score", ascending=False).limit(1).collect()] == [("a.Other#Conf", "method_name")]


def test_an_argument_means_classes_coordinates_or_files(session):
    means = lambda a: sorted((r.coordinate, r.source_class) for r in provenance.dependency_targets(session, a).collect())
    assert means("a.Conf") == [("g:lib:1", "a.Conf")]  # the other holder has no coordinate
    assert means("g:lib") == means("lib") == means("lib-1.jar") == [("g:lib:1", "")]
    assert means("no:where:1") == [("no:where:1", "")] and means("nothing") == means("plain.jar") == []
    why = sorted((r.coordinate, r.matched_by) for r in provenance.why_dependency_of(session, "a.Conf").collect())
    assert why == [("g:lib:1", "coordinate"), ("h:lib:2", "artifact")]


def test_a_lookup_can_be_forced(session):
    kinds = lambda *a: sorted((r.kind, r.owner, r.shard_id, r.reason) for r in provenance.precise(session, *a).collect())
    assert kinds("lib") == [("class", "lib", "s1", "artifact")]
    assert kinds("lib", "class") == []
    assert kinds("lib", "artifact") == [("artifact", "lib", "s1", "artifact")]
    assert kinds("plain.jar", "class") == [] and kinds("a.Other", "artifact") == []
    assert {r.coordinate for r in provenance.provenance(session, "lib").collect()} == {"g:lib:1", "h:lib:2"}
    assert provenance.provenance(session, "lib", "class").isEmpty()


def test_a_source_comes_from_a_shard_with_a_coordinate(spark):
    """As the catalogue's SQL orders owners, where the build resolves several of them."""
    rows = {
        "shards": [("s1", None, "plain.jar", None, 1, None, None), ("s2", "g:b:1", "b.jar", None, 1, None, None), ("s3", "g:c:1", "c.jar", None, 1, None, None)],
        "classes": [(s, "a.X", "class", None, 1, False, None) for s in ("s1", "s2", "s3")],
        "artifacts": [(f"g:{n}:1", "g", n, "1", "root", 1, f"root > g:{n}:1") for n in "bc"],
    }
    s = Session({n: spark.createDataFrame(rows.get(n, []), RELATIONS[n]) for n in RELATIONS})
    assert [tuple(r) for r in provenance.source_owner(s, "a.X").collect()] == [("a.X", "s2", "g:b:1", 3)]
    assert [(r.shard_id, r.how) for r in provenance.source_choice(s, "a.X").collect()] == [("s1", "first")]
