import shutil
import subprocess
import zipfile

import pytest

from factloom.operators import detail, graph
from factloom.sources import archives, java_slice
from factloom.sources.classfile import BadClass, modified_utf8, parse_class

API = """package demo.api; import java.lang.annotation.*;
public interface Contract { String value(); }
@Retention(RetentionPolicy.RUNTIME) @interface MetaMarker { String note() default ""; int[] levels() default {}; Class<?> type() default Object.class; }
@MetaMarker(note = "n", levels = {1, 2}, type = String.class) @Retention(RetentionPolicy.CLASS) @interface Marker {}
"""
IMPL = """package demo.impl; import demo.api.Contract;
public class Direct implements Contract {
  public static final String HEADER = "X-Demo";
  enum Level { LOW, HIGH }
  record Pair(int a, String b) {}
  public String value() { return "literal \\u0000 \\uD83D\\uDE00"; }
  int pick(int k) { switch (k) { case 1: return 1; case 2: return 2; case 3: return 3; default: } switch (k) { case 10: return "ten".length(); case 9000: return 4; default: return "none".length(); } }
  void wide(long x) { int i = 0; while (i < 40000) i += 1000; }
}
"""
DEEP = "package demo.deep; public class Indirect extends demo.impl.Direct {}\n"
CONFIG = """package demo.cfg; import org.springframework.context.annotation.Bean; import org.springframework.boot.autoconfigure.condition.ConditionalOnClass;
@ConditionalOnClass("a.B") public class Conf { @Bean("named") @ConditionalOnClass("c.D") public String maker() { return null; } @Bean public int other() { return 1; } }
"""
STUBS = {
    "org/springframework/context/annotation/Bean.java": "package org.springframework.context.annotation; public @interface Bean { String[] value() default {}; }",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnClass.java": "package org.springframework.boot.autoconfigure.condition; public @interface ConditionalOnClass { String[] value() default {}; }",
}


@pytest.fixture(scope="module")
def jars(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    top = tmp_path_factory.mktemp("jars")
    src, out, jar = top / "src", top / "out", top / "jar"
    files = {"demo/api/Contract.java": API, "demo/impl/Direct.java": IMPL, "demo/deep/Indirect.java": DEEP, "demo/cfg/Conf.java": CONFIG, **STUBS}
    for name, text in files.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    subprocess.run(["javac", "-d", out, *[src / n for n in files]], check=True)
    jar.mkdir()

    def pack(name, folder, **extra):
        with zipfile.ZipFile(jar / name, "w") as z:
            for p in sorted((out / folder).rglob("*.class")):
                z.write(p, str(p.relative_to(out)))
            for k, v in extra.items():
                z.writestr(k.replace("__", "/"), v)

    pack("api.jar", "demo/api", **{"META-INF/maven/g/a/pom.properties": "groupId=com.example\nartifactId=api\nversion=1.0\n"})
    pack("impl.jar", "demo/impl", **{"META-INF/versions/11/X.class": b"junk", "bad/Broken.class": b"\xca\xfe\xba\xbe\0\0"})
    shutil.copy(jar / "impl.jar", jar / "zz-copy.jar")
    pack("deep.jar", "demo/deep")
    pack("cfg.jar", "demo/cfg", **{archives.FACTORIES: "demo.Key=a.One,\\\n  b.Two # kept\n# comment\n", archives.IMPORTS: "demo.cfg.Conf # note\n\n# none\n", "META-INF/services/demo.Svc": "impl.S\n", archives.METADATA[0]: '{"properties":[{"name":"a.b.c","type":"T","defaultValue":false},{"name":"top","defaultValue":[1,2]}]}', archives.METADATA[1]: "{bad"})
    (jar / "broken.jar").write_text("not a zip")
    return jar


@pytest.fixture(scope="module")
def facts(spark, jars, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "facts")
    archives.write_store(archives.read_archives(spark, str(jars)), store)
    return spark.read.parquet(store)


def test_archives_are_read_once(facts):
    names = {r.filename for r in facts.select("filename").distinct().collect()}
    assert names == {"api.jar", "impl.jar", "deep.jar", "cfg.jar", "broken.jar"}
    assert [r.filename for r in facts.where("relation = 'failed'").collect()] == ["broken.jar"]
    warned = {(r.filename, "Broken" in r.row) for r in facts.where("relation = 'warnings'").collect()}
    assert warned == {("impl.jar", True), ("cfg.jar", False)}


def test_facts_of_classes(facts):
    s = archives.session_of(facts)
    kinds = {r.fqn: r.kind for r in s["classes"].collect()}
    assert kinds["demo.api.Contract"] == "interface" and kinds["demo.api.Marker"] == "annotation"
    assert kinds["demo.impl.Direct$Level"] == "enum" and kinds["demo.impl.Direct$Pair"] == "record"
    values = {r.value for r in s["strings"].where("class_fqn = 'demo.impl.Direct'").collect()}
    assert {"X-Demo", "literal \0 \U0001f600", "ten", "none"} <= values
    note = s["annotations"].where("class_fqn = 'demo.api.Marker' and annotation_fqn = 'demo.api.MetaMarker'").first()
    assert note.attributes == '{"levels":[1,2],"note":"n","type":"java.lang.String"}'


def test_queries_over_archives(facts):
    s = archives.session_of(facts)
    found = graph.find_implementations(s, "demo.api.Contract").collect()
    assert {(r.fqn, r.source_jar) for r in found} == {("demo.impl.Direct", "impl.jar"), ("demo.deep.Indirect", "deep.jar")}
    beans = {r.bean_name: r.conditions for r in detail.get_bean_definitions(s, "demo.cfg.Conf").collect()}
    assert beans == {"named": 'OnClass={"value":["c.D"]}', "other": ""}
    points = {(r.mechanism, r.key, r.implementations) for r in detail.list_extension_points(s).collect()}
    assert points == {("spring.factories", "demo.Key", 2), ("autoconfig.imports", None, 1), ("services", "demo.Svc", 1)}
    config = {(r.name, r.default_val) for r in detail.find_config_properties(s, "a.b").collect()}
    assert config == {("a.b.c", "false")}


def test_agrees_with_javap(jars, facts):
    text = subprocess.run(["javap", "-p", "-cp", jars / "impl.jar", "demo.impl.Direct"], capture_output=True, text=True, check=True).stdout
    names = {r.name for r in archives.session_of(facts)["methods"].where("class_fqn = 'demo.impl.Direct'").collect()}
    assert {"value", "pick", "wide", "<init>"} == names and all(n in text for n in names - {"<init>"})


def test_malformed_classes():
    for data in (b"", b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbe\0\0\0\0\0\5\1", b"PK"):
        with pytest.raises(BadClass):
            parse_class(data)
    assert modified_utf8(b"a\xc0\x80b\xed\xa0\xbd\xed\xb8\x80") == "a\0b\U0001f600"


def test_properties_format():
    assert archives.properties("a = 1\n# c\n! d\nb:x\\\n   y\nk\\ ey z\nu=\\u0041\nempty\n") == {"a": "1", "b": "xy", "k ey": "z", "u": "A", "empty": ""}


def test_slices():
    source = """package p; class Outer { // {
  int f = g(1);
  /** doc */
  @Deprecated(since = "1") int m(int a) { return "}".length(); }
  // two
  int m(String s) { if (s == null) { return 0; } return 1; }
  Outer() { m(2); }
  class Inner { void m() { } }
  enum E { A { void run() { int x; } }, B; void run() { } }
  record R(int a) { R { assert a > 0; } }
}"""
    assert [x.split("\n")[0] for x in java_slice.slice_methods(source, "p.Outer", "m")] == ["/** doc */", "// two"]
    assert java_slice.slice_methods(source, "p.Outer$Inner", "m") == ["void m() { }"]
    assert len(java_slice.slice_methods(source, "p.Outer$E", "run")) == 2
    assert java_slice.slice_methods(source, "p.Outer", "<init>") == ["Outer() { m(2); }"]
    assert java_slice.slice_methods(source, "p.Outer$R", "<init>") == ["R { assert a > 0; }"]
    assert java_slice.slice_methods(source, "p.Outer", "none") == []


def test_delta_is_a_rebuild(spark, facts):
    from factloom.operators.store import delta

    classes = archives.session_of(facts)["classes"]
    old = classes.where("fqn not like 'demo.deep%'")
    gone = facts.where("filename = 'api.jar'").select("shard_id").distinct()
    made = delta(old, gone, classes.where("fqn like 'demo.deep%'"))
    want = classes.where("fqn not like 'demo.api%'")
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_indexing_reuses_what_it_knows(spark, jars, tmp_path):
    from factloom.operators import indexing

    path = str(tmp_path / "facts")
    first = indexing.index(spark, f"{jars}/api.jar, {jars}/impl.jar,,{jars}/api.jar", path)
    assert (first.total, first.new, first.reused, first.missing) == (2, 2, 0, [])
    every = indexing.index_many(spark, {"all": str(jars), "none": str(tmp_path / "nowhere"), "blank": " , "}, path)
    assert (every["all"].total, every["all"].new, every["all"].reused, every["all"].missing) == (5, 2, 2, ["broken.jar"])
    assert every["none"].error and every["blank"].error and "new" in indexing.report_dict(every["all"])
    again = indexing.index(spark, str(jars), path)
    assert (again.total, again.new, again.reused, again.missing) == (5, 0, 4, ["broken.jar"])
    facts = spark.read.parquet(path)
    assert facts.count() == facts.distinct().count() + (facts.where("relation = 'strings'").count() - facts.where("relation = 'strings'").distinct().count())
    shards = facts.where("relation = 'shards'").select("shard_id")
    name = indexing.build_session(spark, facts, shards.limit(2), str(tmp_path / "sessions"))
    assert name == indexing.build_session(spark, facts, shards.limit(2), str(tmp_path / "sessions")) and len(name) == 16
    assert spark.read.parquet(str(tmp_path / "sessions" / name)).select("shard_id").distinct().count() == 2
    plan = lambda old, new, n=0: indexing.plan_session(*(spark.createDataFrame([(str(i),) for i in x], "shard_id string") for x in (old, new)), n).first()["action"]
    assert [plan(range(8), range(8)), plan(range(8), range(9)), plan(range(8), range(9), 8), plan(range(8), range(4)), plan([], range(3)), plan([], [])] == ["reuse", "delta", "rebuild", "rebuild", "rebuild", "reuse"]


def test_unchanged_files_are_not_read(spark, jars, tmp_path):
    import os
    import shutil

    from factloom.operators import indexing

    folder, path = tmp_path / "in", str(tmp_path / "facts")
    folder.mkdir()
    for name in ("api.jar", "impl.jar", "broken.jar"):
        shutil.copy2(jars / name, folder / name)
    assert indexing.index(spark, str(folder), path).new == 2
    before = {r["path"]: r["digest"] for r in indexing.kept_listing(spark, path)[0].collect()}
    shard = folder / "impl.jar"
    times, size = os.stat(shard), shard.stat().st_size
    shard.write_bytes(b"x" * size)  # of the same size and time: nobody may look into it
    os.utime(shard, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert {r["state"] for r in indexing.changes(spark, str(folder), path).collect()} == {"known"}
    again = indexing.index(spark, str(folder), path)
    assert (again.total, again.new, again.reused, again.missing) == (3, 0, 2, ["broken.jar"])
    assert {r["path"]: r["digest"] for r in indexing.kept_listing(spark, path)[0].collect()} == before
    os.utime(shard, ns=(times.st_atime_ns, times.st_mtime_ns + 10**9))
    shutil.copy2(jars / "deep.jar", folder / "more.jar")
    assert sorted(r["state"] for r in indexing.changes(spark, str(folder), path).collect()) == ["changed", "known", "known", "new"]
    last = indexing.index(spark, str(folder), path)
    assert (last.total, last.new, last.reused, last.missing) == (4, 1, 1, ["broken.jar", "impl.jar"])


def test_sources_are_read_and_cut(spark, jars, facts, tmp_path):
    from factloom.operators import provenance

    with zipfile.ZipFile(tmp_path / "impl-sources.jar", "w") as z:
        z.writestr("demo/impl/Direct.java", IMPL)
        z.writestr("demo/impl/Nul.java", "a\0b")
        z.writestr("demo/impl/Latin.kt", b"\xe9")
        z.writestr("readme.txt", "x")
    read = archives.read_sources(spark, str(tmp_path))
    assert {(r.entry, r.note) for r in read.collect()} == {("demo/impl/Direct.java", None), ("demo/impl/Nul.java", "binary"), ("demo/impl/Latin.kt", "not UTF-8")}
    s = archives.session_of(facts)
    s.tables["artifacts"] = spark.createDataFrame([], "coordinate string")
    shard = s["shards"].where("filename = 'impl.jar'").first()["shard_id"]
    from pyspark.sql import functions as F

    sources = read.withColumn("shard_id", F.lit(shard))
    assert provenance.get_source(s, sources, "demo.impl.Direct").first()["text"] == IMPL
    assert [r.text for r in provenance.get_source(s, sources, "demo.impl.Direct", "value").collect()] == java_slice.slice_methods(IMPL, "demo.impl.Direct", "value")
    assert provenance.get_source(s, sources, "demo.impl.Direct$Level").first()["text"] == IMPL
    assert provenance.get_source(s, sources, "demo.deep.Indirect").first()["text"] is None and provenance.get_source(s, sources, "demo.deep.Indirect", "x").count() == 0
    assert provenance.get_source(s, sources, "no.Such").count() == 0


def test_stream_adds_a_shard_once(spark, facts, tmp_path):
    from factloom.streaming.ingest import arrivals, watch_facts

    some = facts.select("shard_id", "filename", "size_bytes", "relation", "row")
    for _ in range(2):
        some.write.mode("append").parquet(str(tmp_path / "in"))
        watch_facts(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == some.count()
    parts = ("shards", "classes")  # a shard in two batches, then once more as a whole, twice in one batch
    one = spark.createDataFrame([("z", "z.jar", 1, "strings", '{"value":"v"}')] * 2 + [("z", "z.jar", 1, "shards", '{"facts":4}'), ("z", "z.jar", 1, "classes", "{}")], some.schema)
    for piece in (one.where("relation in ('strings')"), one.where(f"relation in {parts}"), one.union(one)):
        piece.write.mode("append").parquet(str(tmp_path / "in"))
        watch_facts(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.relation for r in spark.read.parquet(str(tmp_path / "store")).where("shard_id = 'z'").collect()) == ["classes", "shards", "strings", "strings"]
    one.union(one).write.parquet(str(tmp_path / "in2"))
    watch_facts(spark, str(tmp_path / "in2"), str(tmp_path / "store2"), str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store2")).count() == 4
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type")
    assert sorted((r.event_type, r.events) for r in arrivals(events).collect()) == [("a", 2), ("b", 1)]
