"""The registered queries: operators applied to the facts of a data directory, each with the same answer in plain SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import detail, graph, indexing, provenance, search, session_store, store, usages
from ..operators.search import paged
from ..schema import RELATIONS
from ..shared import scratch_path
from ..sources import tgf
from .facts import load, sql_facts

TERM = "widget"
CLASS_TERM, METHOD_TERM, PACKAGE = "P19", "getR", "com.promo"
_JAR = "coalesce(nullif(m.coordinate, ''), m.filename, x.shard_id) AS source_jar"


def _with(sql: str) -> str:
    return f"WITH RECURSIVE {sql_facts()}{sql if sql.startswith(',') else ' ' + sql}"


def _jar(sql: str) -> str:
    """The rows of ``sql`` with source_jar."""
    return _with(f"SELECT x.*, {_JAR} FROM ({sql}) x LEFT JOIN shards m ON m.shard_id = x.shard_id")


def _fold(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _has(c: str, t: str) -> str:
    return f"coalesce(contains({_fold(c)}, '{t.lower()}'), false)"


def _pre(c: str, t: str) -> str:
    return f"coalesce(starts_with({c}, '{t}'), false)"


SIMPLE = "string_split(fqn, '.')[-1]"
PACKAGE_OF = "array_to_string(string_split(fqn, '.')[:-2], '.')"
SYMBOLS = """SELECT 'class' AS kind, fqn AS name, NULL AS owner, kind AS detail, shard_id FROM classes
UNION ALL SELECT 'method', concat(c.fqn, '#', m.name), c.fqn, m.descriptor, m.shard_id FROM methods m JOIN classes c ON c.shard_id = m.shard_id AND c.fqn = m.class_fqn
UNION ALL SELECT 'annotation', annotation_fqn, class_fqn, attributes, shard_id FROM annotations
UNION ALL SELECT 'spi', impl_fqn, key, mechanism, shard_id FROM spi
UNION ALL SELECT 'config-property', name, source_fqn, type_fqn, shard_id FROM config
UNION ALL SELECT 'string', value, class_fqn, method_name || method_descriptor, shard_id FROM strings"""


def _search_symbol_sql(t: str, page: int = 1) -> str:
    m, s = "string_split(name, '#')[-1]", "string_split(name, '.')[-1]"
    every = f"({_has('name', t)} OR {_has('owner', t)} OR {_has('detail', t)})"
    arms = [
        (100, "exact_fqn", "class", f"name = '{t}'"), (98, "exact_method", "method", f"name = '{t}'"), (92, "method_name", "method", f"{m} = '{t}'"),
        (90, "simple_name", "class", f"{s} = '{t}'"), (88, "annotation_fqn", "annotation", f"name = '{t}'"), (86, "spi_impl", "spi", f"name = '{t}'"),
        (86, "spi_key", "spi", f"owner = '{t}'"), (84, "config_property", "config-property", f"name = '{t}'"), (82, "simple_prefix", "class", _pre(s, t)),
        (80, "prefix", "class", _pre("name", t)), (78, "annotation_prefix", "annotation", _pre("name", t)), (76, "spi_prefix", "spi", _pre("name", t)),
        (75, "method_prefix", "method", _pre(m, t)), (70, "config_prefix", "config-property", _pre("name", t)), (65, "string_constant", "string", f"name = '{t}'"),
        (60, "string_prefix", "string", _pre("name", t)), (55, "class_contains", "class", every), (50, "method_contains", "method", every),
        (45, "annotation_contains", "annotation", every), (44, "spi_contains", "spi", every), (43, "config-property_contains", "config-property", every), (30, "string_contains", "string", every),
    ]
    case = " ".join(f"WHEN kind = '{k}' AND {c} THEN {{}}" for _, _, k, c in arms)
    score = case.format(*[str(a[0]) for a in arms])
    reason = case.format(*[f"'{a[1]}'" for a in arms])
    return _jar(
        f"SELECT * FROM (SELECT kind, name, owner, detail, shard_id, CASE {score} END AS score, CASE {reason} END AS match_reason FROM ({SYMBOLS}))"
        f" WHERE score IS NOT NULL ORDER BY score DESC, kind NULLS FIRST, name NULLS FIRST, shard_id NULLS FIRST, owner NULLS FIRST, detail NULLS FIRST LIMIT 20 OFFSET {(page - 1) * 20}"
    )


_CLASS_ARMS = f"""CASE WHEN fqn = '{{t}}' THEN 100 WHEN {SIMPLE} = '{{t}}' THEN 90 WHEN starts_with({SIMPLE}, '{{t}}') THEN 82 WHEN starts_with(fqn, '{{t}}') THEN 80
 WHEN contains({_fold('fqn')}, lower('{{t}}')) THEN 50 END"""
_REASONS = "CASE score WHEN 100 THEN 'exact_fqn' WHEN 90 THEN 'simple_name' WHEN 82 THEN 'simple_prefix' WHEN 80 THEN 'prefix' ELSE 'contains' END AS match_reason"
FIND_CLASS = _jar(
    f"""SELECT *, {_REASONS} FROM (SELECT fqn, {SIMPLE} AS simple_name, {PACKAGE_OF} AS package_name, kind, shard_id, {_CLASS_ARMS.format(t=CLASS_TERM)} AS score FROM classes)
 WHERE score IS NOT NULL ORDER BY score DESC, fqn, shard_id LIMIT 20 OFFSET 20"""
)
_OWNED = "SELECT m.*, c.fqn AS owner FROM methods m JOIN classes c ON c.shard_id = m.shard_id AND c.fqn = m.class_fqn"


def _find_method_sql(t: str, extra: str = "") -> str:
    return _jar(
        f"""SELECT class_fqn, name, descriptor, return_fqn, shard_id, score, CASE score WHEN 100 THEN 'exact_method' WHEN 95 THEN 'method_name' WHEN 75 THEN 'method_prefix' ELSE 'contains' END AS match_reason
 FROM (SELECT *, CASE WHEN concat(owner, '#', name) = '{t}' {extra} THEN 100 WHEN name = '{t}' THEN 95 WHEN starts_with(name, '{t}') THEN 75
 WHEN {_has('name', t)} OR {_has('owner', t)} THEN 50 END AS score FROM ({_OWNED})) WHERE score IS NOT NULL ORDER BY score DESC, class_fqn, name, descriptor, shard_id LIMIT 20"""
    )


_SEED = "(SELECT fqn FROM part_names WHERE p_partkey = 3)"
_EDGES = "SELECT fqn AS child, super_fqn AS parent FROM classes WHERE super_fqn IS NOT NULL UNION SELECT class_fqn, interface_fqn FROM class_interfaces"
_ANNO_EDGES = "SELECT DISTINCT c.fqn AS child, a.annotation_fqn AS parent FROM annotations a JOIN classes c ON c.shard_id = a.shard_id AND c.fqn = a.class_fqn AND c.kind = 'annotation'"
_ANNO_SEED = "(SELECT fqn FROM part_names WHERE p_partkey = 4)"
_CLASS = "(SELECT fqn FROM part_names WHERE p_partkey = 15)"
_COND = "concat(type, '=', coalesce(ref_value, ''))"
_LINES = "SELECT path, i AS line, t[i] AS text FROM (SELECT path, string_split(text, chr(10)) AS t FROM files), unnest(range(1, len(t) + 1)) u(i)"
_OWNER = f"""SELECT c.fqn, c.shard_id, coalesce(m.coordinate, m.filename) AS source_jar, (SELECT count(DISTINCT shard_id) FROM classes WHERE fqn = {_CLASS}) AS owners
 FROM classes c JOIN shards m ON m.shard_id = c.shard_id WHERE c.fqn = {_CLASS} ORDER BY m.coordinate IS NULL, c.shard_id LIMIT 1"""
_SOURCE = f"SELECT o.*, x.entry, {{}} AS text FROM ({_OWNER}) o LEFT JOIN sources x ON x.shard_id = o.shard_id AND x.entry = concat(replace(o.fqn, '.', '/'), '.java')"
_PRINT = "substr(sha256(string_agg(DISTINCT shard_id, chr(10) ORDER BY shard_id)), 1, 16)"
HIGH, BROAD = ["License", "token ="], ["http", "the "]


_ARTIFACT = "SELECT '{}' AS kind, 'Supplier-000000003' AS owner, shard_id, 'artifact' AS reason FROM shards WHERE split_part(coordinate, ':', 2) = 'Supplier-000000003'"


def _precise_sql(kind: str) -> str:
    return _jar(f"SELECT '{kind}' AS kind, fqn AS owner, shard_id, CASE WHEN fqn = {_CLASS} THEN 'exact_fqn' ELSE 'simple_name' END AS reason FROM classes WHERE fqn = {_CLASS} OR {SIMPLE} = 'P15'")


def _why_sql(chosen: str) -> str:
    """Why the artifacts that hold the chosen classes (c) are there."""
    return _with(f"""SELECT coordinate, matched_by, source_class, arg_max(depth, position) AS depth, arg_max(path, position) AS path, arg_max(parent, position) AS parent FROM (
 SELECT a.*, t.source_class, t.position, CASE WHEN a.coordinate = t.coordinate THEN 'coordinate' WHEN concat(a.group_id, ':', a.artifact) = t.ga THEN 'group_artifact' ELSE 'artifact' END AS matched_by
 FROM artifacts a JOIN (SELECT s.coordinate, concat(split_part(s.coordinate, ':', 1), ':', split_part(s.coordinate, ':', 2)) AS ga, split_part(s.coordinate, ':', 2) AS name, c.fqn AS source_class, s.s_suppkey AS position FROM classes c JOIN shards s ON s.shard_id = c.shard_id WHERE s.coordinate IS NOT NULL AND {chosen}) t
 ON a.coordinate = t.coordinate OR concat(a.group_id, ':', a.artifact) = t.ga OR a.artifact = t.name) GROUP BY 1, 2, 3""")


def _class_sql(fqn: str) -> str:
    """The details of one class, lists as JSON."""
    mine = "x.class_fqn = c.fqn AND x.shard_id = c.shard_id"
    held = lambda c: f"CASE WHEN json_valid({c}) THEN {c} END"
    mark = f"struct_pack(fqn := annotation_fqn, attributes := {held('attributes')})"
    rule = f"struct_pack(type := type, ref_value := {held('ref_value')})"
    rules = f"coalesce((SELECT list({rule} ORDER BY type, coalesce(ref_value, '')) FROM conditions k WHERE k.target_kind = 'bean_method' AND k.bean_id = x.bean_id AND k.shard_id = x.shard_id), [])"
    bean = f"struct_pack(bean_name := bean_name, bean_id := bean_id, bean_type_fqn := bean_type_fqn, \"method\" := method_name || method_descriptor, conditions := {rules})"
    parts = {
        "interfaces": ("interface_fqn ORDER BY interface_fqn", f"class_interfaces x WHERE {mine}"),
        "annotations": (f"{mark} ORDER BY annotation_fqn, coalesce(attributes, '')", f"annotations x WHERE x.target_kind = 'class' AND {mine}"),
        "methods": ("struct_pack(name := name, descriptor := descriptor, return_fqn := return_fqn, modifiers := modifiers, annotations := []) ORDER BY name, descriptor", f"methods x WHERE {mine}"),
        "beans": ("b ORDER BY b.bean_name, b.bean_id", f"(SELECT {bean} AS b, config_fqn AS class_fqn, shard_id FROM beans x WHERE config_fqn = {fqn}) x WHERE {mine}"),
        "conditions": (f"{rule} ORDER BY type, coalesce(ref_value, '')", f"conditions x WHERE x.target_kind = 'class' AND {mine}"),
    }
    lists = ", ".join(f"(SELECT to_json(coalesce(list({value}), []))::VARCHAR FROM {rows}) AS {k}" for k, (value, rows) in parts.items())
    return _jar(f"SELECT c.shard_id, c.fqn, c.kind, c.super_fqn, c.modifiers, c.is_abstract, c.source_file, {lists} FROM classes c WHERE c.fqn = {fqn}")


def _json(df):
    """Lists as JSON, which engines compare alike."""
    return df.select(*[F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if f.dataType.typeName() == "array" else f.name for f in df.schema])


def _name(s, key: int) -> str:
    """The class name that the data gives a part key."""
    return s["part_names"].where(F.col("p_partkey") == key).first()["fqn"]


def _targets(s):
    shards = s["shards"].where("coordinate is not null")
    return s["classes"].join(shards, "shard_id").select("coordinate", F.col("fqn").alias("source_class"), F.col("s_suppkey").alias("position")).where(F.col("source_class").like("%P1"))


def _versions(s, first: str, second: str):
    """Rows of a kept session for each shard, after it was written for some shards and then brought to others."""
    spark, shards = s["shards"].sparkSession, s["shards"]
    kept = session_store.SessionStore(spark, scratch_path(spark, "session"), indexed=False)
    tables = {n: s[n] for n in RELATIONS if n in s.tables and "shard_id" in s[n].columns}
    kept.update(tables, shards.where(first))
    v = kept.update(tables, shards.where(second))
    now = kept.session(v)
    counts = now["classes"].select("shard_id", F.lit("classes").alias("of")).union(now["strings"].select("shard_id", F.lit("strings"))).union(now["beans"].select("shard_id", F.lit("beans"))).groupBy("shard_id").pivot("of", ["classes", "strings", "beans"]).count()
    return now["shards"].select("shard_id").join(counts, "shard_id", "left").na.fill(0).select("shard_id", "classes", "strings", "beans", F.lit(v.action).alias("action"), F.lit(v.chain).alias("chain"))


def _tree_rows(s):
    """The build's graph as tree files, one a region, read back and joined to the shards."""
    spark = s["nodes"].sparkSession
    ident = lambda c: F.translate(F.col(c), " ", "_")
    full = F.when(F.col("parent").isNull(), F.concat(F.lit("root:"), F.col("coordinate"), F.lit(":pom:1"))).when(F.startswith("coordinate", F.lit("nation:")), F.concat("coordinate", F.lit(":pom:1:compile")))
    full = F.coalesce(full, F.regexp_replace("coordinate", ":([^:]*)$", ":jar:$1:runtime"))
    roots = s["nodes"].where("parent is null").select(F.col("coordinate").alias("top"))
    nations = s["nodes"].join(roots, F.col("parent") == F.col("top")).select("coordinate", "top")
    tops = roots.select(F.col("top").alias("of"), "top").union(nations.select("coordinate", "top"))
    placed = s["nodes"].join(tops, F.coalesce("parent", "coordinate") == F.col("of")).select(F.translate("top", " ", "_").alias("file"), "coordinate", "parent", full.alias("full"))
    lines = (
        placed.select("file", F.lit(0).alias("part"), F.concat_ws(" ", ident("coordinate"), F.translate("full", " ", "_")).alias("value"))
        .union(placed.select("file", F.lit(1), F.lit("#")).distinct())
        .union(placed.where("parent is not null").select("file", F.lit(2), F.concat_ws(" ", ident("parent"), ident("coordinate"), F.lit("compile"))))
    )
    path = scratch_path(spark, "tgf")
    lines.repartition("file").sortWithinPartitions("file", "part", "value").select("file", "value").write.partitionBy("file").text(path)
    found = tgf.trees(tgf.read(spark, path)).select(F.regexp_extract("file", "file=([^/]*)", 1).alias("region"), "coordinate", "parent", "depth", "direct", F.array_join("trail", " > ").alias("path"))
    return found.join(s["shards"].groupBy("coordinate").agg(F.count(F.lit(1)).alias("shards")), "coordinate", "left").na.fill(0, ["shards"])


_TREE_ROWS = """SELECT replace(region, ' ', '_') AS region, x.coordinate, coalesce(x.parent, '') AS parent, x.depth::INTEGER AS depth, x.depth = 1 AS direct, x.path, (SELECT count(*) FROM shards s WHERE s.coordinate = x.coordinate)::BIGINT AS shards FROM (
 SELECT r_name AS region, concat('root:', replace(r_name, ' ', '_'), ':1') AS coordinate, NULL AS parent, 0 AS depth, '' AS path FROM region
 UNION ALL SELECT r_name, concat('nation:', replace(n_name, ' ', '_'), ':1'), concat('root:', replace(r_name, ' ', '_'), ':1'), 1, concat('nation:', replace(n_name, ' ', '_'), ':1') FROM nation JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT r_name, s.coordinate, concat('nation:', replace(n_name, ' ', '_'), ':1'), 2, concat('nation:', replace(n_name, ' ', '_'), ':1 > ', s.coordinate) FROM shards s JOIN supplier p ON p.s_suppkey = s.s_suppkey JOIN nation ON n_nationkey = p.s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s.coordinate IS NOT NULL) x"""


def _jar_sources(s):
    """Sources of archives with more lines and some files that weren't read."""
    n = F.length("entry")
    text = F.concat(F.lit("// generated\n"), "text", F.lit("\nint other; // int\n"))
    return s["sources"].select("shard_id", "entry", F.when(n % 9 != 0, text).alias("text"), F.when(n % 9 == 0, F.when(n % 2 == 0, "binary").otherwise("too large")).alias("note"))


_P1 = "(SELECT min(fqn) FROM classes WHERE string_split(fqn, '.')[-1] = 'P15')"
_OWNERS = f"""o AS (SELECT c.fqn, c.shard_id, coalesce(m.coordinate, m.filename) AS jar, m.coordinate IN (SELECT coordinate FROM artifacts) AS built FROM classes c JOIN shards m ON m.shard_id = c.shard_id WHERE c.fqn = {_P1}),
 k AS (SELECT *, count(*) OVER () AS owners, count_if(built) OVER () AS n FROM o), a AS (SELECT string_agg(DISTINCT jar, ', ' ORDER BY jar) AS jars FROM o),
 choice AS (SELECT fqn, shard_id, jar AS source_jar, owners, CASE WHEN owners = 1 THEN '' WHEN n = 1 THEN 'resolved' ELSE 'first' END AS how,
 CASE WHEN owners > 1 THEN concat(fqn, ' is in ', owners, ' archives (', (SELECT jars FROM a), '); read from ', jar, CASE WHEN n = 1 THEN ', which the build resolves' ELSE ', the first in order' END) ELSE '' END AS note
 FROM k WHERE n <> 1 OR built ORDER BY shard_id LIMIT 1)"""


def _sources(s):
    """The files under names that sources have, some in folders that are passed over."""
    d = F.length("text")
    return s["files"].where("text is not null").select(F.concat(F.when(d % 7 == 0, "build/").otherwise(""), "path", F.when(d % 11 == 0, ".md").otherwise(".kt")).alias("path"), "text")


def _scan_sql(high: list[str], broad: list[str], limit: int, budget: int) -> str:
    first = lambda terms: "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN '{t}'" for t in terms) + " END"
    blank = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    return _with(f""", f AS (SELECT concat(path, '.kt') AS path, text, row_number() OVER (ORDER BY concat(path, '.kt')) AS k, count(*) OVER () AS n FROM files WHERE text IS NOT NULL AND length(text) % 7 <> 0 AND length(text) % 11 <> 0),
 l AS (SELECT path, k, n, i AS line, trim(t[i], {blank}) AS shown, t[i] AS text FROM (SELECT *, string_split(text, chr(10)) AS t FROM f WHERE strlen(text) <= 2097152 AND NOT contains(text, chr(0))), unnest(range(1, len(t) + 1)) u(i)),
 h AS (SELECT *, {first(high)} AS high, {first(broad)} AS broad FROM l),
 p AS (SELECT *, CASE WHEN high IS NOT NULL AND k <= {budget} THEN 0 WHEN broad IS NOT NULL AND n <= {budget} AND k <= {budget} - n THEN 1 END AS phase FROM h),
 q AS (SELECT *, row_number() OVER (ORDER BY phase, path, line) AS place, count(*) OVER () AS found FROM p WHERE phase IS NOT NULL)
 SELECT path, line::INTEGER AS line, CASE phase WHEN 0 THEN high ELSE broad END AS term, phase, CASE WHEN strlen(shown) <= 240 THEN shown ELSE array_to_string(list_transform(list_filter(range(1, length(shown) + 1), lambda i: strlen(shown[1:i]) <= 240), lambda i: shown[i]), '') END AS text,
 found > {limit} AS has_more, CASE WHEN found <= {limit} AND (n > {budget} OR 2 * n > {budget}) THEN 'file_budget' ELSE '' END AS truncated_reason FROM q WHERE place <= {limit}""")


def _versions_sql(second: str, action: str, chain: int) -> str:
    n = lambda t: f"(SELECT count(*) FROM {t} x WHERE x.shard_id = s.shard_id) AS {t}"
    return _with(f"SELECT shard_id, {n('classes')}, {n('strings')}, {n('beans')}, '{action}' AS action, {chain}::INTEGER AS chain FROM shards s WHERE {second}")


def _lines(s):
    return provenance.source_lines(s["files"], F.col("path"), F.col("text"), max_bytes=1 << 40)


QUERIES = {
    "find_config_properties": (lambda s: detail.find_config_properties(s, "app.building"), _jar("SELECT name, prefix, type_fqn, default_val, description, source_fqn, shard_id FROM config WHERE name = 'app.building' OR starts_with(name, 'app.building.')")),
    "find_implementations": (lambda s: graph.find_implementations(s, _name(s, 3)), f"WITH RECURSIVE {sql_facts()}, e AS ({_EDGES}), r(fqn) AS (SELECT {_SEED} UNION SELECT e.child FROM e JOIN r ON e.parent = r.fqn) SELECT x.*, {_JAR} FROM (SELECT fqn, kind, shard_id FROM classes WHERE fqn IN (SELECT fqn FROM r) AND fqn <> {_SEED}) x LEFT JOIN shards m ON m.shard_id = x.shard_id"),
    "find_implementations_direct": (lambda s: graph.find_implementations(s, _name(s, 3), direct=True), _jar(f"SELECT fqn, kind, shard_id FROM classes WHERE fqn IN (SELECT child FROM ({_EDGES}) WHERE parent = {_SEED})")),
    "find_by_annotation": (lambda s: graph.find_by_annotation(s, _name(s, 4)), f"WITH RECURSIVE {sql_facts()}, e AS ({_ANNO_EDGES}), r(fqn) AS (SELECT {_ANNO_SEED} UNION SELECT e.child FROM e JOIN r ON e.parent = r.fqn) SELECT x.*, {_JAR} FROM (SELECT a.class_fqn, c.kind, a.annotation_fqn AS matched_annotation, a.attributes, a.shard_id FROM annotations a JOIN classes c ON c.shard_id = a.shard_id AND c.fqn = a.class_fqn WHERE a.annotation_fqn IN (SELECT fqn FROM r)) x LEFT JOIN shards m ON m.shard_id = x.shard_id"),
    "find_by_annotation_direct": (lambda s: graph.find_by_annotation(s, "org.anno.click", direct=True), _jar("SELECT a.class_fqn, c.kind, a.annotation_fqn AS matched_annotation, a.attributes, a.shard_id FROM annotations a JOIN classes c ON c.shard_id = a.shard_id AND c.fqn = a.class_fqn WHERE a.annotation_fqn = 'org.anno.click'")),
    "find_string": (lambda s: search.find_string(s, "TION"), _jar(f"SELECT value, class_fqn, method_name || method_descriptor AS method, shard_id FROM strings WHERE {_has('value', 'tion')}")),
    "find_class": (lambda s: search.find_class(s, CLASS_TERM, page=2), FIND_CLASS),
    "find_method": (lambda s: search.find_method(s, METHOD_TERM), _find_method_sql(METHOD_TERM)),
    "method": (lambda s: search.find_method(s, f"{_name(s, 15)}.getAO1"), _find_method_sql("@").replace("concat(owner, '#', name) = '@'", f"owner = {_CLASS} AND name = 'getAO1'").replace("name = '@' THEN 95", "false THEN 95").replace("starts_with(name, '@')", "false").replace("contains(" + _fold("name") + ", '@')", "false").replace("contains(" + _fold("owner") + ", '@')", "false")),
    "list_packages": (lambda s: search.list_packages(s, PACKAGE), _jar(f"SELECT package_name, shard_id, count(*) AS class_count FROM (SELECT {PACKAGE_OF} AS package_name, shard_id FROM classes) WHERE package_name = '{PACKAGE}' OR starts_with(lower(package_name), '{PACKAGE}.') GROUP BY ALL")),
    "search_symbol": (lambda s: search.search_symbol(s, TERM), _search_symbol_sql(TERM)),
    "search_symbol_page_2": (lambda s: search.search_symbol(s, "get", page=2), _search_symbol_sql("get", 2)),
    "search_symbol_kind_terms": (lambda s: search.search_symbol(s, "app."), _search_symbol_sql("app.")),
    "open_symbol": (lambda s: search.open_symbol(s, f"{_name(s, 15)}#getAO1"), _jar(f"SELECT concat(owner, '#', name) AS symbol, descriptor, 100 AS score, 'exact_method' AS match_reason, shard_id FROM ({_OWNED}) WHERE owner = {_CLASS} AND name = 'getAO1'")),
    "open_symbol_class": (lambda s: _json(search.open_symbol(s, "cfg.C10")), _class_sql("'cfg.C10'")),
    "open_symbol_name": (lambda s: search.open_symbol(s, "getAF1"), f"SELECT concat(class_fqn, '#', name) AS symbol, descriptor, score, match_reason, shard_id, source_jar FROM ({_find_method_sql('getAF1')})"),
    "get_class": (lambda s: _json(detail.get_class(s, _name(s, 15))), _class_sql(_CLASS)),
    "get_class_config": (lambda s: _json(detail.get_class(s, "cfg.C8")), _class_sql("'cfg.C8'")),
    "get_bean_definitions": (lambda s: detail.get_bean_definitions(s, "cfg.C7"), _jar(f"""SELECT config_fqn, bean_name, bean_type_fqn, method_name || method_descriptor AS method, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT {_COND} AS v FROM conditions c WHERE c.bean_id = b.bean_id)), '') AS conditions, bean_id, shard_id FROM beans b WHERE bean_type_fqn = 'cfg.C7' OR config_fqn = 'cfg.C7'""")),
    "get_beans_by_type": (lambda s: detail.get_bean_definitions(s, "bean.F"), _jar(f"""SELECT config_fqn, bean_name, bean_type_fqn, method_name || method_descriptor AS method, coalesce(c.conditions, '') AS conditions, b.bean_id, shard_id FROM beans b LEFT JOIN (SELECT bean_id, string_agg({_COND}, ',' ORDER BY {_COND}) AS conditions FROM conditions WHERE bean_id IS NOT NULL GROUP BY 1) c ON c.bean_id = b.bean_id WHERE bean_type_fqn = 'bean.F'""")),
    "explain_conditional": (lambda s: detail.explain_conditional(s, "cfg.C8"), _jar("""SELECT shard_id, 'class' AS target, cast(NULL as string) AS bean_name, -1 AS bean_id, type, ref_value FROM conditions WHERE target_kind = 'class' AND class_fqn = 'cfg.C8'
 UNION ALL SELECT c.shard_id, 'bean_method', b.bean_name, b.bean_id, c.type, c.ref_value FROM conditions c JOIN beans b ON b.bean_id = c.bean_id WHERE b.config_fqn = 'cfg.C8'""")),
    "list_extension_points": (lambda s: detail.list_extension_points(s), _with("SELECT mechanism, key, count(*) AS implementations FROM spi GROUP BY ALL")),
    "list_extension_point": (lambda s: detail.list_extension_points(s, "MACHINERY"), _jar("SELECT mechanism, key, impl_fqn, shard_id FROM spi WHERE key = 'MACHINERY' OR mechanism = 'MACHINERY'")),
    "why_dependency": (lambda s: provenance.why_dependency(s, _targets(s)), _why_sql("c.fqn LIKE '%P1'")),
    "why_dependency_class": (lambda s: provenance.why_dependency_of(s, _name(s, 15)), _why_sql(f"c.fqn = {_CLASS}")),
    "why_dependency_artifact": (lambda s: provenance.why_dependency_of(s, "Supplier-000000003"), _with("SELECT coordinate, 'coordinate' AS matched_by, '' AS source_class, depth, path, parent FROM artifacts WHERE artifact = 'Supplier-000000003'")),
    "dep_precise_import": (lambda s: provenance.precise(s, f"import {_name(s, 15)};"), _precise_sql("import")),
    "dep_precise_static": (lambda s: provenance.precise(s, f"import static {_name(s, 15)}.make;"), _precise_sql("static_import")),
    "dep_precise_method": (lambda s: provenance.precise(s, f"{_name(s, 15)}#getAO1"), _precise_sql("method")),
    "dep_precise_package": (lambda s: provenance.precise(s, "import com.promo.red_widget.*;"), _jar(f"SELECT DISTINCT 'package_import' AS kind, {PACKAGE_OF} AS owner, shard_id, 'package' AS reason FROM classes WHERE {PACKAGE_OF} = 'com.promo.red_widget'")),
    "dep_precise_fallback": (lambda s: provenance.precise(s, "Supplier-000000003"), _jar(_ARTIFACT.format("class"))),
    "dep_precise_provenance": (lambda s: provenance.provenance(s, f"import {_name(s, 15)};"), _why_sql(f"(c.fqn = {_CLASS} OR string_split(c.fqn, '.')[-1] = 'P15')")),
    "class": (lambda s: provenance.precise(s, _name(s, 15), "class"), _precise_sql("class")),
    "artifact_forced": (lambda s: provenance.precise(s, "Supplier-000000003", "artifact"), _jar(_ARTIFACT.format("artifact"))),
    "artifact": (lambda s: provenance.precise(s, "Supplier-000000003.jar"), _jar("SELECT 'artifact' AS kind, 'Supplier-000000003.jar' AS owner, shard_id, 'jar_filename' AS reason FROM shards WHERE filename = 'Supplier-000000003.jar'")),
    "class_origins": (lambda s: provenance.class_origins(s, _name(s, 20), limit=1000), _jar(f"SELECT fqn, 0 AS rank, shard_id FROM classes WHERE fqn = (SELECT fqn FROM part_names WHERE p_partkey = 20)")),
    "package_origins": (lambda s: provenance.package_origins(s, "com.promo.red_widget"), _jar(f"SELECT DISTINCT {PACKAGE_OF} AS package_name, shard_id FROM classes WHERE {PACKAGE_OF} = 'com.promo.red_widget'")),
    "artifact_origins": (lambda s: provenance.artifact_origins(s, "Supplier-00000000"), _with("SELECT shard_id, coordinate, filename, 'jar_filename' AS reason FROM shards WHERE contains(replace(filename, '.jar', ''), 'Supplier-00000000')")),
    "source_usages": (lambda s: provenance.source_usages(_lines(s), HIGH, BROAD), _with(f"""SELECT path, line::INTEGER AS line, term, CASE WHEN term IN ('License', 'token =') THEN 0 ELSE 1 END AS phase, CASE WHEN strlen(text) <= 240 THEN text ELSE array_to_string(list_transform(list_filter(range(1, length(text) + 1), lambda i: strlen(text[1:i]) <= 240), lambda i: text[i]), '') END AS text FROM (
 SELECT *, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'token =') THEN 'token =' WHEN contains(text, 'http') THEN 'http' WHEN contains(text, 'the ') THEN 'the ' END AS term FROM ({_LINES})) WHERE term IS NOT NULL""")),
    "search_source": (lambda s: provenance.search_source(_lines(s), "License"), _with(f"SELECT path, line::INTEGER AS line, text FROM ({_LINES}) WHERE contains(text, 'License')")),
    "source_owner": (lambda s: provenance.source_owner(s, _name(s, 15)), _with(_OWNER)),
    "get_source": (lambda s: provenance.get_source(s, s["sources"], _name(s, 15)), _with(_SOURCE.format("x.text"))),
    "get_source_method": (lambda s: provenance.get_source(s, s["sources"], _name(s, 15), "get"), _with(_SOURCE.format("concat('int get() { return ', length(o.fqn), '; }')"))),
    "get_source_simple_name": (lambda s: provenance.source_choice(s, "P15"), _with(f", {_OWNERS} SELECT * FROM choice")),
    "search_source_jar": (lambda s: provenance.search_source_of(s, _jar_sources(s), "P15", "int", page=2, size=7), _with(f""", {_OWNERS},
 j AS (SELECT entry, CASE WHEN length(entry) % 9 <> 0 THEN string_split(concat('// generated', chr(10), text, chr(10), 'int other; // int', chr(10)), chr(10)) END AS t FROM sources WHERE shard_id = (SELECT shard_id FROM choice)),
 h AS (SELECT entry, i::INTEGER AS line, t[i] AS text FROM j, unnest(range(1, len(t) + 1)) u(i) WHERE contains(t[i], 'int')),
 n AS (SELECT string_agg(concat(k, ' files passed over: ', why), '; ' ORDER BY concat(k, ' files passed over: ', why)) AS passed FROM (SELECT count(*) AS k, CASE WHEN length(entry) % 2 = 0 THEN 'binary' ELSE 'too large' END AS why FROM j WHERE t IS NULL GROUP BY 2))
 SELECT *, (SELECT count(*) > 14 FROM h) AS has_more, (SELECT concat_ws('; ', nullif(note, ''), passed) FROM choice, n) AS note FROM (SELECT * FROM h ORDER BY entry, line LIMIT 7 OFFSET 7)""")),
    "status": (lambda s: indexing.status(s["shards"], s["classes"], s["shards"].where("s_suppkey % 3 <> 1")), _with(f"SELECT count(DISTINCT shard_id) AS shards, count(DISTINCT CASE WHEN coordinate <> '' THEN shard_id END) AS with_coordinate, (SELECT count(*) FROM classes) AS classes, {_PRINT} AS fingerprint, count(DISTINCT CASE WHEN s_suppkey % 3 <> 1 THEN shard_id END) AS wanted, count(DISTINCT CASE WHEN s_suppkey % 3 <> 1 THEN shard_id END) AS indexed, {_PRINT} = (SELECT {_PRINT} FROM shards WHERE s_suppkey % 3 <> 1) AS current FROM shards")),
    "session_plan": (lambda s: indexing.plan_session(s["shards"].where("s_suppkey % 10 <> 1"), s["shards"].where("s_suppkey % 10 <> 2")), _with("SELECT *, CASE WHEN added + removed = 0 THEN 'reuse' WHEN before > 0 AND added + removed <= 0.25 * after THEN 'delta' ELSE 'rebuild' END AS action FROM (SELECT count_if(s_suppkey % 10 <> 1) AS before, count_if(s_suppkey % 10 <> 2) AS after, count_if(s_suppkey % 10 = 1) AS added, count_if(s_suppkey % 10 = 2) AS removed FROM shards)")),
    "kept_session_delta": (lambda s: _versions(s, "s_suppkey % 10 <> 1", "s_suppkey % 10 <> 2"), _versions_sql("s_suppkey % 10 <> 2", "delta", 1)),
    "kept_session_rebuild": (lambda s: _versions(s, "s_suppkey % 2 = 0", "s_suppkey % 3 <> 0"), _versions_sql("s_suppkey % 3 <> 0", "rebuild", 0)),
    "dependency_trees": (_tree_rows, _with(_TREE_ROWS)),
    "dep_answer_usages": (lambda s: usages.answer(s, _sources(s), "License", limit=30, file_budget=1_000_000)["usages"], _scan_sql(["import License", "import static License."], ["License", "import License"], 30, 1_000_000)),
    "dep_answer_truncated": (lambda s: usages.answer(s, _sources(s), "License:token", limit=100_000, file_budget=150)["usages"], _scan_sql(["License:token", "token"], ["License:token", "token"], 100_000, 150)),
    "dependency_trails": (lambda s: graph.trails(s["artifacts"].select(F.split("path", " > ").alias("trail"))), _with("SELECT coordinate, parent, 2::INTEGER AS depth, path, false AS direct FROM artifacts")),
    "cache_gc": (lambda s: store.collect(store.cached(s), "O", datetime.datetime(2001, 8, 1), 365, 100_000_000), _with("SELECT o_orderkey AS entry, CASE WHEN o_orderstatus <> 'O' THEN 'version' ELSE 'aged' END AS reason FROM orders WHERE o_orderstatus <> 'O' OR o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY UNION ALL SELECT entry, 'budget' FROM (SELECT o_orderkey AS entry, sum(cast(floor(o_totalprice) as bigint)) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY) WHERE k > 100000000")),
    "class_conflicts": (lambda s: graph.class_conflicts(s), _with("SELECT a.shard_id AS jar_a, b.shard_id AS jar_b, count(*) AS shared_classes FROM classes a JOIN classes b ON a.fqn = b.fqn AND a.shard_id < b.shard_id GROUP BY 1, 2")),
    "orphan_methods": (lambda s: s.methods.where("not owner_resolved").groupBy("shard_id").agg(F.count(F.lit(1)).alias("orphans")), _with("SELECT m.shard_id, count(*) AS orphans FROM methods m LEFT JOIN classes c ON c.shard_id = m.shard_id AND c.fqn = m.class_fqn WHERE c.fqn IS NULL GROUP BY 1")),
    "dependency_tree": (lambda s: graph.tree_paths(s["nodes"]), f"WITH RECURSIVE {sql_facts()}, t(coordinate, depth, path) AS (SELECT coordinate, 0, coordinate FROM nodes WHERE parent IS NULL UNION ALL SELECT n.coordinate, t.depth + 1, concat(t.path, ' > ', n.coordinate) FROM nodes n JOIN t ON n.parent = t.coordinate) SELECT coordinate, depth, path, depth = 1 AS direct FROM t"),
    "reactor_merge": (lambda s: graph.merge_reactor(store.sections(s)), _with("SELECT coordinate, depth, section, path FROM (SELECT concat('g:', event_type) AS coordinate, cast(user_id % 5 as int) AS depth, user_id AS section, cast(event_id as string) AS path, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 5, user_id, cast(event_id as string)) AS k FROM events) WHERE k = 1")),
    "fingerprint": (lambda s: store.fingerprint(s["shards"]), _with("SELECT substr(sha256(string_agg(DISTINCT shard_id, chr(10) ORDER BY shard_id)), 1, 16) AS fingerprint, count(DISTINCT shard_id) AS shards FROM shards")),
    "manifest": (lambda s: s.source_jar, _with("SELECT shard_id, coalesce(nullif(coordinate, ''), filename) AS source_jar FROM shards")),
    "cache_stats": (lambda s: store.cache_stats(store.cached(s)), _with("SELECT status, count(*) AS shards, sum(cast(floor(o_totalprice) as bigint))::BIGINT AS bytes, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM (SELECT *, o_orderstatus AS status FROM orders) GROUP BY 1")),
    "cache_gc_lru": (lambda s: store.gc_lru(store.cached(s), 1_000_000_000), _with("SELECT o_orderkey AS entry, (sum(cast(floor(o_totalprice) as bigint)) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS kept_bytes FROM orders QUALIFY kept_bytes > 1000000000")),
    "cache_gc_orphans": (lambda s: store.orphans(s["orders"].select(F.col("o_custkey").alias("path")), s["customer"].where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("path"))), _with("SELECT DISTINCT o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")),
    "digest_cache": (lambda s: store.digest_plan(*store.listing(s)), _with("SELECT l.path, l.size, CASE WHEN c.digest IS NOT NULL AND c.size = l.size AND c.mtime = l.mtime THEN c.digest ELSE sha256(l.path) END AS digest, NOT (c.digest IS NOT NULL AND c.size = l.size AND c.mtime = l.mtime) AS hashed FROM (SELECT c_name AS path, c_nationkey AS size, c_custkey AS mtime FROM customer) l LEFT JOIN (SELECT c_name AS path, cast(floor(c_nationkey / 2) * 2 as int) AS size, c_custkey - (c_custkey % 10 = 0)::INT AS mtime, concat('d', c_name) AS digest FROM customer WHERE c_custkey % 2 = 0) c ON c.path = l.path")),
    "dedupe_first_path": (lambda s: store.first_of(s["events"].select(F.col("props").alias("digest"), F.col("event_id").alias("position"), F.col("event_type").alias("path"))), _with("SELECT props AS digest, min(event_id) AS position, arg_min(event_type, event_id) AS path FROM events GROUP BY 1")),
    "shard_reuse": (lambda s: store.missing(s["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("size")), s["supplier"].where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("id"), F.expr("s_nationkey + case when s_suppkey % 9 = 0 then 1 else 0 end").alias("size"))), _with("SELECT s_suppkey AS id, s_nationkey AS size FROM supplier WHERE s_suppkey % 4 = 1 OR s_suppkey % 9 = 0")),
    "session_delta": (lambda s: store.delta(s["classes"], s["shards"].where("s_suppkey % 5 = 2").select("shard_id"), s["classes"].where("shard_id = 's000000002'")).groupBy("shard_id").agg(F.count(F.lit(1)).alias("classes")), _with("SELECT shard_id, count(*) AS classes FROM classes WHERE shard_id NOT IN (SELECT shard_id FROM shards WHERE s_suppkey % 5 = 2) OR shard_id = 's000000002' GROUP BY 1")),
    "registry_prefetch": (lambda s: store.prefetch_plan(s["lineitem"].select(F.col("l_suppkey").alias("id")), s["supplier"].where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id")), s["supplier"].where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))), _with("SELECT DISTINCT l_suppkey AS id, CASE WHEN l_suppkey % 3 = 0 THEN 'local' WHEN l_suppkey % 2 = 0 THEN 'download' ELSE 'extract' END AS action FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)")),
    "registry_export": (lambda s: store.exportable(s["part"].select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("version"), F.col("p_size").alias("checksum"), F.expr("case when p_partkey % 5 = 0 then null else p_size + p_partkey % 2 end").alias("actual")), "Brand#2"), _with("SELECT p_partkey AS id, CASE WHEN p_brand <> 'Brand#2' THEN 'old version' WHEN p_partkey % 5 = 0 OR p_partkey % 2 = 1 THEN 'checksum mismatch' ELSE 'export' END AS action FROM part")),
    "cache_gc_aged": (lambda s: store.aged(store.cached(s), datetime.datetime(2001, 8, 1), 365), _with("SELECT o_orderkey AS entry, o_orderdate AS used FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY")),
    "coordinates": (lambda s: store.coordinates(s["shards"].select(F.expr("concat(coalesce(coordinate, ' # none'), case when s_suppkey % 2 = 0 then ' # note' else '' end, case when s_suppkey % 9 = 4 then ':x:y' else '' end)").alias("value"))), _with("SELECT DISTINCT coordinate, len(string_split(coordinate, ':')) = 3 AS valid FROM (SELECT trim(string_split(concat(coalesce(coordinate, ' # none'), CASE WHEN s_suppkey % 2 = 0 THEN ' # note' ELSE '' END, CASE WHEN s_suppkey % 9 = 4 THEN ':x:y' ELSE '' END), '#')[1]) AS coordinate FROM shards) WHERE coordinate <> ''")),
    "suggest": (lambda s: search.suggest(s.classes.select(F.col("simple_name").alias("name")), "P15x", limit=20, most=2), _with(f"SELECT DISTINCT {SIMPLE} AS name, levenshtein({SIMPLE}, 'P15x')::INTEGER AS distance FROM classes WHERE levenshtein({SIMPLE}, 'P15x') <= 2 ORDER BY distance, name LIMIT 20")),
    "ngram_index": (lambda s: search.find_by_ngrams(search.ngrams(s.classes, "fqn"), "Red_Wid"), _with(f"SELECT DISTINCT fqn AS value FROM classes WHERE {_has('fqn', 'red_wid')}")),
    "first_visit": (lambda s: graph.first_visit(s["part_names"].where("p_partkey > 1").selectExpr("cast(floor(p_partkey / 2) as string) parent", "cast(p_partkey as string) child", "p_partkey position").union(s["part_names"].where("p_partkey % 9 = 0 and p_partkey > 9").selectExpr("cast(floor(p_partkey / 9) as string)", "cast(p_partkey as string)", "-1l")), "1"), f"WITH RECURSIVE {sql_facts()}, e AS (SELECT cast(floor(p_partkey / 2) as bigint) AS parent, p_partkey AS child FROM part WHERE p_partkey > 1 UNION ALL SELECT cast(floor(p_partkey / 9) as bigint), p_partkey FROM part WHERE p_partkey % 9 = 0 AND p_partkey > 9), w(node, depth, path) AS (SELECT 1::BIGINT, 0, '1' UNION ALL SELECT e.child, w.depth + 1, concat(w.path, ' > ', e.child::VARCHAR) FROM e JOIN w ON e.parent = w.node), k AS (SELECT *, min(depth) OVER (PARTITION BY node) AS d FROM w) SELECT node::VARCHAR AS node, depth, min(path) AS path FROM k WHERE depth = d GROUP BY 1, 2"),
    "string_page": (lambda s: paged(s["strings"].select("value", "class_fqn", "shard_id").distinct(), ["value", "class_fqn", "shard_id"], 2, 50), _with("SELECT DISTINCT value, class_fqn, shard_id FROM strings ORDER BY value, class_fqn, shard_id LIMIT 50 OFFSET 50")),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(load(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
