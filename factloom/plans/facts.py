"""Facts as projections of the star-schema tables, in SQL that Spark and other engines read alike.

Names in braces are tables; a fact may use facts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import symbol_index
from ..session import Session
from ..shared import scratch_path

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

_FQN = "concat('com.', lower(p_type), '.', replace(p_name, ' ', '_'), '.P', cast(p_partkey as string))"
_SHARD = "concat('s', lpad(cast({} as string), 9, '0'))"

FACTS = {
    "part_names": f"SELECT p_partkey, {_FQN} AS fqn FROM {{part}}",
    "shards": f"""SELECT {_SHARD.format('s_suppkey')} AS shard_id,
        CASE WHEN s_suppkey % 5 <> 0 THEN concat('com.n', cast(s_nationkey as string), ':', replace(s_name, '#', '-'), ':1.', cast(s_suppkey % 3 as string)) END AS coordinate,
        concat(replace(s_name, '#', '-'), '.jar') AS filename, s_suppkey FROM {{supplier}}""",
    "classes": f"""SELECT DISTINCT {_SHARD.format('l_suppkey')} AS shard_id, n.fqn,
        CASE WHEN l_partkey % 7 = 0 THEN 'interface' WHEN l_partkey % 7 = 1 THEN 'annotation' WHEN l_partkey % 7 = 2 THEN 'enum' ELSE 'class' END AS kind,
        u.fqn AS super_fqn, cast(l_partkey % 32 as int) AS modifiers, l_partkey % 4 = 0 AS is_abstract, cast(NULL as string) AS source_file
        FROM {{lineitem}} JOIN {{part_names}} n ON n.p_partkey = l_partkey
        LEFT JOIN {{part_names}} u ON l_partkey > 1 AND u.p_partkey = cast(floor(l_partkey / 2) as bigint)
        WHERE l_linenumber = 1
        UNION ALL
        SELECT DISTINCT {_SHARD.format('o_custkey % 10')}, concat('cfg.C', cast(o_custkey as string)), 'class', cast(NULL as string), cast(1 as int), false, cast(NULL as string)
        FROM {{orders}}""",
    "class_interfaces": """SELECT DISTINCT c.shard_id, c.fqn AS class_fqn, i.fqn AS interface_fqn
        FROM {part_names} p JOIN {classes} c ON c.fqn = p.fqn
        JOIN {part_names} i ON i.p_partkey = cast(floor(p.p_partkey / 3) as bigint) WHERE p.p_partkey % 5 = 0 AND p.p_partkey > 0""",
    "methods": f"""SELECT DISTINCT {_SHARD.format('l_suppkey')} AS shard_id, n.fqn AS class_fqn,
        concat('get', l_returnflag, l_linestatus, cast(l_linenumber as string)) AS name,
        concat('(I)L', cast(year(l_shipdate) as string), ';') AS descriptor, concat('L', cast(year(l_shipdate) as string)) AS return_fqn, 1 AS modifiers
        FROM {{lineitem}} JOIN {{part_names}} n ON n.p_partkey = l_partkey WHERE l_linenumber <= 2""",
    "annotations": f"""SELECT DISTINCT c.shard_id, 'class' AS target_kind, c.fqn AS class_fqn, cast(NULL as string) AS method_name, cast(NULL as string) AS method_descriptor,
        concat('org.anno.', event_type) AS annotation_fqn, props AS attributes
        FROM {{events}} JOIN {{part_names}} n ON n.p_partkey = user_id JOIN {{classes}} c ON c.fqn = n.fqn
        UNION ALL
        SELECT DISTINCT c.shard_id, 'class', c.fqn, cast(NULL as string), cast(NULL as string), u.fqn, cast(NULL as string)
        FROM {{part_names}} n JOIN {{classes}} c ON c.fqn = n.fqn AND c.kind = 'annotation'
        JOIN {{part_names}} u ON u.p_partkey = cast(floor(n.p_partkey / 2) as bigint) AND u.p_partkey <> n.p_partkey""",
    "beans": f"""SELECT {_SHARD.format('o_custkey % 10')} AS shard_id, o_orderkey AS bean_id, concat('cfg.C', cast(o_custkey as string)) AS config_fqn,
        concat('bean.', o_orderstatus) AS bean_type_fqn, concat('bean', cast(o_orderkey as string)) AS bean_name,
        CASE WHEN o_orderkey % 6 <> 0 THEN concat('make', cast(o_orderkey % 11 as string)) END AS method_name,
        CASE WHEN o_orderkey % 6 <> 0 THEN '()V' END AS method_descriptor FROM {{orders}}""",
    "conditions": f"""SELECT {_SHARD.format('o_custkey % 10')} AS shard_id, 'bean_method' AS target_kind, cast(NULL as string) AS class_fqn, o_orderkey AS bean_id,
        concat('On', replace(substring(o_orderpriority, 3), ' ', '')) AS type, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS ref_value
        FROM {{orders}} WHERE o_orderkey % 3 <> 0
        UNION ALL
        SELECT DISTINCT {_SHARD.format('o_custkey % 10')}, 'class', concat('cfg.C', cast(o_custkey as string)), cast(NULL as bigint), 'OnClass', o_orderpriority
        FROM {{orders}} WHERE o_custkey % 2 = 0""",
    "strings": f"""SELECT c.shard_id, c.fqn AS class_fqn, CASE WHEN turn % 2 = 0 THEN 'run' END AS method_name, CASE WHEN turn % 2 = 0 THEN '()V' END AS method_descriptor, v.text AS value
        FROM {{conversations}} v JOIN {{part_names}} n ON n.p_partkey = v.conv_id % 150 JOIN (SELECT fqn, min(shard_id) AS shard_id FROM {{classes}} GROUP BY fqn) c ON c.fqn = n.fqn""",
    "spi": f"""SELECT {_SHARD.format('c_custkey % 10')} AS shard_id, c_mktsegment AS mechanism, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS key,
        concat('impl.', replace(c_name, '#', '')) AS impl_fqn FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey""",
    "config": f"""SELECT {_SHARD.format('c_custkey % 10')} AS shard_id, concat('app.', lower(c_mktsegment)) AS prefix,
        concat('app.', lower(c_mktsegment), CASE WHEN c_custkey % 50 = 0 THEN '-x.' ELSE '.' END, lower(replace(c_name, '#', ''))) AS name,
        CASE WHEN c_custkey % 3 = 0 THEN 'java.lang.String' END AS type_fqn, cast(c_nationkey as string) AS default_val, cast(NULL as string) AS description,
        concat('cfg.C', cast(c_custkey as string)) AS source_fqn FROM {{customer}}""",
    "nodes": """SELECT r_name AS coordinate, cast(NULL as string) AS parent FROM {region}
        UNION ALL SELECT concat('nation:', n_name), r_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
        UNION ALL SELECT s.coordinate, concat('nation:', n_name) FROM {shards} s JOIN {supplier} p ON p.s_suppkey = s.s_suppkey JOIN {nation} ON n_nationkey = p.s_nationkey WHERE s.coordinate IS NOT NULL""",
    "artifacts": """SELECT s.coordinate, concat('com.n', cast(p.s_nationkey as string)) AS group_id, replace(p.s_name, '#', '-') AS artifact, cast(2 as int) AS depth,
        concat(r_name, ' > nation:', n_name, ' > ', s.coordinate) AS path, concat('nation:', n_name) AS parent
        FROM {shards} s JOIN {supplier} p ON p.s_suppkey = s.s_suppkey JOIN {nation} ON n_nationkey = p.s_nationkey JOIN {region} ON r_regionkey = n_regionkey WHERE s.coordinate IS NOT NULL""",
    "sources": """SELECT shard_id, concat(replace(fqn, '.', '/'), '.java') AS entry,
        concat('class ', split_part(fqn, '.', 4), ' {{ int get() {{ return ', cast(length(fqn) as string), '; }} }}') AS text FROM {classes}""",
    "files": "SELECT concat(source, '/', cast(doc_id as string)) AS path, text FROM {documents}",
}


def sql_facts(*names: str) -> str:
    """A WITH list of the facts, for any engine with the base tables as views."""
    here = {n: n for n in (*BASE, *FACTS)}
    return ", ".join(f"{n} AS ({sql.format(**here)})" for n, sql in FACTS.items() if not names or n in names)


#: Facts whose rows Spark makes distinct on both sides of the last join, whose key is among the columns, instead of after it: the same
#: rows, but what is shuffled are events and classes and not each class of each event.
DISTINCT_FIRST = {
    "annotations": """SELECT c.shard_id, 'class' AS target_kind, e.fqn AS class_fqn, cast(NULL as string) AS method_name, cast(NULL as string) AS method_descriptor, e.annotation_fqn, e.attributes
        FROM (SELECT DISTINCT n.fqn, concat('org.anno.', event_type) AS annotation_fqn, props AS attributes FROM {events} JOIN {part_names} n ON n.p_partkey = user_id) e
        JOIN (SELECT DISTINCT shard_id, fqn FROM {classes}) c ON c.fqn = e.fqn
        UNION ALL
        SELECT c.shard_id, 'class', c.fqn, cast(NULL as string), cast(NULL as string), u.up, cast(NULL as string)
        FROM (SELECT DISTINCT shard_id, fqn FROM {classes} WHERE kind = 'annotation') c
        JOIN (SELECT DISTINCT n.fqn, u.fqn AS up FROM {part_names} n JOIN {part_names} u ON u.p_partkey = cast(floor(n.p_partkey / 2) as bigint) AND u.p_partkey <> n.p_partkey) u ON u.fqn = c.fqn""",
}

#: Facts that searches share; a session writes them once, sorted by the column that lookups name, so that scans read few row groups. The columns
#: after it tell rows apart: a name that millions of rows share, or none, is cut into as many ranges as its rows need.
SORTED = {
    "classes": ("fqn", "shard_id"),
    "methods": ("class_fqn", "shard_id", "name"),
    "class_interfaces": ("interface_fqn", "class_fqn", "shard_id"),
    "annotations": ("annotation_fqn", "class_fqn", "shard_id"),
    "config": ("name", "shard_id", "source_fqn"),
    "beans": ("config_fqn", "bean_id"),
    "conditions": ("class_fqn", "bean_id", "ref_value"),
}
HOT = ("part_names", "classes", "class_interfaces", "methods", "annotations", "beans", "conditions", "strings", "spi", "config", "shards")
_SESSIONS: dict[tuple[str, str], Session] = {}


class Facts(dict):
    """The tables and facts of one data directory. Each is read, projected and, where searches share it, written when it is
    first asked for, so a query over few tables costs what these cost."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir, self.root = spark, sf_dir, scratch_path(spark, "facts")

    def __contains__(self, name) -> bool:
        return name in BASE or name in FACTS or name == "owned_methods"

    def __missing__(self, name: str) -> DataFrame:
        if name in BASE:
            made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name == "owned_methods":
            made = self._written(Session({n: self[n] for n in ("classes", "methods")}).methods, name)
        else:
            sql = DISTINCT_FIRST.get(name, FACTS[name])
            made = self.spark.sql(sql, **{t: self[t] for t in (*BASE, *FACTS) if f"{{{t}}}" in sql})
            if name in HOT:
                made = self._written(made, name)
        self[name] = made
        return made

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        if name in SORTED:
            df = df.repartitionByRange(*SORTED[name]).sortWithinPartitions(*SORTED[name])
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


def load(spark: SparkSession, sf_dir: str) -> Session:
    """The session of one data directory, one for each application; facts and the search index are made when a query first uses them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SESSIONS:
        made = Facts(spark, sf_dir)
        index = symbol_index.Later(lambda: symbol_index.SymbolIndex(*symbol_index.write(Session(made).symbols, lambda name: f"{made.root}/index/{name}")))
        _SESSIONS[key] = Session(made, index)
    return _SESSIONS[key]
