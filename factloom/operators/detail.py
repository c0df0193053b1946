"""Details of one class, beans and their conditions, extension points, properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Session


def joined(value, sep: str = ",") -> F.Column:
    """The values of a group in order, as one string; empty for none."""
    return F.array_join(F.array_sort(F.collect_list(value)), sep)


def raw_json(c: F.Column) -> F.Column:
    """The text where it is JSON, else null."""
    return F.when(F.get_json_object(c, "$").isNotNull(), c)


def listed(value: F.Column) -> F.Column:
    """The values of a group in order; nulls within them come first."""
    return F.array_sort(F.collect_list(value))


def marks(df: DataFrame, *keys) -> DataFrame:
    """The annotations of each target as ``annotations``: (fqn, attributes), attributes null unless they are JSON."""
    found = listed(F.struct("annotation_fqn", F.coalesce("attributes", F.lit("")).alias("attributes")))
    shown = F.transform(found, lambda x: F.struct(x["annotation_fqn"].alias("fqn"), raw_json(x["attributes"]).alias("attributes")))
    return df.groupBy(*keys).agg(shown.alias("annotations"))


def rules(df: DataFrame, *keys) -> DataFrame:
    """The conditions of each target as ``conditions``: (type, ref_value), the value null unless it is JSON."""
    found = listed(F.struct("type", F.coalesce("ref_value", F.lit("")).alias("ref_value")))
    shown = F.transform(found, lambda x: F.struct(x["type"].alias("type"), raw_json(x["ref_value"]).alias("ref_value")))
    return df.groupBy(*keys).agg(shown.alias("conditions"))


def left_lists(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the lists of ``other``, empty where it has no row."""
    lists = [f for f in other.schema if f.name not in keys]
    return df.join(other, keys, "left").withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists})


def bean_conditions(s: Session, beans: DataFrame) -> DataFrame:
    """The conditions of these beans' methods alone, so that what is aggregated grows with the beans and not with the session."""
    return s["conditions"].where("target_kind = 'bean_method'").join(beans.select("shard_id", "bean_id"), ["shard_id", "bean_id"], "left_semi")


def get_class(s: Session, fqn: str) -> DataFrame:
    """A row per shard that holds the class, with ordered lists of its interfaces, annotations, methods (with their
    annotations), bean definitions (with their conditions) and conditions. Children are filtered first, aggregated
    on their own and joined."""
    out = s.classes.where(F.col("fqn") == fqn).select("shard_id", "fqn", "kind", "super_fqn", "modifiers", "is_abstract", "source_file")
    of = lambda t, c="class_fqn": s[t].where(F.col(c) == fqn)
    on = of("annotations")
    on_methods = on.where("target_kind = 'method'").withColumns({"name": F.col("method_name"), "descriptor": F.col("method_descriptor")})
    methods = left_lists(of("methods"), marks(on_methods, "shard_id", "name", "descriptor"), ["shard_id", "name", "descriptor"])
    mine = of("beans", "config_fqn")
    beans = left_lists(mine, rules(bean_conditions(s, mine), "shard_id", "bean_id"), ["shard_id", "bean_id"])
    bean = F.struct("bean_name", "bean_id", "bean_type_fqn", F.concat("method_name", "method_descriptor").alias("method"), "conditions")
    parts = [
        of("class_interfaces").groupBy("shard_id").agg(listed(F.col("interface_fqn")).alias("interfaces")),
        marks(on.where("target_kind = 'class'"), "shard_id"),
        methods.groupBy("shard_id").agg(listed(F.struct("name", "descriptor", "return_fqn", "modifiers", "annotations")).alias("methods")),
        beans.groupBy("shard_id").agg(listed(bean).alias("beans")),
        rules(of("conditions").where("target_kind = 'class'"), "shard_id"),
    ]
    for p in parts:
        out = left_lists(out, p, ["shard_id"])
    return s.with_jar(out)


def get_bean_definitions(s: Session, fqn: str) -> DataFrame:
    """Beans of that type, or defined by that class, with the conditions of their methods."""
    beans = s["beans"].where((F.col("bean_type_fqn") == fqn) | (F.col("config_fqn") == fqn))
    c = bean_conditions(s, beans).groupBy("shard_id", "bean_id").agg(joined(F.concat("type", F.lit("="), F.coalesce("ref_value", F.lit("")))).alias("conditions"))
    out = beans.join(c, ["shard_id", "bean_id"], "left").na.fill("", ["conditions"])
    return s.with_jar(out.select("config_fqn", "bean_name", "bean_type_fqn", F.concat("method_name", "method_descriptor").alias("method"), "conditions", "bean_id", "shard_id"))


def explain_conditional(s: Session, fqn: str) -> DataFrame:
    """The conditions of a class, then those of its bean methods, per shard."""
    own = s["conditions"].where((F.col("target_kind") == "class") & (F.col("class_fqn") == fqn)).select("shard_id", F.lit("class").alias("target"), F.lit(None).cast("string").alias("bean_name"), F.lit(-1).cast("long").alias("bean_id"), "type", "ref_value")
    beans = s["beans"].where(F.col("config_fqn") == fqn).select("shard_id", "bean_id", "bean_name")
    rest = s["conditions"].where("target_kind = 'bean_method'").join(beans, ["shard_id", "bean_id"]).select("shard_id", F.lit("bean_method"), "bean_name", "bean_id", "type", "ref_value")
    return s.with_jar(own.union(rest))


def list_extension_points(s: Session, arg: str | None = None) -> DataFrame:
    """Mechanisms and keys with their numbers of entries; or the entries of one key or mechanism."""
    if arg is None:
        return s["spi"].groupBy("mechanism", "key").agg(F.count(F.lit(1)).alias("implementations"))
    return s.with_jar(s["spi"].where((F.col("key") == arg) | (F.col("mechanism") == arg)).select("mechanism", "key", "impl_fqn", "shard_id"))


def find_config_properties(s: Session, prefix: str) -> DataFrame:
    """The property of that name and all below it, as a range of names."""
    name = F.col("name")
    hits = s["config"].where((name == prefix) | ((name >= prefix + ".") & (name < prefix + "/")))
    return s.with_jar(hits.select("name", "prefix", "type_fqn", "default_val", "description", "source_fqn", "shard_id"))
