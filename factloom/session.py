"""A session: the relations of the shards on one classpath, with derived columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import package_name, simple_name
from .operators import reach


@dataclass
class Session:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: The kept search index, where there is one (``operators.symbol_index``).
    index: Any = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @cached_property
    def classes(self) -> DataFrame:
        return self["classes"].withColumns({"simple_name": simple_name(F.col("fqn")), "package_name": package_name(F.col("fqn"))})

    @cached_property
    def methods(self) -> DataFrame:
        """Methods with ``owner``, the class of the same shard if it is there, and ``symbol``, owner#name;
        taken from the relation owned_methods where it was written with the facts."""
        if "owned_methods" in self.tables:
            return self["owned_methods"]
        owners = self["classes"].select("shard_id", F.col("fqn").alias("owner"))
        m = self["methods"].alias("m")
        joined = m.join(owners.alias("o"), (F.col("m.shard_id") == F.col("o.shard_id")) & (F.col("m.class_fqn") == F.col("o.owner")), "left")
        return joined.select("m.*", "o.owner", F.col("o.owner").isNotNull().alias("owner_resolved"), F.concat("o.owner", F.lit("#"), "m.name").alias("symbol"))

    @cached_property
    def source_jar(self) -> DataFrame:
        """The name that results carry for a shard: its coordinate, else its file."""
        return self["shards"].select("shard_id", F.coalesce(F.when(F.col("coordinate") != "", F.col("coordinate")), "filename").alias("source_jar"))

    def with_jar(self, df: DataFrame) -> DataFrame:
        """``df`` with source_jar, the shard id where the shard isn't in the manifest."""
        return df.join(self.source_jar, "shard_id", "left").withColumn("source_jar", F.coalesce("source_jar", "shard_id"))

    @cached_property
    def type_edges(self) -> DataFrame:
        """(child, parent) over superclasses and interfaces, by name and across shards."""
        up = self["classes"].where("super_fqn is not null").select(F.col("fqn").alias("child"), F.col("super_fqn").alias("parent"))
        return up.union(self["class_interfaces"].select("class_fqn", "interface_fqn")).distinct()

    @cached_property
    def type_labels(self) -> reach.Labels:
        """What is below a type, made when it is first asked for."""
        return reach.label(self.type_edges)

    def types_below(self, fqn: str) -> DataFrame:
        return self._below("type", fqn)

    def annotations_below(self, fqn: str) -> DataFrame:
        return self._below("annotation", fqn)

    def _below(self, kind: str, fqn: str) -> DataFrame:
        """(fqn) of the name and what is below it: by labels that are there, else by a walk, which costs less than to make them,
        else, where it is deep, by labels made now."""
        if f"{kind}_labels" not in self.__dict__:
            walked = reach.walk(getattr(self, f"{kind}_edges"), fqn)
            if walked is not None:
                return walked
        return getattr(self, f"{kind}_labels").below(fqn)

    @cached_property
    def annotation_labels(self) -> reach.Labels:
        return reach.label(self.annotation_edges)

    @cached_property
    def annotation_edges(self) -> DataFrame:
        """(child, parent): annotation types and the annotations that they carry."""
        types = self["classes"].where("kind = 'annotation'").select("shard_id", "fqn")
        marks = self["annotations"].where("target_kind = 'class'").select("shard_id", F.col("class_fqn").alias("fqn"), "annotation_fqn")
        return marks.join(types, ["shard_id", "fqn"], "left_semi").select(F.col("fqn").alias("child"), F.col("annotation_fqn").alias("parent")).distinct()

    @cached_property
    def symbols(self) -> DataFrame:
        """The six kinds of searchable symbols as (kind, name, owner, detail, shard_id)."""
        null = F.lit(None).cast("string")
        classes = self["classes"].select(F.lit("class").alias("kind"), F.col("fqn").alias("name"), null.alias("owner"), F.col("kind").alias("detail"), "shard_id")
        methods = self.methods.where("owner_resolved").select(F.lit("method"), "symbol", "owner", "descriptor", "shard_id")
        a = self["annotations"]
        owner = F.when(F.col("target_kind") == "method", F.concat("class_fqn", F.lit("#"), "method_name")).otherwise(F.col("class_fqn"))
        annotations = a.select(F.lit("annotation"), "annotation_fqn", owner, "attributes", "shard_id")
        spi = self["spi"].select(F.lit("spi"), "impl_fqn", "key", "mechanism", "shard_id")
        config = self["config"].select(F.lit("config-property"), "name", "source_fqn", "type_fqn", "shard_id")
        strings = self["strings"].select(F.lit("string"), "value", "class_fqn", F.concat("method_name", "method_descriptor"), "shard_id")
        out = classes
        for df in (methods, annotations, spi, config, strings):
            out = out.union(df)
        return out.where("name is not null")
