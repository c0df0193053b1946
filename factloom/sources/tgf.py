"""Dependency trees in trivial graph format as a data source: "id coordinate" lines, "#", "parent child" lines.

``spark.read.format("tgf").load(folder)`` reads one file a task, line by line, so a tree of any size needs no
memory. Files are found and opened through Arrow's file systems. ``trees`` turns the rows into artifacts with their paths, which it finds by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import scratch_path

SCHEMA = "file string, line long, node string, coordinate string, group_id string, artifact string, version string, type string, classifier string, scope string, parent string"


class TgfError(ValueError):
    """A tree that can't be read, with file and line."""


def coordinate_of(text: str) -> tuple:
    """(coordinate, group, artifact, version, type, classifier, scope) of g:a:type:version[:scope] or g:a:type:classifier:version:scope."""
    parts = text.strip().split(":")
    if not 4 <= len(parts) <= 6:
        raise TgfError(f"{text!r} isn't a coordinate")
    group, name, kind = parts[:3]
    classifier = parts.pop(3) if len(parts) == 6 else None
    version, scope = parts[3], parts[4] if len(parts) == 5 else None
    if not (group and name and version):
        raise TgfError(f"{text!r} isn't a coordinate")
    return f"{group}:{name}:{version}", group, name, version, kind, classifier, scope


def rows_of(file: str, lines) -> Iterator[tuple]:
    """A row for each node (with its coordinate) and each edge (with its parent) of a file."""
    edges, nodes = False, 0
    for number, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line:
            continue
        if line == "#":
            edges = True
            continue
        a, _, b = line.partition(" ")
        if edges:
            ends = line.split()
            if len(ends) < 2:
                raise TgfError(f"{file}: line {number}: malformed edge {line!r}")
            yield (file, number, ends[1], None, None, None, None, None, None, None, ends[0])
        else:
            if not b:
                raise TgfError(f"{file}: line {number}: malformed node {line!r}")
            try:
                coordinate, group, name, version, kind, classifier, scope = coordinate_of(b)
            except TgfError as e:
                raise TgfError(f"{file}: line {number}: {e}") from None
            nodes += 1
            yield (file, number, a, coordinate, group, name, version, kind, classifier, scope, None)
    if not nodes:
        raise TgfError(f"{file}: the tree is empty")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TgfFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class TgfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[TgfFile]:
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else "file://"
        # as folders are read elsewhere, names that begin with a dot or an underscore aren't data
        return [TgfFile(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: TgfFile) -> Iterator[tuple]:
        import io

        system, path = _open(partition.value)
        with system.open_input_stream(path) as stream:
            yield from rows_of(partition.value, io.TextIOWrapper(io.BufferedReader(stream, 1 << 20), "utf-8"))


class TgfSource(DataSource):
    """Option path: a file, or a folder whose files are all read."""

    @classmethod
    def name(cls) -> str:
        return "tgf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TgfReader:
        return TgfReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TgfSource)
    return spark.read.format("tgf").load(path)


def trees(rows: DataFrame) -> DataFrame:
    """(file, coordinate, group_id, artifact, version, scope, parent, depth, direct, trail) of each node of each file.

    ``trail`` lists the coordinates below the root down to the node: a root's is empty and its depth 0, and direct are those below a root. Of lines that name a node twice the last
    counts, of its parents the first. A parent that no line names is none that has a coordinate. A cycle is an error."""
    spark = rows.sparkSession
    root, n = scratch_path(spark, "trees"), 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{root}/{n}")
        return spark.read.schema(df.schema).parquet(f"{root}/{n}")

    rows = written(rows)
    named = ["coordinate", "group_id", "artifact", "version", "scope"]
    nodes = rows.where("coordinate is not null").groupBy("file", "node").agg(F.max_by(F.struct(*named), "line").alias("a")).select("file", "node", "a.*")
    parents = rows.where("parent is not null").groupBy("file", "node").agg(F.min_by("parent", "line").alias("up"))
    linked = nodes.join(parents, ["file", "node"], "left")
    over = linked.select("file", F.col("node").alias("up"), F.col("coordinate").alias("parent"), F.col("up").isNull().alias("direct"))
    all_ = written(linked.join(over, ["file", "up"], "left"))
    # a trail ends below a root, or below what has no line of its own
    go_on = F.when(F.col("parent").isNotNull() & ~F.col("direct"), F.col("up"))
    step = written(all_.select("file", "node", go_on.alias("up"), F.when(F.col("up").isNull(), F.array().cast("array<string>")).otherwise(F.array("coordinate")).alias("trail")))
    size, reach = all_.count(), 1
    while not step.where("up is not null").isEmpty():
        if reach > 2 * size:
            raise ValueError("the dependencies form a cycle: " + ", ".join(sorted(r["node"] for r in step.where("up is not null").select("node").limit(5).collect())))
        above = step.select("file", F.col("node").alias("up"), F.col("up").alias("further"), F.col("trail").alias("before"))
        met = step.join(above, ["file", "up"], "left")
        # trails in a cycle would double in each round, though nothing reads them
        short = F.slice(F.concat(F.coalesce("before", F.array().cast("array<string>")), "trail"), F.lit(1), F.lit(size + 1))
        step, reach = written(met.select("file", "node", F.col("further").alias("up"), short.alias("trail"))), reach * 2
    out = all_.join(step.select("file", "node", "trail"), ["file", "node"])
    return out.select("file", *named, F.coalesce("parent", F.lit("")).alias("parent"), F.size("trail").alias("depth"), (F.col("up").isNotNull() & F.coalesce("direct", F.lit(False))).alias("direct"), "trail")
