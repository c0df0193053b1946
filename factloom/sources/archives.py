"""Archives of compiled classes as fact relations.

``binaryFile`` lists the archives; equal contents are dropped by digest
before anything is parsed; one pass over the rest, file by file, emits rows of all relations,
tagged, from which each relation is a filter. A class that can't be read is a warning,
an archive that can't be opened is a row of ``failed``.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RELATIONS
from ..session import Session
from .classfile import BadClass, parse_class

#: Names that the extracted frameworks give their files and annotations.
BEAN = "org.springframework.context.annotation.Bean"
CONDITIONAL = "org.springframework.context.annotation.Conditional"
CONDITION = re.compile(r".*\.condition\.ConditionalOn(\w+)")
IMPORTS = "META-INF/spring/org.springframework.boot.autoconfigure.AutoConfiguration.imports"
FACTORIES = "META-INF/spring.factories"
METADATA = ("META-INF/spring-configuration-metadata.json", "META-INF/additional-spring-configuration-metadata.json")
SERVICES = "META-INF/services/"
SOURCE_SUFFIXES = (".java", ".kt", ".scala", ".groovy")
#: Bytes that are read at once for a digest.
CHUNK = 1 << 20
#: Bytes of a source file that is read, at most.
MAX_SOURCE_BYTES = 5 << 20


def properties(text: str) -> dict[str, str]:
    """The java.util.Properties format: comments, continued lines, escapes."""
    out: dict[str, str] = {}
    lines = iter(text.splitlines())
    for line in lines:
        line = line.lstrip()
        if not line or line[0] in "#!":
            continue
        while (len(line) - len(line.rstrip("\\"))) % 2:
            line = line[:-1] + next(lines, "").lstrip()
        m = re.match(r"((?:\\.|[^\\\s:=])*)\s*[:=]?\s*(.*)", line, re.S)
        plain = lambda s: re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}.get(e[1], e[1]), s, flags=re.S)
        out[plain(m[1])] = plain(m[2])
    return out


def provider_lines(text: str) -> list[str]:
    return [x for x in (line.split("#", 1)[0].strip() for line in text.splitlines()) if x]


def compact(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def condition_type(fqn: str) -> str | None:
    if fqn == CONDITIONAL:
        return "Conditional"
    m = CONDITION.fullmatch(fqn)
    return f"On{m[1]}" if m else None


def bean_name(values: dict, method: str) -> str:
    for key in ("name", "value"):
        given = values.get(key)
        for x in given if isinstance(given, list) else [given]:
            if isinstance(x, str) and x.strip():
                return x
    return method


def class_rows(data: bytes) -> Iterator[tuple[str, dict]]:
    c = parse_class(data)
    yield "classes", {"fqn": c.fqn, "kind": c.kind, "super_fqn": c.super_fqn, "modifiers": c.modifiers, "is_abstract": c.is_abstract, "source_file": c.source_file}
    for i in c.interfaces:
        yield "class_interfaces", {"class_fqn": c.fqn, "interface_fqn": i}
    for value in c.constants:
        yield "strings", {"class_fqn": c.fqn, "method_name": None, "method_descriptor": None, "value": value}
    for a in c.annotations:
        yield "annotations", {"target_kind": "class", "class_fqn": c.fqn, "method_name": None, "method_descriptor": None, "annotation_fqn": a.fqn, "attributes": a.attributes}
        if t := condition_type(a.fqn):
            yield "conditions", {"target_kind": "class", "class_fqn": c.fqn, "bean_id": None, "type": t, "ref_value": a.attributes}
    for m in c.methods:
        at = {"method_name": m.name, "method_descriptor": m.descriptor}
        yield "methods", {"class_fqn": c.fqn, "name": m.name, "descriptor": m.descriptor, "return_fqn": m.return_fqn, "modifiers": m.modifiers}
        for value in m.strings:
            yield "strings", {"class_fqn": c.fqn, **at, "value": value}
        bean = next((a for a in m.annotations if a.fqn == BEAN), None)
        for a in m.annotations:
            yield "annotations", {"target_kind": "method", "class_fqn": c.fqn, **at, "annotation_fqn": a.fqn, "attributes": a.attributes}
        if bean:
            row = {"config_fqn": c.fqn, "bean_type_fqn": m.return_fqn, "bean_name": bean_name(bean.values, m.name), **at}
            yield "beans", row
            for a in m.annotations:
                if t := condition_type(a.fqn):
                    yield "conditions", {"target_kind": "bean_method", "class_fqn": c.fqn, "bean": compact(row), "type": t, "ref_value": a.attributes}


def config_rows(text: str) -> Iterator[tuple[str, dict]]:
    for p in json.loads(text).get("properties", []):
        if isinstance(name := p.get("name"), str):
            default = p.get("defaultValue")
            yield "config", {
                "prefix": name.rpartition(".")[0] or None, "name": name, "type_fqn": p.get("type"), "description": p.get("description"), "source_fqn": p.get("sourceType"),
                "default_val": None if default is None else default if isinstance(default, str) else compact(default),
            }


def archive_rows(content) -> Iterator[tuple[str, dict]]:
    """(relation, row) of everything in an archive, given as bytes or an open file; entries in order of their names, versioned ones left out."""
    coordinate = None
    spi: set[tuple] = set()
    config: dict[str, dict] = {}
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        for name in sorted({n for n in z.namelist() if not n.startswith("META-INF/versions/")}):
            try:
                if name.endswith(".class"):
                    yield from class_rows(z.read(name))
                elif name == IMPORTS:
                    spi.update(("autoconfig.imports", None, x) for x in provider_lines(z.read(name).decode()))
                elif name == FACTORIES:
                    for key, value in properties(z.read(name).decode()).items():
                        spi.update(("spring.factories", key, x.strip()) for x in value.split(",") if x.strip())
                elif name.startswith(SERVICES) and "/" not in name[len(SERVICES) :] and name != SERVICES:
                    spi.update(("services", name[len(SERVICES) :], x) for x in provider_lines(z.read(name).decode()))
                elif name in METADATA:
                    for _, row in config_rows(z.read(name).decode()):
                        config.setdefault(row["name"], row)
                elif re.fullmatch(r"META-INF/maven/[^/]+/[^/]+/pom\.properties", name) and coordinate is None:
                    p = properties(z.read(name).decode())
                    if all(p.get(k) for k in ("groupId", "artifactId", "version")):
                        coordinate = f"{p['groupId']}:{p['artifactId']}:{p['version']}"
            except (BadClass, ValueError, AttributeError, TypeError, zipfile.BadZipFile) as e:
                yield "warnings", {"entry": name, "warning": str(e)}
    for m, k, i in sorted(spi, key=lambda x: (x[0], x[1] or "", x[2])):
        yield "spi", {"mechanism": m, "key": k, "impl_fqn": i}
    for row in config.values():
        yield "config", row
    yield "shards", {"coordinate": coordinate}


def archive_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, content, modificationTime) of the archives in files, folders and globs."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jar").option("recursiveFileLookup", "true").load(list(paths))


def archive_listing(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, size, mtime) of the archives; what is in them isn't read."""
    return archive_files(spark, *paths).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def opened(path: str):
    """A file of any of Arrow's file systems, for reads at any place."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def with_digests(listing: DataFrame) -> DataFrame:
    """(path, size, mtime, digest): each file's SHA-256, read piece by piece. A file that can't be read has a digest of null."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["path"]:
                digest = hashlib.sha256()
                try:
                    with opened(path) as f:
                        while piece := f.read(CHUNK):
                            digest.update(piece)
                    found.append(digest.hexdigest())
                except OSError:
                    found.append(None)
            yield b.assign(digest=found)[["path", "size", "mtime", "digest"]]

    return listing.select("path", "size", "mtime").mapInPandas(each, "path string, size long, mtime long, digest string")


def spread(files: DataFrame, key: str) -> DataFrame:
    """Rows that stand for files dealt over as many tasks as a shuffle has: they are too small for adaptive execution to leave them apart."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def facts_of(files: DataFrame) -> DataFrame:
    """One tagged row (shard_id, filename, size_bytes, relation, row as JSON) per fact of archives (shard_id, path, size), which are opened one at a time and read entry by entry."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, path, size in zip(b["shard_id"], b["path"], b["size"], strict=True):
                name, out = path.rsplit("/", 1)[-1], []
                try:
                    with opened(path) as f:
                        rows = list(archive_rows(f))
                    # the shard's own row tells how many there are, so that a reader knows when it has them all
                    out = [(shard, name, size, relation, compact({**row, "facts": len(rows)} if relation == "shards" else row)) for relation, row in rows]
                except (zipfile.BadZipFile, EOFError, OSError, pa.ArrowInvalid) as e:  # Arrow's for a place before the start
                    out = [(shard, name, size, "failed", compact({"error": str(e)}))]
                for at in range(0, len(out), 20_000):
                    yield pd.DataFrame(out[at : at + 20_000], columns=["shard_id", "filename", "size_bytes", "relation", "row"])

    return spread(files.select("shard_id", "path", "size"), "shard_id").mapInPandas(each, "shard_id string, filename string, size_bytes long, relation string, row string")


def first_paths(digested: DataFrame) -> DataFrame:
    """(shard_id, path, size): of equal contents the first path's file."""
    return digested.where("digest is not null").groupBy(F.col("digest").alias("shard_id")).agg(F.min(F.struct("path", "size")).alias("f")).select("shard_id", "f.path", "f.size")


def read_archives(spark: SparkSession, *paths: str, known: DataFrame | None = None) -> DataFrame:
    """``facts_of`` the archives under ``paths`` but for those of ``known`` shards (shard_id); equal contents count once."""
    unique = first_paths(with_digests(spread(archive_listing(spark, *paths), "path")))
    return facts_of(unique if known is None else unique.join(known, "shard_id", "left_anti"))


def read_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """(filename, entry, text) of the source files in source archives; entries that are too large, binary or not UTF-8 have a note and no text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for i in sorted(z.infolist(), key=lambda i: i.filename):
                    if i.filename.endswith(SOURCE_SUFFIXES):
                        text = note = None
                        if i.file_size > MAX_SOURCE_BYTES:
                            note = "too large"
                        else:
                            data = z.read(i)
                            try:
                                text = None if b"\0" in data else data.decode()
                                note = None if text is not None else "binary"
                            except UnicodeDecodeError:
                                note = "not UTF-8"
                        yield pd.DataFrame({"filename": [path.rsplit("/", 1)[-1]], "entry": [i.filename], "text": [text], "note": [note]})

    return archive_files(spark, *paths).select("path", "content").mapInPandas(each, "filename string, entry string, text string, note string")


def session_of(facts: DataFrame) -> Session:
    """The relations of tagged rows, as ``read_archives`` gives them or as they were written."""
    made = {}
    for name, schema in RELATIONS.items():
        if name in ("shards", "artifacts", "lines", "beans", "conditions"):
            continue
        rest = ", ".join(f.strip() for f in schema.split(",")[1:])
        made[name] = facts.where(F.col("relation") == name).select("shard_id", F.from_json("row", rest).alias("r")).select("shard_id", "r.*")
    bean = lambda c: F.xxhash64("shard_id", c)  # noqa: E731  a bean's id is that of its row
    rest = "config_fqn string, bean_type_fqn string, bean_name string, method_name string, method_descriptor string"
    made["beans"] = facts.where("relation = 'beans'").select("shard_id", bean("row").alias("bean_id"), F.from_json("row", rest).alias("r")).select("shard_id", "bean_id", "r.*")
    c = facts.where("relation = 'conditions'").select("shard_id", F.from_json("row", "target_kind string, class_fqn string, bean string, type string, ref_value string").alias("r"))
    made["conditions"] = c.select("shard_id", "r.target_kind", "r.class_fqn", F.when(F.col("r.bean").isNotNull(), bean("r.bean")).alias("bean_id"), "r.type", "r.ref_value")
    made["shards"] = facts.where("relation = 'shards'").select("shard_id", F.get_json_object("row", "$.coordinate").alias("coordinate"), "filename", F.col("shard_id").alias("sha256"), "size_bytes", F.lit("local").alias("source"))
    return Session(made)


def write_store(facts: DataFrame, path: str) -> None:
    """Facts as Parquet by relation, so a query reads the relations that it names, sorted so that prefixes prune."""
    facts.repartition("relation", "shard_id").sortWithinPartitions("relation", "shard_id").write.mode("append").partitionBy("relation").parquet(path)
