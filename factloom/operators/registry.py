"""A registry of shard files: export to it and prefetch from it, with their bytes.

Files are copied by the tasks, piece by piece, each under a name of its own attempt, and hashed as they pass. What counts is
the list that is written when all copies are done: a copy that a lost executor left, or whose digest isn't the
recorded one, is in no list and never read. A list is a Parquet table in a numbered folder, so a reader finds a whole one or the one before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder_names, remove
from ..sources.archives import CHUNK, opened, spread
from . import store

LISTED = "id string, version string, checksum string, size long, name string"


def listed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(id, version, checksum, size, name) of a registry's files, and the number of the list."""
    whole = [n for n in folder_names(spark, f"{folder}/lists") if "_SUCCESS" in folder_names(spark, f"{folder}/lists/{n}")]
    if not whole:
        return spark.createDataFrame([], LISTED), 0
    return spark.read.schema(LISTED).parquet(f"{folder}/lists/{whole[-1]}"), int(whole[-1])


def copied(files: DataFrame, folder: str) -> DataFrame:
    """(id, version, checksum, size, name, action): files (id, version, checksum, path) copied into ``folder``. The action is copied, or why there is no copy: missing, or checksum mismatch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") or "://" in folder else f"file://{folder}")
        system.create_dir(f"{root}/files", recursive=True)
        for b in batches:
            out = []
            for r in b.itertuples():
                name, digest, size = f"{r.id}-{uuid.uuid4().hex}", hashlib.sha256(), 0
                try:
                    with opened(r.path if ":" in r.path else f"file://{r.path}") as source, system.open_output_stream(f"{root}/files/{name}") as sink:
                        while piece := source.read(CHUNK):
                            digest.update(piece)
                            sink.write(piece)
                            size += len(piece)
                    action = "copied" if digest.hexdigest() == r.checksum else "checksum mismatch"
                except FileNotFoundError:
                    action = "missing"
                if action != "copied" and system.get_file_info(f"{root}/files/{name}").is_file:
                    system.delete_file(f"{root}/files/{name}")
                out.append((r.id, r.version, r.checksum, size, name, action))
            yield pd.DataFrame(out, columns=["id", "version", "checksum", "size", "name", "action"])

    return spread(files.select("id", "version", "checksum", "path"), "id").mapInPandas(each, f"{LISTED}, action string")


def _commit(found: DataFrame, folder: str) -> DataFrame:
    """Adds what was copied to the folder's list; (id, action) of all. The copies are written down before they are read, so none is made twice."""
    spark = found.sparkSession
    tried = f"{folder}/attempts/{uuid.uuid4().hex}"
    found.write.parquet(tried)
    found = spark.read.schema(f"{LISTED}, action string").parquet(tried)
    before, number = listed(spark, folder)
    good = found.where("action = 'copied'").drop("action")
    before.join(good.select("id"), "id", "left_anti").select(good.columns).union(good).write.mode("overwrite").parquet(f"{folder}/lists/{number + 1:09d}")
    return found.select("id", "action")


def export(shards: DataFrame, version: str, folder: str) -> DataFrame:
    """(id, action) of shards (id, version, checksum, path): those of the current version go to the registry, once for each id, if their bytes are as recorded."""
    have = listed(shards.sparkSession, folder)[0].select("id", F.col("checksum"))
    old = shards.where(F.col("version") != version).select("id", F.lit("old version").alias("action"))
    mine = shards.where(F.col("version") == version).dropDuplicates(["id"])
    there = mine.join(have, ["id", "checksum"], "left_semi").select("id", F.lit("there").alias("action"))
    return _commit(copied(mine.join(have, ["id", "checksum"], "left_anti"), folder), folder).union(there).union(old)


def prefetch(wanted: DataFrame, registry: str, folder: str) -> DataFrame:
    """(id, action) for wanted shards (id): local, copied from the registry, or extract, with the reason in brackets where the registry's file is missing or not as listed."""
    spark = wanted.sparkSession
    there = listed(spark, registry)[0]
    plan = store.prefetch_plan(wanted.select("id"), listed(spark, folder)[0].select("id"), there.select("id"))
    files = there.join(plan.where("action = 'download'"), "id", "left_semi").withColumn("path", F.concat(F.lit(f"{registry}/files/"), "name"))
    got = _commit(copied(files, folder), folder)
    rest = plan.where("action <> 'download'")
    return got.select("id", F.when(F.col("action") == "copied", "copied").otherwise(F.concat(F.lit("extract ("), "action", F.lit(")"))).alias("action")).union(rest)


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Deletes files that the last list doesn't name, lists before it and notes of attempts; the names of the files. Not to be called while files are copied."""
    now, number = listed(spark, folder)
    files = spark.createDataFrame([(n,) for n in folder_names(spark, f"{folder}/files") if not n.endswith(".crc")], "path string")
    gone = sorted(r["path"] for r in store.orphans(files, now.select(F.col("name").alias("path"))).collect())
    for name in gone:
        remove(spark, f"{folder}/files/{name}")
    for name in folder_names(spark, f"{folder}/lists"):
        if int(name) < number:
            remove(spark, f"{folder}/lists/{name}")
    remove(spark, f"{folder}/attempts")
    return gone
