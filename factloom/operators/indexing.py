"""Indexing: archives to facts to a session, each step repeatable."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder_names, remove, scratch_path
from ..sources import archives
from . import store

#: A session is changed in place while at most this share of its shards changes, and so many times on end.
DELTA_SHARE, DELTA_CHAIN = 0.25, 8
#: Archives that a report names, at most; it counts all.
MAX_NAMED = 1000


@dataclass
class Report:
    """What indexing one classpath did."""

    total: int = 0
    new: int = 0
    reused: int = 0
    missing: list[str] = field(default_factory=list)
    #: Archives that couldn't be read and aren't among the missing, which are the first by name.
    unnamed: int = 0
    error: str | None = None


def parts(spec: str) -> list[str]:
    """The files, folders and globs of a comma list, in order, each once; the reader expands them."""
    found = list(dict.fromkeys(p.strip() for p in spec.split(",") if p.strip()))
    if not found:
        raise ValueError("no archive is named")
    return found


def known_shards(spark: SparkSession, path: str, *relations: str) -> DataFrame:
    """(shard_id) of which the fact store at ``path`` holds rows of these relations; none if there is no store."""
    try:
        return spark.read.parquet(path).where(F.col("relation").isin(*relations)).select("shard_id").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "shard_id string")


LISTING = "path string, size long, mtime long, digest string"


def kept_listing(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(path, size, mtime, digest) of the files that the store at ``path`` was last indexed with, and the number of that listing."""
    folder = f"{path}.listing"
    whole = [n for n in folder_names(spark, folder) if "_SUCCESS" in folder_names(spark, f"{folder}/{n}")]
    if not whole:
        return spark.createDataFrame([], LISTING), 0
    return spark.read.schema(LISTING).parquet(f"{folder}/{whole[-1]}"), int(whole[-1])


def changes(spark: SparkSession, spec: str, path: str) -> DataFrame:
    """(path, size, mtime, digest, state) of the archives of ``spec`` by the kept listing, without reading any: known, changed or new. The digest is that of known ones."""
    old = kept_listing(spark, path)[0]
    joined = store.cached_digests(archives.archive_listing(spark, *parts(spec)), old).join(old.select("path", F.lit(True).alias("was")), "path", "left")
    state = F.when(F.col("cached").isNotNull(), "known").when(F.col("was").isNotNull(), "changed").otherwise("new")
    return joined.select("path", "size", "mtime", F.col("cached").alias("digest"), state.alias("state"))


def index(spark: SparkSession, spec: str, path: str) -> Report:
    """Adds the archives of ``spec`` to the fact store at ``path``.

    The listing is joined to the kept one before any content is read: only files that are new, or of another size or time, are hashed, and only
    contents that the store doesn't hold are parsed. The new listing is written once and serves all that follows; with nothing changed no archive is opened. Archives that can't be
    read are named in the report each time."""
    old, number = kept_listing(spark, path)
    scratch = scratch_path(spark, "index")
    changes(spark, spec, path).write.parquet(f"{scratch}/changes")
    now = spark.read.parquet(f"{scratch}/changes")
    columns = ["path", "size", "mtime", "digest"]
    hashed = archives.with_digests(archives.spread(now.where("digest is null"), "path"))
    rest = old.join(now.select("path"), "path", "left_anti").select(columns)  # of other projects
    target = f"{path}.listing/{number + 1:09d}"
    now.where("digest is not null").select(columns).union(hashed).union(rest).write.mode("overwrite").parquet(target)
    listed = spark.read.schema(LISTING).parquet(target).join(now.select("path"), "path", "left_semi")
    for name in folder_names(spark, f"{path}.listing"):
        if int(name) <= number:
            remove(spark, f"{path}.listing/{name}")
    unique = archives.first_paths(listed)
    seen = known_shards(spark, path, "shards", "failed")
    unique.join(seen.withColumn("seen", F.lit(True)), "shard_id", "left").withColumn("seen", F.col("seen").isNotNull()).write.parquet(f"{scratch}/wanted")
    wanted = spark.read.parquet(f"{scratch}/wanted")
    fresh = wanted.where("not seen")
    if not fresh.isEmpty():
        archives.write_store(archives.facts_of(fresh), path)
    held = known_shards(spark, path, "shards").withColumn("held", F.lit(1))
    counts = wanted.join(held, "shard_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("held").alias("held"), F.count(F.when(~F.col("seen"), F.col("held"))).alias("new")).first()
    failed = wanted.join(held, "shard_id", "left_anti").select(F.regexp_extract("path", "[^/]*$", 0).alias("filename"))
    failed = failed.union(listed.where("digest is null").select(F.regexp_extract("path", "[^/]*$", 0))).distinct()
    return Report(counts["total"], counts["new"], counts["held"] - counts["new"], [r.filename for r in failed.orderBy("filename").limit(MAX_NAMED).collect()], unnamed=max(0, failed.count() - MAX_NAMED))


def index_many(spark: SparkSession, projects: dict[str, str], path: str) -> dict[str, Report]:
    """One report for each project (name, spec); one that fails leaves the others alone."""
    out = {}
    for name, spec in projects.items():
        try:
            out[name] = index(spark, spec, path)
        except Exception as e:  # the report carries it
            out[name] = Report(error=str(e).split("\n")[0])
    return out


def plan_session(old: DataFrame, new: DataFrame, chain: int = 0) -> DataFrame:
    """How to come from the shards of one session (shard_id) to those of another: reuse, delta or rebuild, in one row
    with the numbers of shards added and removed. A delta is taken while few shards change and the chain is short."""
    a, b = old.select("shard_id").distinct(), new.select("shard_id").distinct()
    sides = a.withColumn("o", F.lit(1)).join(b.withColumn("n", F.lit(1)), "shard_id", "full")
    counts = sides.agg(
        F.count("o").alias("before"),
        F.count("n").alias("after"),
        F.count(F.when(F.col("o").isNull(), 1)).alias("added"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("removed"),
    )
    changed = F.col("added") + F.col("removed")
    small = (F.col("before") > 0) & (changed <= DELTA_SHARE * F.col("after")) & F.lit(chain < DELTA_CHAIN)
    return counts.select("*", F.when(changed == 0, "reuse").when(small, "delta").otherwise("rebuild").alias("action"))


def build_session(spark: SparkSession, facts: DataFrame, wanted: DataFrame, path: str) -> str:
    """Writes the facts of the wanted shards (shard_id) under a name that is their fingerprint; a session that is there is kept."""
    name = store.fingerprint(wanted).first()["fingerprint"]
    target = f"{path}/{name}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        chosen = facts.join(wanted.select("shard_id").distinct(), "shard_id", "left_semi")
        chosen.write.mode("overwrite").partitionBy("relation").parquet(target)
    return name


def status(shards: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: shards, those with a coordinate, classes, the fingerprint, how many shards of a classpath (shard_id) are
    there and whether the session is that of it. One aggregate over the union of the three."""
    null, none = F.lit(None).cast("string"), F.lit(0).cast("long")
    rows = (
        shards.select("shard_id", "coordinate", null.alias("wanted"), none.alias("classes"))
        .union(classes.agg(F.count(F.lit(1)).alias("n")).select(null, null, null, "n"))
        .union(wanted.select(null, null, "shard_id", none))
    )
    named = F.collect_set(F.when(F.col("coordinate") != "", F.col("shard_id")))
    sets = rows.agg(F.collect_set("shard_id").alias("have"), F.collect_set("wanted").alias("want"), named.alias("named"), F.sum("classes").alias("classes"))
    return sets.select(
        F.size("have").cast("long").alias("shards"),
        F.size("named").cast("long").alias("with_coordinate"),
        "classes",
        store.fingerprint_of(F.col("have")).alias("fingerprint"),
        F.size("want").cast("long").alias("wanted"),
        F.size(F.array_intersect("have", "want")).cast("long").alias("indexed"),
        (store.fingerprint_of(F.col("have")) == store.fingerprint_of(F.col("want"))).alias("current"),
    )


def report_dict(r: Report) -> dict[str, Any]:
    """A report without its empty parts."""
    return {k: v for k, v in vars(r).items() if v not in (None, [], "") and (k, v) != ("unnamed", 0)}
