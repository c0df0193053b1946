"""Bookkeeping of a content-addressed fact store: reuse, deltas, collection, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint_of(ids: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 16)


def fingerprint(shards: DataFrame) -> DataFrame:
    """The first 16 hex digits of the SHA-256 of the sorted ids, one a line. Ids are one row per archive of one classpath."""
    return shards.agg(F.collect_set("shard_id").alias("ids")).select(fingerprint_of(F.col("ids")).alias("fingerprint"), F.size("ids").cast("long").alias("shards"))


def missing(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (id, size) that the manifest doesn't hold at that size."""
    return wanted.join(manifest, ["id", "size"], "left_anti")


def cached_digests(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """``listing`` (path, size, mtime, ...) with ``cached``: the digest that the cache (path, size, mtime, digest) has for a file of the same
    size and time of change, else null. A time that isn't known is never the same."""
    c = cache.select("path", F.col("size").alias("cached_size"), F.col("mtime").alias("cached_mtime"), F.col("digest").alias("cached"))
    hit = F.coalesce((F.col("cached_size") == F.col("size")) & (F.col("cached_mtime") == F.col("mtime")), F.lit(False))
    return listing.join(c, "path", "left").withColumn("cached", F.when(hit, F.col("cached"))).drop("cached_size", "cached_mtime")


def digest_plan(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, size, mtime, content) with their digests: from the cache where it has them, else computed."""
    known = F.col("cached").isNotNull()
    return cached_digests(listing, cache).select("path", "size", F.when(known, F.col("cached")).otherwise(F.sha2("content", 256)).alias("digest"), (~known).alias("hashed"))


def first_of(files: DataFrame) -> DataFrame:
    """Of files (digest, position, path) with one digest the first."""
    return files.groupBy("digest").agg(F.min("position").alias("position"), F.min_by("path", "position").alias("path"))


def orphans(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths of the store that the manifest doesn't name."""
    return files.join(manifest, "path", "left_anti").distinct()


def delta(relation: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """A relation without the rows of removed shards and with added rows: what a full rebuild gives."""
    return relation.join(removed, "shard_id", "left_anti").unionByName(added.select(relation.columns))


def prefetch_plan(wanted: DataFrame, local: DataFrame, registry: DataFrame) -> DataFrame:
    """What to do for each wanted id: use the local shard, download it, or extract it."""
    have = local.select("id", F.lit("local").alias("l"))
    there = registry.select("id", F.lit("download").alias("r"))
    out = wanted.distinct().join(have, "id", "left").join(there, "id", "left")
    return out.select("id", F.coalesce("l", "r", F.lit("extract")).alias("action"))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status").agg(F.count(F.lit(1)).alias("shards"), F.sum("bytes").alias("bytes"), F.min("used").alias("oldest"), F.max("used").alias("newest"))


def gc_lru(entries: DataFrame, budget: int) -> DataFrame:
    """Entries that go when the store may hold ``budget`` bytes, the most recently used staying.

    The running sum has two levels, days and the entries of a day, so no task sorts the whole manifest.
    """
    e = entries.withColumn("day", F.to_date("used"))
    days = e.groupBy("day").agg(F.sum("bytes").alias("bytes"))
    before = days.select("day", F.coalesce(F.sum("bytes").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("day").orderBy(F.desc("used"), F.desc("entry")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = e.withColumn("here", F.sum("bytes").over(within)).join(before, "day")
    return summed.select("entry", (F.col("before") + F.col("here")).alias("kept_bytes")).where(F.col("kept_bytes") > budget)


def cached(s) -> DataFrame:
    """Store entries as the facts have them."""
    return s["orders"].select(F.col("o_orderkey").alias("entry"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("used"))


def listing(s) -> tuple[DataFrame, DataFrame]:
    files = s["customer"].select(F.col("c_name").alias("path"), F.col("c_nationkey").alias("size"), F.col("c_custkey").alias("mtime"), F.col("c_name").cast("binary").alias("content"))
    known = s["customer"].where("c_custkey % 2 = 0").select(F.col("c_name").alias("path"), F.expr("cast(floor(c_nationkey / 2) * 2 as int)").alias("size"), F.expr("case when c_custkey % 10 = 0 then c_custkey - 1 else c_custkey end").alias("mtime"), F.concat(F.lit("d"), "c_name").alias("digest"))
    return files, known


def sections(s) -> DataFrame:
    return s["events"].select(F.concat(F.lit("g:"), "event_type").alias("coordinate"), F.expr("cast(user_id % 5 as int)").alias("depth"), F.col("user_id").alias("section"), F.col("event_id").cast("string").alias("path"))


def exportable(manifest: DataFrame, version: str) -> DataFrame:
    """What a registry takes: shards (id, version, checksum, actual) of the current version whose file is as recorded, others with the reason they are left out."""
    reason = F.when(F.col("version") != version, "old version").when(~F.col("checksum").eqNullSafe(F.col("actual")), "checksum mismatch")
    return manifest.select("id", F.coalesce(reason, F.lit("export")).alias("action"))


def aged(entries: DataFrame, now, days: int) -> DataFrame:
    """Entries last used more than ``days`` days before ``now``."""
    return entries.where(F.col("used") < F.lit(now) - F.expr(f"interval {int(days)} days")).select("entry", "used")


def collect(entries: DataFrame, version: str, now, days: int, budget: int) -> DataFrame:
    """(entry, reason) of what a collection removes, or would: entries of another version (status), then the aged,
    then of the rest the least recently used beyond ``budget`` bytes."""
    reason = F.when(F.col("status") != version, "version").when(F.col("used") < F.lit(now) - F.expr(f"interval {int(days)} days"), "aged")
    judged = entries.withColumn("reason", reason)
    over = gc_lru(judged.where("reason is null"), budget).select("entry", F.lit("budget").alias("reason"))
    return judged.where("reason is not null").select("entry", "reason").union(over)


def coordinates(lines: DataFrame) -> DataFrame:
    """group:artifact:version lines (value): comments and blank lines left out, others marked valid or not, each once."""
    text = F.trim(F.split("value", "#").getItem(0))
    return lines.select(text.alias("coordinate")).where("coordinate <> ''").distinct().select("coordinate", F.col("coordinate").rlike("^[^:\\s]+:[^:\\s]+:[^:\\s]+$").alias("valid"))
