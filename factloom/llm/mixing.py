"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents stand in a keyed random order and form one stream of
words, cut into blocks of ``block`` words. The mix is a sequence of slots; slot t
takes the golden-ratio point t*A mod M and the cumulative weights map that point
to a source. The k-th slot of a source reads its k-th block, starting over when
the stream is used up, until the source's target is met. Slots that the
schedule still owes a source at its end (a logarithmic number) close the mix;
those beyond a target are void.

Everything is DataFrame operations. A source may hold any share of the rows:
positions in a stream are prefix sums of two levels (bucket of the random order,
then row), so no window holds more than one bucket of a source, and ranks of
slots are counted by chunks in the same way. Both levels grow as the square root of the
table. Rows that repeat an id and a size are one row with a count until they have
their positions, so an id that a third of the rows share, or lack, fills no bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

#: Words in a block.
BLOCK = 512
#: Weights of the sources in code-point order, repeating; a document is taken at most CAP times.
WEIGHTS = (1, 2, 3)
CAP = 3
#: The modulus M = 2^31 and the odd number next to M / golden ratio: t -> t*A mod M is a permutation of [0, M).
MODULUS = 1 << 31
STEP = 1327217885
#: Points in a cell of the grid on which points and sources meet.
CELL = 1 << 15
#: Least slots whose ranks one window row covers, and least rows that share a bucket of the random order, about.
CHUNK = 1 << 14
BUCKET_ROWS = 2048
#: Copies of a row that are dealt out at once.
COPIES = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row for the documents of one source, id and size: with its place in the random order, and their number."""
    narrow = docs.select(
        "doc_id",
        F.col("source").isNull().alias("s_null"),
        F.coalesce("source", F.lit("")).alias("s"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    return narrow.groupBy("s_null", "s", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source of the rows (s_null, s, size, copies): source_size, target.

    Capped shares: with sources in ascending order of cap/weight, the first
    j stop at their caps, where j is the least number for which the rest,
    sharing what is left by weight, stay within theirs.
    The window runs over one row per source.
    """
    per = sizes.groupBy("s_null", "s").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    order = Window.orderBy("s_null", "s")
    per = per.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)).cast("long"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "s_null", "s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(by_ratio), F.lit(0)).alias("w_before"),
    )
    # what a unit of weight gets if exactly the sources before this one stop at their caps
    left, weight = F.col("total") - cap * F.col("size_before"), F.col("all_w") - F.col("w_before")
    stops = left * F.col("w") >= cap * F.col("source_size") * weight
    per = per.select("*", left.alias("left"), weight.alias("weight"), stops.alias("stops"))
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("size_before"), F.col("left"), F.col("weight")))).over(every)
    per = per.select("*", first.alias("first"))
    share = F.col("first.left") * F.col("w") / F.col("first.weight")
    whole = (cap * F.col("source_size")).cast("double")
    return per.select("s_null", "s", "source_size", F.when(F.col("stops") | F.col("first").isNull(), whole).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    A null source is a source of its own, the last. A null or blank text has
    size 0 and is never taken. Repeated rows and ids are separate documents.
    Without any words all targets are 0. Other columns are not read. ``bucket_rows`` and
    ``chunk`` set how the work is cut up, which changes no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = scratch.write(sized(docs), "sizes")
    per = scratch.write(
        targets(sizes, weights, cap).select(
            "*",
            F.floor("target").alias("goal"),
            F.ceil(F.col("source_size") / block).alias("blocks"),
        )
        # whole passes over the stream, and what the last pass still reads
        .select("*", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0).alias("passes"))
        .select("*", (F.col("goal") - F.col("passes") * F.col("source_size")).alias("rest"))
        .select("*", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).alias("slots"))
        .select("*", F.sum("slots").over(Window.orderBy("s_null", "s")).alias("upto")),
        "sources",
    )
    placed = _placed(sizes, per, scratch, bucket_rows)
    taken_blocks = _slots(per, scratch, block, chunk)
    at, end = F.col("at"), F.col("at") + F.col("size")
    pieces = placed.where("size > 0").select(
        "doc_id", "s_null", "s", "at", "size", "source_size", "target",
        F.explode(F.sequence(F.floor(at / block), F.floor((end - 1) / block))).alias("block"),
    )
    start = F.col("block") * block
    overlap = lambda upto: F.greatest(F.lit(0), F.least(end, upto) - F.greatest(at, start))
    words = F.coalesce(F.col("full"), F.lit(0)) * overlap(start + block) + overlap(start + F.coalesce(F.col("part"), F.lit(0)))
    keys = ["s_null", "s", "at", "doc_id", "size", "source_size", "target"]
    some = pieces.join(taken_blocks, ["s_null", "s", "block"], "left").select(*keys, words.alias("words")).groupBy(*keys).agg(F.sum("words").alias("taken"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return some.union(none).select("doc_id", F.when(~F.col("s_null"), F.col("s")).alias("source"), "size", "source_size", "target", "taken")


def _placed(sizes: DataFrame, per: DataFrame, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """Every document with the position of its first word in its source's stream."""
    # rows are dealt to buckets by the first eight digits of the random order, so buckets keep that order
    rows = sizes.count()
    n = math.ceil(rows / max(bucket_rows, math.isqrt(rows))) or 1
    dealt = sizes.withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("long")).withColumn("words", F.col("size") * F.col("copies"))
    sums = dealt.groupBy("s_null", "s", "bucket").agg(F.sum("words").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s_null", "s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.write(sums.select("s_null", "s", "bucket", before.alias("offset")).join(per.select("s_null", "s", "source_size", "target"), ["s_null", "s"]), "offsets")
    within = Window.partitionBy("s_null", "s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.coalesce(F.sum("words").over(within), F.lit(0)))
    first = local.join(offsets, ["s_null", "s", "bucket"]).select("doc_id", "s_null", "s", "size", "source_size", "target", "copies", (F.col("offset") + F.col("local")).alias("first"))
    # copies stand one after the other; they are dealt out in two steps, as one array of all might be very long
    some = first.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("part"))
    copy = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1))
    return some.select("*", copy.alias("copy")).select("doc_id", "s_null", "s", "size", "source_size", "target", (F.col("first") + F.col("copy") * F.col("size")).alias("at"), "copy")


def _slots(per: DataFrame, scratch: Scratch, block: int, chunk: int) -> DataFrame:
    """Per block that the mix reads: how often in full, and how much of it once more."""
    spark = per.sparkSession
    total = per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    chunk = max(chunk, math.isqrt(total))
    # The interval of points that means a source, cut at the cells of an even grid: points and intervals meet by cell.
    low = f"cast(cast(upto - slots as decimal(38,0)) * {MODULUS} div {max(1, total)} as long)"
    high = f"cast(cast(upto as decimal(38,0)) * {MODULUS} div {max(1, total)} as long)"
    sources = scratch.write(per.where("slots > 0").select("s_null", "s", "slots", "blocks", "passes", "rest", F.expr(low).alias("low"), F.expr(high).alias("high")), "bounds")
    cells = sources.where("low < high").select("s_null", "s", "low", "high", F.explode(F.sequence(F.expr(f"low div {CELL}"), F.expr(f"(high - 1) div {CELL}"))).alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(MODULUS)) * F.lit(STEP), F.lit(MODULUS))
    points = spark.range(total).select("id", point.alias("point")).withColumn("cell", F.expr(f"point div {CELL}"))
    slots = scratch.write(points.join(cells, "cell").where("low <= point and point < high").select("s_null", "s", "id", F.expr(f"id div {chunk}").alias("chunk")), "slots")
    counts = slots.groupBy("s_null", "s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s_null", "s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.write(counts.select("s_null", "s", "chunk", "n", before.alias("offset")).join(sources, ["s_null", "s"]), "ranks")
    rank = F.row_number().over(Window.partitionBy("s_null", "s", "chunk").orderBy("id")) - 1
    ranked = slots.withColumn("local", rank).join(offsets, ["s_null", "s", "chunk"]).select("s_null", "s", "slots", "blocks", "passes", "rest", (F.col("offset") + F.col("local")).alias("rank"))
    given = offsets.groupBy("s_null", "s").agg(F.sum("n").alias("given"))
    closing = (
        sources.join(given, ["s_null", "s"], "left")
        .where(F.coalesce("given", F.lit(0)) < F.col("slots"))
        .select("s_null", "s", "slots", "blocks", "passes", "rest", F.explode(F.sequence(F.coalesce("given", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    )
    read = ranked.where("rank < slots").union(closing).select("s_null", "s", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("turn"), "passes", "rest")
    partly = F.col("turn") >= F.col("passes")
    part = F.least(F.lit(block), F.col("rest") - F.col("block") * block)
    return read.groupBy("s_null", "s", "block").agg(F.sum(F.when(~partly, 1).otherwise(0)).alias("full"), F.coalesce(F.max(F.when(partly, part)), F.lit(0)).alias("part"))


def apply(docs: DataFrame, buckets: int = 1024) -> DataFrame:
    """``docs`` as the mix reads them: a row for each time a document is begun,
    so up to CAP rows; documents that the mix doesn't reach go.

    Rows that share an id, a source and a size are told apart by the hash of their text:
    of what they are due together, those first in its order get one more reading where it doesn't divide.
    They are counted in ``buckets`` of that order, so that no window holds all of them.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    parts = ["doc_id", "s", "n", "size"]
    key = F.struct("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), word_count(F.col("text")).alias("size"))
    taken = mix(docs).where("taken > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"), "size", F.expr("cast(ceil(taken / size) as int)").alias("times"))
    # rows the mix doesn't reach count too: what is due is spread over all rows of the key
    due = taken.groupBy(*parts).agg(F.sum("times").alias("times"))
    text_hash = F.xxhash64("text")
    keyed = docs.select("*", key.alias("__k"), text_hash.alias("__h"), F.pmod(text_hash, F.lit(buckets)).alias("__b"))
    narrow = keyed.select(*[F.col(f"__k.{c}").alias(c) for c in parts], F.col("__b").alias("b"))
    counted = narrow.groupBy(*parts, "b").agg(F.count(F.lit(1)).alias("rows"))
    by_key = Window.partitionBy(*parts)
    counted = counted.select("*", F.sum("rows").over(by_key).alias("all_rows"), F.coalesce(F.sum("rows").over(by_key.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["s"] == y["s"]) & (x["n"] == y["n"]) & (x["size"] == y["size"])
    given = scratch.write(counted.join(due, same(counted, due)).select(*[counted[x] for x in (*parts, "b", "all_rows", "before")], due["times"]), "given")
    single, several = given.where("all_rows = 1"), given.where("all_rows > 1")
    names = [F.col(f"k.`{x}`") for x in docs.columns]
    k = keyed.alias("k")
    on = lambda g: F.col("k.__k.doc_id").eqNullSafe(g["doc_id"]) & (F.col("k.__k.s") == g["s"]) & (F.col("k.__k.n") == g["n"]) & (F.col("k.__k.size") == g["size"]) & (F.col("k.__b") == g["b"])
    out = k.join(single, on(single)).select(*names, single["times"].cast("int").alias("__times"))
    if not several.isEmpty():
        place = F.row_number().over(Window.partitionBy("k.__k", "k.__b").orderBy("k.__h")) - 1 + F.col("before")
        times = F.expr("times div all_rows") + (place < F.expr("times % all_rows")).cast("int")
        out = out.union(k.join(several, on(several)).select(*names, times.cast("int").alias("__times")).where("__times > 0"))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__n")).drop("__n", "__times")


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(source_size) OVER o, 0) AS size_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM p WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - 3 * size_before) * w >= 3 * source_size * (all_w - w_before) AS stops FROM c
), f AS (
  SELECT arg_min((total - 3 * size_before)::BIGINT, size_before) AS rest_words, arg_min((all_w - w_before)::BIGINT, size_before) AS rest_w
  FROM l WHERE NOT stops
), t AS (
  SELECT source, source_size,
         CASE WHEN stops OR rest_w IS NULL THEN (3 * source_size)::DOUBLE ELSE (rest_words * w)::DOUBLE / rest_w::DOUBLE END AS target
  FROM l CROSS JOIN f
), a AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - pos)) END::BIGINT AS taken
FROM a
"""
