"""A kept search index: which blocks of the symbol table can hold a term.

Symbols are written in order of their names, cut into files by ranges of names and, inside, into numbered
blocks of ``BLOCK_ROWS`` rows. A row keeps its searchable text folded once, so a scan compares one
column. Posting lists say for each n-gram which blocks hold it; they are partitioned by a hash of the gram, so a lookup
reads as many folders as a term has grams, at most. A term's rows lie in blocks that hold all of its grams; the
files of other ranges aren't opened. Where a term has no gram, or more than ``MAX_BLOCKS`` blocks may hold it, all rows are scanned: the rows found are the same.

Tables of several segments add up: an index over more shards is the union of theirs, and rows of shards that went are left out with the shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_fold

GRAM = 3
BLOCK_ROWS, RANGE_ROWS, BUCKETS = 2048, 65_536, 32
#: Blocks whose numbers go to the driver, at most.
MAX_BLOCKS = 4096
#: Between the fields of a row's text; folding cuts fields at it, so it is in none and in no term that matches.
SEPARATOR = "\0"


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """(range, block, kind, name, owner, detail, shard_id, folded), in order of names, to be written by range."""
    n = max(1, -(-symbols.count() // RANGE_ROWS))
    dealt = symbols.repartitionByRange(n, "name", "kind", "shard_id").sortWithinPartitions("name", "kind", "shard_id", "owner", "detail")
    folded = F.concat_ws(SEPARATOR, *[F.coalesce(ascii_fold(F.col(c)), F.lit("")) for c in ("name", "owner", "detail")])
    return dealt.withColumns({"folded": folded, "range": F.spark_partition_id(), "block": F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)})


def postings(rows: DataFrame) -> DataFrame:
    """(bucket, gram, range, block) once for each gram of a block, to be written by bucket. ``rows`` are written symbol rows.
    Names, owners and details come back many times in a block, so grams are taken from each of its fields once."""
    fields = rows.select("range", "block", F.explode(F.array_distinct(F.split("folded", SEPARATOR))).alias("field")).where(F.length("field") >= GRAM).distinct()
    every = F.regexp_extract_all("field", F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    grams = fields.select("range", "block", F.explode(F.array_distinct(every)).alias("gram")).distinct()
    return grams.withColumn("bucket", bucket_of(F.col("gram"))).repartitionByRange("bucket", "gram", "range", "block").sortWithinPartitions("bucket", "gram", "range", "block")


def bucket_of(gram):
    return (F.crc32(gram) % BUCKETS).cast("int")


#: The tables as they are written, but for the columns that name folders.
ROWS = "kind string, name string, owner string, detail string, shard_id string, folded string, block long, range int"
POSTED = "range int, block long, gram string, bucket int"


def write(symbols: DataFrame, path_of) -> tuple[DataFrame, DataFrame]:
    """Writes the two tables to ``path_of(name)`` and returns them read back."""
    spark = symbols.sparkSession
    symbol_rows(symbols).write.partitionBy("range").parquet(path_of("symbols"))
    rows = spark.read.schema(ROWS).parquet(path_of("symbols"))
    postings(rows).write.partitionBy("bucket").parquet(path_of("postings"))
    return rows, spark.read.schema(POSTED).parquet(path_of("postings"))


class SymbolIndex:
    """Symbol rows and posting lists, with a segment column where they come from several segments."""

    def __init__(self, rows: DataFrame, posted: DataFrame, max_blocks: int = MAX_BLOCKS):
        self.rows, self.posted, self.max_blocks = rows, posted, max_blocks
        self.place = [c for c in ("segment", "range", "block") if c in posted.columns]

    def blocks(self, term: str) -> list | None:
        """Places that hold all grams of a term; None where the index doesn't narrow the search."""
        folded = term.translate(str.maketrans(UPPER, LOWER))
        grams = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
        if not grams or SEPARATOR in folded:
            return None
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        hits = self.posted.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        full = hits.groupBy(*self.place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(*self.place)
        found = full.limit(self.max_blocks + 1).collect()
        return found if len(found) <= self.max_blocks else None

    def candidates(self, term: str) -> tuple[DataFrame, bool]:
        """Symbols (kind, name, owner, detail, shard_id) among which are all that a search for the term can match; and whether each is known to hold the folded term in a field, as it is unless the term has a NUL."""
        rows, found = self.rows, self.blocks(term)
        if found is not None:
            for column in self.place:
                rows = rows.where(F.col(column).isin(sorted({r[column] for r in found})))
        held = SEPARATOR not in term
        if held:
            rows = rows.where(F.contains("folded", F.lit(term.translate(str.maketrans(UPPER, LOWER)))))
        return rows.select("kind", "name", "owner", "detail", "shard_id"), held


class Later:
    """An index that is written when a search first asks for it."""

    def __init__(self, make: Callable[[], SymbolIndex]):
        self._make = make

    @cached_property
    def made(self) -> SymbolIndex:
        return self._make()

    def candidates(self, term: str) -> tuple[DataFrame, bool]:
        return self.made.candidates(term)
