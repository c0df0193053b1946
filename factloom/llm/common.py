"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: The six characters that separate words.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that go to Python at once, unless the session sets another number.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from Spark's default of 10,000 rows, which suits numbers:
    so many whole texts take tens of megabytes several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts lineage and survives the loss of any executor. Tables
    that are no longer needed are dropped; what a returned, still lazy result
    reads stays until the session ends. Shuffle files of a write go when it ends, instead
    of staying until the driver happens to collect its garbage.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self._fs(self.root, lambda fs, p: fs.deleteOnExit(p))

    def _fs(self, path: str, f) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        f(fs, p)

    def folder(self, name: str) -> str:
        path = f"{self.root}/{name}"
        self._fs(path, lambda fs, p: fs.mkdirs(p))
        return path

    def write(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        """Writes ``df`` as Parquet and returns the table read back."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs(t._scratch_path, lambda fs, p: fs.delete(p, True))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside one expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_CLASS + "+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
