"""Archives that arrive in a folder, as a stream into the fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..shared import folder_names

FACT_SCHEMA = "shard_id string, filename string, size_bytes long, relation string, row string"


def watch_facts(spark: SparkSession, path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Adds tagged fact rows that appear under ``path`` to the store, each shard once.

    A shard's rows may come in several batches: it is complete once the store holds as many as its row in
    relation shards says (or one of relation failed), and what comes for it later is another delivery, which is
    left out. A batch that brings a shard several times keeps it once; rows that a shard holds twice stay two.
    A batch owns a folder and overwrites it, so one that runs again after a failure leaves no second copy.

    Beside the facts a small table, _shards, says for each batch how many rows of a shard it kept and how many the shard has, so a batch costs what it brings and a row
    for each shard that is known, not the store."""

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        told = "shard_id string, kept long, facts long, batch long"
        names = folder_names(session, f"{store}/_shards")
        before = session.read.schema(told).parquet(f"{store}/_shards") if names else session.createDataFrame([], told)
        before = before.where(F.col("batch") < number).groupBy("shard_id").agg(F.sum("kept").alias("kept"), F.max("facts").alias("facts"))
        facts = F.max(F.when(F.col("relation") == "shards", F.get_json_object("row", "$.facts").cast("long")).when(F.col("relation") == "failed", F.lit(1)))
        here = batch.groupBy("shard_id").agg(F.count(F.lit(1)).alias("come"), facts.alias("told"))
        sizes = here.join(before, "shard_id", "left").withColumn("facts", F.greatest("facts", "told"))
        open_ = sizes.where(F.coalesce(F.col("kept") < F.col("facts"), F.lit(True)))  # others are complete
        copies = F.greatest(F.lit(1), F.coalesce(F.expr("cast(come div facts as int)"), F.lit(1)))
        counted = batch.groupBy(*batch.columns).agg(F.count(F.lit(1)).alias("n")).join(open_.select("shard_id", copies.alias("copies")), "shard_id")
        once = counted.select(*batch.columns, F.explode(F.sequence(F.lit(1), F.expr("cast(greatest(1, n div copies) as int)")))).drop("col")
        once.write.mode("overwrite").partitionBy("relation").parquet(f"{store}/batch={number}")
        if not folder_names(session, f"{store}/batch={number}") or open_.isEmpty():
            return
        kept = session.read.schema(FACT_SCHEMA).parquet(f"{store}/batch={number}").groupBy("shard_id").agg(F.count(F.lit(1)).alias("kept"), facts.alias("facts"))
        kept.write.mode("overwrite").parquet(f"{store}/_shards/batch={number}")

    stream = spark.readStream.schema(FACT_SCHEMA).parquet(path)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and time window; rows later than ``late`` no longer count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
