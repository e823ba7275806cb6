"""Micro-batch ingestion and caches with a time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ingest_stream(spark: SparkSession, path: str, schema: str, known: Callable[[], DataFrame], apply: Callable[[DataFrame], None], checkpoint: str, files_per_batch: int = 100):
    """Start a query that hands new or changed rows (ref, content) of each micro-batch to ``apply``.

    A key that comes twice in a batch is taken once; rows whose hash is known are
    left out, so replays change nothing. The trigger takes what is there in bounded
    batches and ends.
    """

    def batch(rows: DataFrame, _: int) -> None:
        latest = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("mtime"), "content"))
        rows = rows.withColumn("rank", latest).filter("rank = 1").drop("rank").withColumn("hash", F.sha2("content", 256))
        apply(rows.join(known().select("ref", "hash"), ["ref", "hash"], "left_anti"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ttl_latest(events: DataFrame, key: str, ttl_minutes: int, most: int | None = None) -> DataFrame:
    """The latest event of each key that is not older than the time to live, seen from the last event.

    With ``most``, only that many keys stay, those first seen last.
    """
    now = events.agg(F.max("ts").alias("now"))
    live = events.join(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr(f"interval {ttl_minutes} minutes"))
    out = live.groupBy(key).agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e"), F.min("ts").alias("first_ts"))
    out = out.select(key, "e.event_id", "e.event_type", "e.ts", "first_ts")
    return out if most is None else out.orderBy(F.desc("first_ts"), key).limit(most)


def failure_runs(events: DataFrame, failed: str, least: int = 3) -> DataFrame:
    """Runs of consecutive failures of a user, by gaps and islands: user_id, run_start, length."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.expr(failed).cast("int")
    rows = events.withColumn("bad", bad).withColumn("island", F.sum(1 - bad).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.filter("bad = 1").groupBy("user_id", "island").agg(F.min("event_id").alias("run_start"), F.count(F.lit(1)).alias("length"))
    return runs.filter(F.col("length") >= least).select("user_id", "run_start", "length")
