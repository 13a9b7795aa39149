"""Structured Streaming: continuous scans, report upserts, delivery de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanfold.catalog import Catalogue
from scanfold.operators import rollup
from scanfold.operators.contents import find_once


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files below a path, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def scan_stream(files: DataFrame, rules, out: str, checkpoint: str) -> StreamingQuery:
    """Scan files as they arrive: stateless, one folder per micro-batch, which a replay of it overwrites.

    The equal contents of a batch are scanned once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        scanned = find_once(batch, rules, languages=Catalogue.builtin().languages())
        scanned.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def scanned(spark: SparkSession, out: str) -> DataFrame:
    """What ``scan_stream`` has written, of all batches."""
    return spark.read.parquet(out).drop("batch")


def report_stream(summaries: DataFrame, out: str, checkpoint: str, keys=("org", "repo", "pr_number"),
                  of_batch: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append every micro-batch's pull-request figures to a log, one folder per batch.

    A replayed batch overwrites its own folder, so the log holds each batch
    once.  The files of one scan may come in several batches, so a row is a part
    of a scan; ``latest_reports`` adds the parts up. ``of_batch`` makes the summaries
    of a batch of files, where the stream brings files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parts = rollup.roll_up(of_batch(batch) if of_batch else batch, *keys, "scanned_at")
        parts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return (summaries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_reports(spark: SparkSession, out: str, keys=("org", "repo", "pr_number")) -> DataFrame:
    """The report that replaced all earlier ones, per pull request: all parts of its newest scan."""
    scans = rollup.add_up(spark.read.parquet(f"{out}/batch=*"), *keys, "scanned_at")
    rest = [c for c in scans.columns if c not in keys]
    best = scans.groupBy(*keys).agg(F.max_by(F.struct(*rest), "scanned_at").alias("_r"))
    return best.select(*keys, "_r.*")


def deduplicated_deliveries(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of one event.

    State is keyed by delivery id, so a busy repository does not gather on one
    task, and the watermark bounds how long an id is remembered.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))    # watermarks need an instant
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["delivery_id"])
