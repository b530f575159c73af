"""Streaming ingestion, an extension: a directory of files is chunked, embedded and kept up to date by path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corviq.sources import ingest

CHUNKS = "path string, chunk int, start_line int, end_line int, body string, embedding array<float>"


def files(spark: SparkSession, folder: str, per_trigger: int = ingest.MAX_FILES) -> DataFrame:
    """A stream of (path, text): whole files as they appear, a bounded number a trigger."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def follow(stream: DataFrame, root: str, checkpoint: str, dim: int = 64, ready: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Appends the chunks of each batch of files under ``root``; :func:`current` reads what is in force.

    A batch writes its own chunks and the list of its paths, whatever the table holds already; a batch that is run
    again writes the same, so a restart from the checkpoint is idempotent.
    """

    def step(batch: DataFrame, n: int) -> None:
        latest = batch.groupBy("path").agg(F.max("text").alias("text"))
        none = batch.sparkSession.createDataFrame([], CHUNKS)
        ingest.replace_files(none, latest, dim).write.mode("overwrite").parquet(f"{root}/chunks/v={n}")
        latest.select("path").write.mode("overwrite").parquet(f"{root}/paths/v={n}")
        if ready:
            ready(n, current(batch.sparkSession, root))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of each path as of the last batch that had it; a path whose file became empty has none."""
    last = spark.read.schema("path string, v long").parquet(f"{root}/paths").groupBy("path").agg(F.max("v").alias("v"))
    return spark.read.schema(f"{CHUNKS}, v long").parquet(f"{root}/chunks").join(last, ["path", "v"], "left_semi").drop("v")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Writes what is in force to a new root, as its batch -1; a stream goes on there with its old checkpoint."""
    current(spark, root).write.parquet(f"{target}/chunks/v=-1")
    spark.read.schema("path string").parquet(f"{root}/paths").distinct().write.parquet(f"{target}/paths/v=-1")


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window; rows later than the watermark are dropped, state is bounded."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
