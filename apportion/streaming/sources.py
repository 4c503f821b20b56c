"""Streams: a rate-driven source, and tables replayed as streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apportion.schemas import TABLES
from apportion.sources.tables import table_path


def rate_stream(spark: SparkSession, samples_per_second: int, start: datetime | None = None) -> DataFrame:
    """``seq, arrival`` at a fixed total rate, however many workers share it.

    Every micro-batch is one second of event time.
    """
    if samples_per_second < 1:
        raise ValueError(f"rate must be positive, got {samples_per_second}")
    begin = start or datetime(2024, 1, 1, tzinfo=timezone.utc)
    return (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", samples_per_second)
        .option("advanceMillisPerBatch", 1000)
        .option("startTimestamp", int(begin.timestamp() * 1000))
        .load()
        .select(F.col("value").alias("seq"), F.col("timestamp").alias("arrival"))
    )


def table_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    pattern: str | None = None,
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Replay the files of a table, in order of their modification time.

    The table is a file or a folder of parts; with ``pattern``, the files in ``folder`` that
    match. A micro-batch takes files up to ``bytes_per_trigger``, or all there are.
    """
    reader = spark.readStream.schema(TABLES[name])
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_trigger))
    if pattern is not None:
        return reader.option("pathGlobFilter", pattern).parquet(folder)
    return reader.option("recursiveFileLookup", "true").parquet(table_path(folder, name))


def replay_delay(spark: SparkSession, folder: str, name: str, time: str, pattern: str | None = None) -> str:
    """The watermark delay at which a replay of the table drops nothing as late.

    Files are replayed in order of their modification time, so a row is late by at most what
    the latest row of any file up to its own is ahead of it. Files of one modification time come in any
    order and count as one. The times of a file are combined before the shuffle; the
    running maximum is over one row per modification time.
    """
    reader = spark.read.schema(TABLES[name])
    if pattern is not None:
        table = reader.option("pathGlobFilter", pattern).parquet(folder)
    else:
        table = reader.option("recursiveFileLookup", "true").parquet(table_path(folder, name))
    files = table.groupBy(F.col("_metadata.file_modification_time").alias("at")).agg(
        F.min(F.unix_micros(time)).alias("low"), F.max(F.unix_micros(time)).alias("high")
    )
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ahead = files.select((F.max("high").over(before) - F.col("low")).alias("us")).agg(F.max("us")).first()[0]
    # A row at the watermark itself is late already.
    return f"{(0 if ahead is None else ahead // 1000) + 1} milliseconds"


def bounded(stream: DataFrame, max_samples: int) -> DataFrame:
    """Stop emitting once ``max_samples`` samples have been generated.

    ``seq`` is the position of a sample, as numbered runs give it.
    """
    return stream.filter(F.col("seq") < max_samples)
