"""Sample tables: ordered scan, first-N, mini-batches and cyclic replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.functions.content import event_content
from apportion.functions.guards import whole
from apportion.operators.ordinal import with_ordinal
from apportion.schemas import TABLES

# How the test stream stands in for a paced image stream. One second of stream
# time is 36 hours of event time, so 30 days of events play in 20 seconds.
EVENT_SECONDS_PER_STREAM_SECOND = 129_600
# Service cost of a sample: ten event-seconds per unit of `value`.
SERVICE_SECONDS_PER_VALUE = 10


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Scan a table under its declared schema, reading only ``columns`` if given."""
    table = spark.read.schema(TABLES[name]).parquet(table_path(base, name))
    return table.select(*columns) if columns else table


def to_event_samples(events: DataFrame) -> DataFrame:
    """Stream samples from ``events`` rows; works on a batch or a stream.

    ``seq`` is the row's id. Where a position is wanted, :func:`event_samples` numbers
    a table's rows, and numbered runs those of a stream.

    Costs and readings are integers (microseconds, hundredths, megabytes), so
    their sums do not depend on the order in which Spark adds them.
    """
    value_cents = F.round(F.col("value") * 100).cast("bigint")
    service = F.round(F.col("value") * SERVICE_SECONDS_PER_VALUE * 1e6).cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("arrival"),
        F.unix_micros("ts").alias("arrival_us"),
        service.alias("service_us"),
        event_content(F.col("event_type"), F.col("value"), F.col("props")).alias("content"),
        (value_cents % 10_000).alias("cpu_centi"),
        (F.col("user_id") + 100).alias("memory_mb"),
        F.col("user_id"),
        F.col("event_type"),
    )


def event_samples(spark: SparkSession, base: str) -> DataFrame:
    """The events as samples; ``seq`` is the position in the order of ids, from 0 without gaps."""
    events = with_ordinal(read_table(spark, base, "events"), "event_id", name="position")
    return to_event_samples(events.withColumn("event_id", F.col("position")))


def vector_samples(spark: SparkSession, base: str) -> DataFrame:
    """Feature vectors with labels: ``sample_id, features, label``."""
    return read_table(spark, base, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").alias("features"),
        F.col("label"),
    )


def image_samples(vectors: DataFrame) -> DataFrame:
    """8-bit pixels from vectors whose elements lie in -1..1."""
    pixels = F.transform(
        "features",
        lambda x: F.least(
            F.greatest(F.floor((x.cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)
        ).cast("int"),
    )
    return vectors.select("sample_id", pixels.alias("pixels"), "label")


def first_n(numbered: DataFrame, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """The first ``limit`` samples in table order, or all when there are fewer."""
    return numbered.filter(F.col(ordinal) < limit)


def mini_batches(numbered: DataFrame, batch_size: int, ordinal: str = "ordinal") -> DataFrame:
    """Add ``batch_id`` and the position inside the batch; the last may be short."""
    if batch_size < 1:
        raise ValueError(f"batch_size must be positive, got {batch_size}")
    index: Column = F.col(ordinal)
    return numbered.withColumn("batch_id", whole(index, batch_size)).withColumn(
        "position", index % batch_size
    )


def cyclic_replay(
    stream: DataFrame, samples: DataFrame, sample_count: int, seq: str = "seq"
) -> DataFrame:
    """Give stream element ``seq`` the sample at ``seq mod sample_count``.

    Batch, or a stream joined to a static table. ``samples`` carries a dense
    ``ordinal``. The join is left to Spark, which broadcasts the samples only
    while they are under its size threshold.
    """
    if sample_count < 1:
        raise ValueError("cannot replay an empty sample table")
    position = F.pmod(F.col(seq), F.lit(sample_count)).alias("ordinal")
    return stream.select("*", position).join(samples, "ordinal")
