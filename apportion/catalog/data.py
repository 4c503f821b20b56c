"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apportion.operators.ordinal import number_rows
from apportion.operators.tasks import batch_tasks, node_metrics, run_metrics
from apportion.plans import documents, matrix
from apportion.plans.stream_matrix import (
    BASE_RATE,
    STREAM_RATES,
    WORKER_COUNTS,
    StreamProfile,
    profile_stream,
    streaming_summary,
    worker_details,
    worker_outcomes,
)
from apportion.session import written
from apportion.sources import event_samples, read_table
from apportion.sources.tables import EVENT_SECONDS_PER_STREAM_SECOND as TIME_SCALE

# A cell below this efficiency counts as a failed run, and so does one that
# processes samples more than once.
LOWEST_EFFICIENCY = 60.0


def numbered_orders(spark: SparkSession, base: str) -> tuple[DataFrame, int]:
    orders = read_table(spark, base, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return number_rows(orders, "o_orderdate", "o_orderkey")


def numbered_events(spark: SparkSession, base: str) -> tuple[DataFrame, int]:
    samples = event_samples(spark, base).select("seq", "service_us", "cpu_centi", "memory_mb")
    return number_rows(samples, "seq")


def event_tasks(spark: SparkSession, base: str, worker_counts=WORKER_COUNTS) -> DataFrame:
    """Tasks of all approaches. Several tables are made of them, and they are a
    small part of the samples, so the samples are read once."""
    numbered, count = numbered_events(spark, base)
    return written(batch_tasks(numbered, count, worker_counts), "tasks")


def combined(spark: SparkSession, base: str) -> DataFrame:
    tasks = event_tasks(spark, base)
    return matrix.combined_results(run_metrics(tasks, TIME_SCALE), node_metrics(tasks, TIME_SCALE))


def stream_matrix(
    spark: SparkSession, base: str, rates
) -> tuple[DataFrame, DataFrame, StreamProfile]:
    """Summary and worker details of the matrix. Its outcomes are a small table
    that both read, so they are written once."""
    samples = event_samples(spark, base)
    profile = profile_stream(samples)
    outcomes = written(worker_outcomes(samples, rates=rates, profile=profile), "outcomes")
    return streaming_summary(outcomes, profile, TIME_SCALE), worker_details(outcomes), profile


def small_matrix(spark: SparkSession, base: str):
    return stream_matrix(spark, base, (BASE_RATE,))


def rated_matrix(spark: SparkSession, base: str):
    return stream_matrix(spark, base, STREAM_RATES)


def experiment_documents(spark: SparkSession, base: str) -> DataFrame:
    return documents.experiment_documents(*small_matrix(spark, base))


def experiment_cells(spark: SparkSession, base: str) -> DataFrame:
    """Cells of the rated matrix, with an error where the run counts as failed."""
    summary, _, _ = rated_matrix(spark, base)
    efficiency = F.col("efficiency")
    return summary.withColumn(
        "error",
        F.when(efficiency > 100.0, "duplicated work").when(
            efficiency < LOWEST_EFFICIENCY, "overloaded"
        ),
    )


def repeated_runs(spark: SparkSession, base: str) -> DataFrame:
    """Cells as repetitions of their strategy, largest configuration first.

    A failed run has no metrics. The window ranks one row per cell.
    """
    order = Window.partitionBy("strategy").orderBy(F.desc("workers"), F.desc("stream_rate"))
    ok = F.col("error").isNull()
    metrics = {
        "throughput": F.col("throughput"),
        "latency_ms": F.col("latency_ms"),
        "avg_cpu_percent": F.col("cpu_percent"),
        "avg_memory_mb": F.col("memory_mb"),
        "total_duration": F.col("experiment_time"),
    }
    return experiment_cells(spark, base).select(
        F.col("strategy").alias("approach"),
        F.row_number().over(order).alias("run"),
        "error",
        *[F.when(ok, value).alias(name) for name, value in metrics.items()],
    )
