"""Streaming experiments as nested documents, and back to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.functions.guards import or_zero, ratio
from apportion.plans.stream_matrix import StreamProfile


def experiment_documents(
    summary: DataFrame, details: DataFrame, profile: StreamProfile
) -> DataFrame:
    """One document per cell; its worker list is as long as the worker count."""
    cell = ["strategy", "workers", "stream_rate"]
    workers = details.groupBy(*cell).agg(
        F.sort_array(
            F.collect_list(F.struct("worker_id", "processed_samples", "queue_size"))
        ).alias("worker_metrics")
    )
    seconds = F.col("experiment_time")
    return summary.join(workers, cell).select(
        "strategy",
        F.col("workers").alias("num_workers"),
        "stream_rate",
        F.lit(None).cast("string").alias("error"),
        F.struct(
            F.col("stream_rate").alias("target_rate"),
            ratio(F.lit(profile.generated), seconds).alias("actual_rate"),
            seconds.alias("elapsed_time"),
            F.lit(profile.generated).cast("bigint").alias("generated_samples"),
            "rate_accuracy",
        ).alias("stream_metrics"),
        "worker_metrics",
        F.struct(
            "throughput",
            "latency_ms",
            F.col("cpu_percent").alias("avg_cpu_percent"),
            F.col("memory_mb").alias("avg_memory_mb"),
            seconds.alias("total_duration"),
            F.col("total_processed").alias("total_inferences"),
        ).alias("overall_metrics"),
        "total_processed",
        "efficiency",
        "experiment_time",
    )


def failed_documents(cells: DataFrame, message: str) -> DataFrame:
    """Records of cells that did not run; merge by name with missing columns."""
    return cells.select(
        "strategy",
        F.col("workers").alias("num_workers"),
        "stream_rate",
        F.lit(message).alias("error"),
        F.lit(0).cast("bigint").alias("total_processed"),
        F.lit(0.0).alias("efficiency"),
    )


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Summary rows of documents that did not fail; missing metrics are zero."""

    def metric(path: str, name: str):
        return or_zero(F.col(path)).alias(name)

    return documents.filter(F.col("error").isNull()).select(
        "strategy",
        F.col("num_workers").alias("workers"),
        "stream_rate",
        "total_processed",
        "efficiency",
        "experiment_time",
        metric("overall_metrics.throughput", "throughput"),
        metric("overall_metrics.latency_ms", "latency_ms"),
        metric("overall_metrics.avg_cpu_percent", "cpu_percent"),
        metric("overall_metrics.avg_memory_mb", "memory_mb"),
        metric("stream_metrics.rate_accuracy", "rate_accuracy"),
    )


def flatten_workers(documents: DataFrame) -> DataFrame:
    return (
        documents.filter(F.col("error").isNull())
        .select(
            "strategy",
            F.col("num_workers").alias("workers"),
            "stream_rate",
            F.explode("worker_metrics").alias("w"),
        )
        .select("strategy", "workers", "stream_rate", "w.*")
    )
