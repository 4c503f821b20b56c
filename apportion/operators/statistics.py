"""Statistics over repeated runs, and the rule for approaches that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The measured columns of a run, in report order.
METRICS = ("throughput", "latency_ms", "avg_cpu_percent", "avg_memory_mb", "total_duration")


def run_statistics(runs: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and median per approach and metric.

    ``runs`` has one row per repetition. A repetition that lacks a metric does
    not count for it.
    """
    long = runs.unpivot(["approach"], list(METRICS), "metric", "value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("approach", "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.median("value").alias("median"),
        )
    )


def run_envelope(succeeded: DataFrame, failed: DataFrame) -> DataFrame:
    """Successful and failed runs in one table; failures have only their error."""
    return succeeded.withColumn("error", F.lit(None).cast("string")).unionByName(
        failed, allowMissingColumns=True
    )


def first_run_gate(runs: DataFrame) -> DataFrame:
    """The error an approach reports: that of its first run, or none."""
    return runs.groupBy("approach").agg(
        F.min_by(F.struct("error"), "run")["error"].alias("error"),
        F.count(F.lit(1)).alias("runs"),
    )


def gated_statistics(runs: DataFrame) -> DataFrame:
    """Statistics of approaches whose first run worked, one error row otherwise."""
    gate = first_run_gate(runs)
    passed = gate.filter(F.col("error").isNull()).select("approach")
    statistics = run_statistics(runs.join(passed, "approach", "left_semi"))
    errors = gate.filter(F.col("error").isNotNull()).select("approach", "error")
    return statistics.unionByName(errors, allowMissingColumns=True)
