"""Rates of a stream: due times, lag, and how closely a target rate is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.guards import percent, ratio, whole


def schedule(samples: DataFrame, start_us: int, rate: int, time_scale: int = 1) -> DataFrame:
    """When each sample is due at ``rate`` samples a second, and how much it is early or late.

    Due times are whole microseconds and never drift, whatever the rate. An early sample waits until it is due; a late one is kept and goes at once.
    """
    if rate < 1 or time_scale < 1:
        raise ValueError(f"rate and time scale must be positive, got {rate} and {time_scale}")
    due = F.lit(start_us) + whole(F.col("seq") * (1_000_000 * time_scale), rate)
    early = due - F.col("arrival_us")
    return samples.select(
        "seq",
        "arrival_us",
        due.alias("due_us"),
        F.greatest(early, F.lit(0)).alias("wait_us"),
        F.greatest(-early, F.lit(0)).alias("lag_us"),
    )


def rate_metrics(samples: DataFrame, target_rate: int, time_scale: float) -> DataFrame:
    """Actual against target rate; no row at all for a stream that never began."""
    totals = samples.agg(
        F.count(F.lit(1)).alias("generated"), (F.max("arrival_us") - F.min("arrival_us")).alias("us")
    ).filter(F.col("generated") > 0)
    elapsed = F.col("us") / (1e6 * time_scale)
    actual = ratio(F.col("generated"), elapsed)
    return totals.select(
        F.lit(target_rate).alias("target_rate"),
        actual.alias("actual_rate"),
        elapsed.alias("elapsed_time"),
        F.col("generated").alias("generated_samples"),
        percent(actual, F.lit(target_rate)).alias("rate_accuracy"),
    )


def completion(samples: DataFrame, max_samples: int) -> DataFrame:
    """Samples a bounded stream emits, and whether it reached its bound."""
    generated = F.least(F.count(F.lit(1)), F.lit(max_samples))
    return samples.agg(
        generated.alias("generated"), (generated >= max_samples).alias("complete")
    )


def sojourn_profile(scheduled: DataFrame, lanes: list[str], bin_us: int, quantile: float) -> DataFrame:
    """Service and sojourn times per lane, with a quantile to a bin's precision.

    The quantile is read from counts per bin, which are combined before the
    shuffle, so no task ever holds the times of a lane.
    """
    sojourn = F.col("finish_us") - F.col("arrival_us")
    bins = (
        scheduled.withColumn("sojourn_us", sojourn)
        .groupBy(*lanes, whole(sojourn, bin_us).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum(F.col("service_us").cast("double")).alias("service_us"),
            F.sum(F.col("sojourn_us").cast("double")).alias("sojourn_us"),
            F.max("sojourn_us").alias("longest_us"),
        )
    )
    # Both windows and the grouping share one shuffle of the bins by lane.
    lane = Window.partitionBy(*lanes)
    upto = lane.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.withColumns(
        {"total": F.sum("samples").over(lane), "seen": F.sum("samples").over(upto)}
    )
    reached = F.col("seen") >= F.ceil(F.col("total") * quantile)
    totals = placed.groupBy(*lanes).agg(
        F.sum("samples").alias("samples"),
        F.sum("service_us").alias("service_us"),
        F.sum("sojourn_us").alias("sojourn_us"),
        F.max("longest_us").alias("longest_us"),
        F.min(F.when(reached, F.col("bin"))).alias("quantile_bin"),
    )
    return totals.select(
        *lanes,
        "samples",
        ratio(F.col("service_us"), F.col("samples")).alias("mean_service_us"),
        ratio(F.col("sojourn_us"), F.col("samples")).alias("mean_sojourn_us"),
        "longest_us",
        "quantile_bin",
    )
