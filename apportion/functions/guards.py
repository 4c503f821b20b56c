"""Arithmetic that never divides by zero, and the metrics built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: latency is always reported per this many samples.
REPORT_BATCH = 128


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, or 0.0 unless the denominator is positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def whole(numerator: Column, denominator: Column | int) -> Column:
    """Integer quotient as a bigint, exact beyond the range of doubles."""
    if not isinstance(denominator, Column):
        denominator = F.lit(denominator)
    return F.call_function("div", numerator, denominator)


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100.0), whole)


def or_zero(column: Column) -> Column:
    """A missing measurement counts as zero."""
    return F.coalesce(column, F.lit(0))


def throughput(samples: Column, seconds: Column) -> Column:
    return ratio(samples, seconds)


def batch_latency_ms(samples: Column, seconds: Column) -> Column:
    """Milliseconds per reporting batch, 0.0 when nothing was scored."""
    return F.when(
        samples > 0,
        seconds * F.lit(1000.0) / (samples.cast("double") / F.lit(float(REPORT_BATCH))),
    ).otherwise(F.lit(0.0))
