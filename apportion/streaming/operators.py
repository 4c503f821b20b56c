"""Stream operators: routing counts, deduplication and worker backlog."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from apportion.functions.guards import percent, ratio
from apportion.operators.assign import assign
from apportion.operators.queueing import BLOCK_ROWS, schedule_from
from apportion.session import scratch_dir
from apportion.streaming.runner import Positions, run_each_batch


def routed_counts(samples: DataFrame, strategy: str, workers: int, window: str) -> DataFrame:
    """Samples per worker and time window; the state is one row per group."""
    return (
        assign(samples, strategy, workers)
        .groupBy(F.window("arrival", window), "worker")
        .agg(F.count(F.lit(1)).alias("samples"))
        .select(F.unix_micros("window.start").alias("window_us"), "worker", "samples")
    )


def window_counts(window: str, *groups: str) -> Callable[[DataFrame], DataFrame]:
    """Samples per time window and group, for :func:`run_windows` or a batch."""
    return lambda samples: samples.groupBy(F.window("arrival", window), *groups).agg(
        F.count(F.lit(1)).alias("samples")
    )


def windowed_rates(counts: DataFrame, target_rate: int, time_scale: float) -> DataFrame:
    """Actual against target rate of each time window, from its ``samples``."""
    begin, end = F.unix_micros("window.start"), F.unix_micros("window.end")
    seconds = (end - begin) / (1e6 * time_scale)
    actual = ratio(F.col("samples"), seconds)
    return counts.select(
        begin.alias("window_us"),
        F.col("samples").alias("generated_samples"),
        actual.alias("actual_rate"),
        percent(actual, F.lit(target_rate)).alias("rate_accuracy"),
    )


def once_per_sample(samples: DataFrame, delay: str) -> DataFrame:
    """Drop the extra copies that broadcast routing made, within ``delay``."""
    return samples.withWatermark("arrival", delay).dropDuplicatesWithinWatermark(["seq"])


def backlog(
    samples: DataFrame,
    lanes: Sequence[str],
    block_rows: int = BLOCK_ROWS,
    base: str | None = None,
    route: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Start and finish times of routed samples, micro-batch by micro-batch.

    Only the time at which each worker becomes free passes from one micro-batch
    to the next. Within a micro-batch the schedule is the blocked scan of the
    batch operator, so one busy worker does not tie the stream to one task.
    Samples are numbered over the micro-batches and then get their lanes by ``route``; a
    micro-batch that begins before the last one ended is refused. Run again on the
    same ``base`` folder, the stream continues where it stopped.
    """
    spark = samples.sparkSession
    base = base or scratch_dir(spark, "backlog")
    out, state = f"{base}/rows", f"{base}/state"
    positions = Positions(f"{base}/positions")
    free_schema = ", ".join(f"{lane} int" for lane in lanes) + ", free_at bigint"

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id == 0:
            free = session.createDataFrame([], free_schema)
        else:
            free = session.read.schema(free_schema).parquet(f"{state}/{batch_id - 1}")
        routed = route(positions.number(batch, batch_id))
        waiting = routed.join(free, list(lanes), "left")
        scheduled = schedule_from(waiting, lanes, block_rows, F.col("free_at"))
        part = f"{out}/micro_batch={batch_id}"
        scheduled.drop("free_at").write.mode("overwrite").parquet(part)
        finished = session.read.schema(scheduled.drop("free_at").schema).parquet(part)
        (
            finished.select(*lanes, F.col("finish_us").alias("free_at"))
            .unionByName(free)
            .groupBy(*lanes)
            .agg(F.max("free_at").alias("free_at"))
            .write.mode("overwrite")
            .parquet(f"{state}/{batch_id}")
        )

    run_each_batch(samples, step, f"{base}/checkpoint")
    schema = route(spark.createDataFrame([], samples.schema)).schema
    schema = schema.add("start_us", LongType()).add("finish_us", LongType())
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException:  # a stream that never had a micro-batch
        return spark.createDataFrame([], schema)
