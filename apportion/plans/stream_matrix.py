"""Streaming experiments: every strategy, worker count and rate in one job.

Many cells of the matrix share queues, and each distinct queue is scheduled
once. With one worker all strategies give the same queue. Broadcast gives every
worker that same queue again, whatever the worker count. Rates rescale arrivals
without reordering them, so all rates share one sort of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.functions.content import content_hash
from apportion.functions.guards import batch_latency_ms, percent, ratio, throughput, whole
from apportion.operators.assign import STRATEGIES, check_strategy, check_workers
from apportion.operators.queueing import block_rows_for, lane_totals

# The stream's nominal rate and the studied configurations.
BASE_RATE = 500
WORKER_COUNTS = (1, 2, 4)
STREAM_RATES = (100, 250, 500, 750, 1000)

_SHARED = ("shared", 1)
_LANES = ["queue", "lane"]


@dataclass(frozen=True)
class StreamProfile:
    """One row of facts about a whole stream."""

    generated: int
    first_us: int
    last_us: int
    cpu_centi: int
    memory_mb: int

    @property
    def elapsed_us(self) -> int:
        return self.last_us - self.first_us


def profile_stream(samples: DataFrame) -> StreamProfile:
    row = samples.agg(
        F.count(F.lit(1)).alias("generated"),
        F.coalesce(F.min("arrival_us"), F.lit(0)).alias("first_us"),
        F.coalesce(F.max("arrival_us"), F.lit(0)).alias("last_us"),
        F.coalesce(F.sum("cpu_centi"), F.lit(0)).alias("cpu_centi"),
        F.coalesce(F.sum("memory_mb"), F.lit(0)).alias("memory_mb"),
    ).first()
    return StreamProfile(**row.asDict())


def scaled_arrival(arrival_us: Column, first_us: int, rate: int, base_rate: int) -> Column:
    """Arrival when the stream plays at ``rate`` instead of ``base_rate``."""
    return whole((arrival_us - first_us) * base_rate, rate) + first_us


def _queue_of(strategy: str, workers: int) -> tuple[str, int]:
    return _SHARED if workers == 1 or strategy == "dynamic" else (strategy, workers)


def worker_outcomes(
    samples: DataFrame,
    strategies: Sequence[str] = STRATEGIES,
    worker_counts: Sequence[int] = WORKER_COUNTS,
    rates: Sequence[int] = (BASE_RATE,),
    base_rate: int = BASE_RATE,
    profile: StreamProfile | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Enqueued, processed and residual samples of every worker of every cell."""
    strategies = [check_strategy(s) for s in strategies]
    worker_counts = [check_workers(w) for w in worker_counts]
    if not all(rate > 0 for rate in rates) or base_rate <= 0:
        raise ValueError(f"rates must be positive, got {list(rates)} and {base_rate}")
    profile = profile or profile_stream(samples)
    queues = sorted({_queue_of(s, w) for s in strategies for w in worker_counts})
    ids = {queue: i for i, queue in enumerate(queues)}

    def lane_of(queue: tuple[str, int]) -> Column:
        kind, workers = queue
        if queue == _SHARED:
            return F.lit(0)
        source = F.col("seq") if kind == "uniform" else F.col("content_hash")
        return F.pmod(source, F.lit(workers)).cast("int")

    def route(stream: DataFrame) -> DataFrame:
        targets = [
            F.struct(F.lit(ids[q]).alias("queue"), lane_of(q).alias("lane")) for q in queues
        ]
        return stream.select(
            "seq", "arrival_us", "service_us", "block", F.inline(F.array(*targets))
        )

    clocks = {f"at_{rate}": rate for rate in rates}
    first = profile.first_us
    narrow = samples.select(
        "seq", "arrival_us", "service_us", content_hash(F.col("content")).alias("content_hash")
    )
    totals = lane_totals(
        narrow,
        route,
        _LANES,
        {c: scaled_arrival(F.col("arrival_us"), first, r, base_rate) for c, r in clocks.items()},
        {c: first + profile.elapsed_us * base_rate // r for c, r in clocks.items()},
        block_rows or block_rows_for(samples, profile.generated),
    )
    # A small table that depends on the configuration alone.
    cells = samples.sparkSession.createDataFrame(
        [
            (s, w, worker, ids[_queue_of(s, w)], 0 if s == "dynamic" else worker, f"at_{r}", r)
            for s in strategies
            for w in worker_counts
            for r in rates
            for worker in range(w)
        ],
        "strategy string, workers int, worker_id int, queue int, lane int, clock string, "
        "stream_rate int",
    )
    enqueued = F.coalesce("enqueued", F.lit(0)).cast("bigint")
    processed = F.coalesce("processed", F.lit(0)).cast("bigint")
    return cells.join(totals, [*_LANES, "clock"], "left").select(
        "strategy",
        "workers",
        "stream_rate",
        "worker_id",
        enqueued.alias("enqueued"),
        processed.alias("processed"),
        (enqueued - processed).alias("residual"),
    )


def cell_outcomes(outcomes: DataFrame, generated: int) -> DataFrame:
    """Totals per cell. Broadcast counts every copy, so it may exceed 100 %."""
    return (
        outcomes.groupBy("strategy", "workers", "stream_rate")
        .agg(
            F.sum("enqueued").alias("enqueued"),
            F.sum("processed").alias("processed"),
            F.sum("residual").alias("residual"),
        )
        .withColumn("efficiency", percent(F.col("processed"), F.lit(generated)))
    )


def streaming_summary(
    outcomes: DataFrame, profile: StreamProfile, time_scale: float, base_rate: int = BASE_RATE
) -> DataFrame:
    """One row of metrics per cell; ``time_scale`` event-seconds play in one second."""
    generated = F.lit(profile.generated)
    elapsed = (
        F.lit(profile.elapsed_us) * F.lit(base_rate) / F.col("stream_rate") / F.lit(1e6 * time_scale)
    )
    processed = F.col("processed")
    return cell_outcomes(outcomes, profile.generated).select(
        "strategy",
        "workers",
        "stream_rate",
        processed.alias("total_processed"),
        "efficiency",
        elapsed.alias("experiment_time"),
        throughput(processed, elapsed).alias("throughput"),
        batch_latency_ms(processed, elapsed).alias("latency_ms"),
        ratio(F.lit(profile.cpu_centi / 100.0), generated).alias("cpu_percent"),
        ratio(F.lit(float(profile.memory_mb)), generated).alias("memory_mb"),
        percent(ratio(generated, elapsed), F.col("stream_rate")).alias("rate_accuracy"),
    )


def worker_details(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        "strategy",
        "workers",
        "stream_rate",
        "worker_id",
        F.col("processed").alias("processed_samples"),
        F.col("residual").alias("queue_size"),
    )
