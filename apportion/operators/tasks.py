"""Tasks: what one worker scores in one piece, and what was measured of it.

A task row carries ``rows``, ``busy_us`` and sums and counts of the readings
taken while it ran. Busy time is summed as a double: exact while totals stay
under 2**53 microseconds, and free of overflow beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.functions.guards import batch_latency_ms, or_zero, ratio, throughput, whole
from apportion.operators.assign import check_workers, contiguous_part, rank_of
from apportion.operators.prefix import running_sum

# Ranks take a reading on every tenth batch; progress is noted on
# every tenth chunk, fifth shard and fiftieth batch.
READING_EVERY = 10
CHUNKS_PER_NOTE = 10
SHARDS_PER_NOTE = 5
BATCHES_PER_NOTE = 50

_KEYS = ["approach", "workers", "worker", "task_id"]


def _target(approach, workers, worker, task, sampled) -> Column:
    return F.struct(
        F.lit(approach).alias("approach"),
        F.lit(workers).cast("int").alias("workers"),
        worker.cast("int").alias("worker"),
        task.cast("bigint").alias("task_id"),
        sampled.alias("sampled"),
    )


def _slices(count: int, workers: int, batch_size: int, num_shards: int | None) -> list[Column]:
    """Where the uniform and the sharded approach put a row."""
    check_workers(workers)
    ordinal = F.col("ordinal")
    rank = rank_of(ordinal, workers, batch_size, count)
    shards = num_shards or workers
    shard = contiguous_part(ordinal, F.lit(count), shards)
    sampled = whole(ordinal, batch_size) % READING_EVERY == 0
    return [
        _target("uniform", workers, rank, rank, sampled),
        _target("sharded", workers, shard % workers, shard, F.lit(True)),
    ]


def assigned_rows(
    numbered: DataFrame,
    count: int,
    worker_counts: Sequence[int],
    batch_size: int = 128,
    chunk_size: int = 128,
    num_shards: int | None = None,
) -> DataFrame:
    """Every row once per approach and worker count, with its worker and task.

    For measuring real runs, where each configuration has to score the rows.
    """
    targets = []
    for workers in worker_counts:
        chunk = whole(F.col("ordinal"), chunk_size)
        targets += _slices(count, workers, batch_size, num_shards)
        targets.append(_target("dynamic", workers, chunk % workers, chunk, F.lit(True)))
    return numbered.select("*", F.inline(F.array(*targets)))


def batch_tasks(
    numbered: DataFrame,
    count: int,
    worker_counts: Sequence[int],
    batch_size: int = 128,
    chunk_size: int = 128,
    num_shards: int | None = None,
) -> DataFrame:
    """Tasks of all three batch approaches for every worker count, in one pass.

    uniform   one task per rank, over its slice of every mini-batch
    dynamic   one task per fixed-size chunk, dealt out in turn
    sharded   one task per contiguous shard (one per worker unless given)

    Chunks do not depend on the worker count, so they are summed once and only
    their totals are repeated for each count. Sums are combined before the
    shuffle, which therefore carries tasks rather than samples.
    """
    # A chunk has no worker yet: it is dealt out below, for each worker count.
    chunk = whole(F.col("ordinal"), chunk_size)
    targets = [_target("dynamic", None, F.lit(None), chunk, F.lit(True))]
    for workers in worker_counts:
        targets += _slices(count, workers, batch_size, num_shards)

    reading = F.col("sampled")
    tasks = (
        numbered.select(
            "service_us", "cpu_centi", "memory_mb", F.inline(F.array(*targets))
        )
        .groupBy(*_KEYS)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("service_us").cast("double")).alias("busy_us"),
            F.sum(F.when(reading, F.col("cpu_centi")).otherwise(0)).alias("cpu_centi"),
            F.sum(F.when(reading, F.col("memory_mb")).otherwise(0)).alias("memory_sum"),
            F.count_if(reading).alias("readings"),
        )
    )
    dealt = F.col("approach") == "dynamic"
    counts = F.when(dealt, F.array(*[F.lit(w) for w in worker_counts])).otherwise(
        F.array("workers")
    )
    dealt_to = F.pmod(F.col("task_id"), F.col("workers")).cast("int")
    return (
        tasks.withColumn("workers", F.explode(counts))
        .withColumn("worker", F.coalesce("worker", dealt_to))
        .withColumn("cpu_usage", ratio(F.col("cpu_centi") / 100.0, F.col("readings")))
        .withColumn("memory_usage", ratio(F.col("memory_sum"), F.col("readings")))
        .select(*_KEYS, "rows", "busy_us", "cpu_usage", "memory_usage")
    )


def task_results(tasks: DataFrame, time_scale: float) -> DataFrame:
    """Tasks as result records, with the worker's running inference count."""
    counted = running_sum(
        tasks, ["approach", "workers", "worker"], "task_id", "rows", "total_inferences"
    )
    return counted.select(
        "approach",
        "workers",
        F.col("worker").alias("worker_id"),
        "task_id",
        F.col("rows").alias("batch_size"),
        (F.col("busy_us") / (1e6 * time_scale)).alias("inference_time"),
        "total_inferences",
        "cpu_usage",
        "memory_usage",
    )


def node_metrics(tasks: DataFrame, time_scale: float) -> DataFrame:
    """One metrics row per task. A rank reports its latency per reporting batch,
    a chunk or shard reports the whole time it took."""
    seconds = F.col("busy_us") / (1e6 * time_scale)
    uniform = F.col("approach") == "uniform"
    return tasks.select(
        "approach",
        "workers",
        F.when(uniform, F.col("worker")).alias("rank"),
        F.when(F.col("approach") == "dynamic", F.col("worker")).alias("actor_id"),
        F.when(F.col("approach") == "sharded", F.col("worker")).alias("worker_id"),
        "task_id",
        throughput(F.col("rows"), seconds).alias("throughput"),
        F.when(uniform, batch_latency_ms(F.col("rows"), seconds))
        .otherwise(seconds * 1000.0)
        .alias("latency_ms"),
        F.col("cpu_usage").alias("avg_cpu_percent"),
        F.col("memory_usage").alias("avg_memory_mb"),
        seconds.alias("total_duration"),
        F.col("rows").alias("total_inferences"),
    )


def run_metrics(tasks: DataFrame, time_scale: float) -> DataFrame:
    """One metrics row per run.

    Workers run side by side, so a run lasts as long as its busiest worker.
    Readings are averaged over tasks without weights.
    """
    per_worker = tasks.groupBy("approach", "workers", "worker").agg(
        F.sum("rows").alias("rows"),
        F.sum("busy_us").alias("busy_us"),
        F.sum("cpu_usage").alias("cpu"),
        F.sum("memory_usage").alias("memory"),
        F.count(F.lit(1)).alias("tasks"),
    )
    per_run = per_worker.groupBy("approach", "workers").agg(
        F.sum("rows").alias("rows"),
        F.max("busy_us").alias("busy_us"),
        F.sum("busy_us").alias("all_busy_us"),
        F.sum("cpu").alias("cpu"),
        F.sum("memory").alias("memory"),
        F.sum("tasks").alias("tasks"),
        F.count(F.lit(1)).alias("busy_workers"),
    )
    seconds = F.col("busy_us") / (1e6 * time_scale)
    return per_run.select(
        "approach",
        "workers",
        throughput(F.col("rows"), seconds).alias("throughput"),
        batch_latency_ms(F.col("rows"), seconds).alias("latency_ms"),
        ratio(F.col("cpu"), F.col("tasks")).alias("avg_cpu_percent"),
        ratio(F.col("memory"), F.col("tasks")).alias("avg_memory_mb"),
        seconds.alias("total_duration"),
        F.col("rows").alias("total_inferences"),
        (F.col("all_busy_us") / (1e6 * time_scale)).alias("total_inference_time"),
        F.col("tasks").alias("completed_tasks"),
        "busy_workers",
    )


def with_empty_runs(
    metrics: DataFrame, approaches: Sequence[str], worker_counts: Sequence[int]
) -> DataFrame:
    """A run that scored nothing still reports, with zero in every metric."""
    runs = metrics.sparkSession.createDataFrame(
        [(a, w) for a in approaches for w in worker_counts], "approach string, workers int"
    )
    values = [c for c in metrics.columns if c not in ("approach", "workers")]
    return runs.join(metrics, ["approach", "workers"], "left").select(
        "approach",
        "workers",
        *[or_zero(F.col(c)).cast(metrics.schema[c].dataType).alias(c) for c in values],
    )


def milestones(
    tasks: DataFrame, group: list[str], order: str, every: int, at_first: bool = False
) -> DataFrame:
    """Every ``every``-th completed task of a group, in task order.

    With ``at_first`` the first task is noted, then every ``every``-th after it.
    """
    counted = running_sum(
        tasks.withColumn("__one", F.lit(1)), group, order, "__one", "completed"
    ).drop("__one")
    done = F.col("completed") - (1 if at_first else 0)
    return counted.filter(done % every == 0)


def systematic_readings(batched: DataFrame, every: int = READING_EVERY) -> DataFrame:
    """Mean readings over every ``every``-th batch."""
    return batched.filter(F.col("batch_id") % every == 0).agg(
        F.count(F.lit(1)).alias("readings"),
        ratio(F.sum("cpu_centi") / 100.0, F.count(F.lit(1))).alias("avg_cpu_percent"),
        ratio(F.sum("memory_mb"), F.count(F.lit(1))).alias("avg_memory_mb"),
    )
