"""Rules that assign samples to logical workers.

Each rule is arithmetic on columns: a worker is a column value, not a task.
Spark's own partitioning stays free to follow the data. Every rule but
broadcast sends each row to exactly one worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.functions.content import content_shard
from apportion.functions.guards import whole

# The stream strategies and the batch approaches by name.
STRATEGIES = ("uniform", "dynamic", "sharded")
APPROACHES = ("uniform", "dynamic", "sharded")


def check_workers(workers: int) -> int:
    if workers < 1:
        raise ValueError(f"at least one worker is needed, got {workers}")
    return workers


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown partition strategy: {strategy}")
    return strategy


def check_approach(approach: str) -> str:
    if approach not in APPROACHES:
        raise ValueError(f"unknown approach: {approach}")
    return approach


def contiguous_part(index: Column, size: Column, parts: int) -> Column:
    """Part of a row when ``size`` rows are cut into equal runs.

    A remainder goes to the last part, and so does everything when there are
    fewer rows than parts.
    """
    run = whole(size, parts)
    last = F.lit(parts - 1)
    # The inner guard keeps the division valid under ANSI rules.
    part = F.least(whole(index, F.greatest(run, F.lit(1))), last)
    return F.when(run == 0, last).otherwise(part).cast("int")


def rank_slices(numbered: DataFrame, workers: int, batch_size: int, count: int) -> DataFrame:
    """Each mini-batch is cut into one contiguous slice per rank."""
    check_workers(workers)
    return numbered.withColumn("worker", rank_of(F.col("ordinal"), workers, batch_size, count))


def rank_of(ordinal: Column, workers: int, batch_size: int, count: int) -> Column:
    position = ordinal % batch_size
    rows_in_batch = F.least(F.lit(batch_size), F.lit(count) - (ordinal - position))
    return contiguous_part(position, rows_in_batch, workers)


def contiguous_split(numbered: DataFrame, parts: int, count: int, name: str = "worker") -> DataFrame:
    """Equal runs over the whole table, remainder to the last part."""
    check_workers(parts)
    return numbered.withColumn(name, contiguous_part(F.col("ordinal"), F.lit(count), parts))


def ceil_chunks(numbered: DataFrame, parts: int, count: int) -> DataFrame:
    """Runs of ``ceil(count / parts)`` rows; there may be fewer than ``parts``."""
    check_workers(parts)
    run = max(1, -(-count // parts))
    return numbered.withColumn("worker", whole(F.col("ordinal"), run).cast("int"))


def fixed_chunks(numbered: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks of ``chunk_size`` rows with a short tail."""
    if chunk_size < 1:
        raise ValueError(f"chunk_size must be positive, got {chunk_size}")
    return numbered.withColumn("chunk_id", whole(F.col("ordinal"), chunk_size))


def round_robin(tasks: DataFrame, workers: int, task: str = "chunk_id") -> DataFrame:
    """Deal tasks out in turn: task ``i`` goes to worker ``i mod workers``."""
    check_workers(workers)
    return tasks.withColumn("worker", F.pmod(F.col(task), F.lit(workers)).cast("int"))


def sub_chunks(
    sharded: DataFrame, enabled: bool, chunk_size: int, shards: int, count: int
) -> DataFrame:
    """Cut a shard that is longer than ``chunk_size`` into pieces, in row order.

    Expects ``ordinal`` and the ``shard`` of :func:`contiguous_split`. A shard's
    start and length follow from the split rule, so nothing is counted.
    """
    check_workers(shards)
    if chunk_size < 1:
        raise ValueError(f"chunk_size must be positive, got {chunk_size}")
    run = count // shards
    last_length = count - run * (shards - 1)
    length = F.when(F.col("shard") == shards - 1, F.lit(last_length)).otherwise(F.lit(run))
    position = F.col("ordinal") - F.col("shard").cast("bigint") * run
    piece = whole(position, chunk_size)
    oversized = F.lit(enabled) & (length > chunk_size)
    return sharded.withColumn("sub_chunk", F.when(oversized, piece).otherwise(F.lit(0)))


def assign(samples: DataFrame, strategy: str, workers: int) -> DataFrame:
    """Route stream samples by strategy name; batch or streaming input.

    ``uniform`` takes turns by ``seq``, ``sharded`` follows the ``content``, and
    ``dynamic`` gives every worker its own copy.
    """
    check_workers(workers)
    check_strategy(strategy)
    if strategy == "uniform":
        return samples.withColumn("worker", F.pmod(F.col("seq"), F.lit(workers)).cast("int"))
    if strategy == "sharded":
        return samples.withColumn("worker", content_shard(F.col("content"), workers))
    everyone = F.sequence(F.lit(0), F.lit(workers - 1))
    return samples.withColumn("worker", F.explode(everyone))


def lay_out_by_worker(assigned: DataFrame, workers: int, salt: str, tasks: int) -> DataFrame:
    """Bring rows of a worker together physically, before per-task Python work.

    Every worker has tasks of its own, as many as its share of the rows is worth and at least
    one; a row-level salt spreads its rows over them. So no task mixes workers, and a
    worker that owns most of the table is spread over most of the tasks. ``slot`` is
    the row's place among its worker's tasks.
    """
    check_workers(workers)
    # One row per worker.
    found = assigned.groupBy("worker").agg(F.count("*").alias("n")).collect()
    rows = {r.worker: r.n for r in found}
    total, spare = sum(rows.values()), max(0, tasks - len(rows))
    first, slots, at = {}, {}, 0
    for worker in sorted(rows):
        first[worker], slots[worker] = at, 1 + spare * rows[worker] // total
        at += slots[worker]
    if not rows:
        return assigned.withColumn("slot", F.lit(0))
    pick = lambda values: F.element_at(
        F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("worker")
    )
    slot = F.pmod(F.xxhash64(salt), pick(slots)).cast("int")
    return assigned.withColumn("slot", slot).repartitionById(at, pick(first) + F.col("slot"))
