"""First-in-first-out queues of logical workers, in event time.

A worker takes samples in ``seq`` order; each waits for its own arrival and for
the sample before it. With ``done`` the running service total of the lane,

    finish = done + max over earlier rows of (arrival - done before that row)

which is two window aggregates. A lane may hold the whole stream, so the scan
runs in two levels: inside blocks of bounded length, then over one row per
block. A block turns the time ``x`` at which its worker becomes free into
``max(x + work, idle_finish)``, and such maps compose.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.guards import whole
from apportion.session import written

BLOCK_ROWS = 1 << 16
MIN_BLOCK_ROWS = 1 << 10
MAX_BLOCKS = 1 << 20
# Block totals may exceed 64 bits of microseconds long before row values do.
_WIDE = "decimal(38,0)"


def block_rows_for(samples: DataFrame, count: int) -> int:
    """Blocks short enough to occupy every task. They only grow past the usual
    length when a lane would have too many of them for the second level."""
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = max(MIN_BLOCK_ROWS, min(BLOCK_ROWS, count // (4 * tasks)))
    return max(usual, -(-count // MAX_BLOCKS))


def blocks_of(samples: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut a stream by ``seq`` and send every block to one task.

    All later windows and groupings include ``block``, so this is the only
    shuffle of the stream, and hot lanes cannot unbalance it.
    """
    return samples.withColumn("block", whole(F.col("seq"), block_rows)).repartition("block")


def local_schedule(
    blocked: DataFrame, lanes: Sequence[str], arrivals: dict[str, Column]
) -> DataFrame:
    """Schedule each block as if its worker had been idle before.

    ``arrivals`` names one or more arrival clocks that keep the row order; they
    share the sort and the running service total ``done_us``. For each clock
    ``c`` the column ``c_start`` is the start of the row in that schedule.
    """
    inside = (
        Window.partitionBy("block", *lanes)
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = F.col("done_us") - F.col("service_us")
    scheduled = blocked.withColumn("done_us", F.sum("service_us").over(inside))
    idle = {name: F.max(clock - before).over(inside) for name, clock in arrivals.items()}
    return scheduled.withColumns({f"{name}_start": before + top for name, top in idle.items()})


def block_carry(
    local: DataFrame, lanes: Sequence[str], clocks: Sequence[str], free_at: Column | None = None
) -> DataFrame:
    """One row per lane and block, with the time its worker becomes free for it.

    ``c_carry`` is null when nothing ran before. ``free_at`` gives the time a
    lane was free before the first block, for streams processed in pieces.
    """
    last = {f"{c}_last": F.max(f"{c}_start") for c in clocks}
    first = {f"{c}_first": F.min(f"{c}_start") for c in clocks}
    finish = {f"{c}_finish": F.max(F.col(f"{c}_start") + F.col("service_us")) for c in clocks}
    extra = {} if free_at is None else {"free_at": F.max(free_at)}
    summary = {
        "rows": F.count(F.lit(1)),
        "work": F.sum("service_us"),
        "lead": F.max(F.col("done_us") - F.col("service_us")),
    }
    columns = {**summary, **last, **first, **finish, **extra}
    blocks = local.groupBy("block", *lanes).agg(*[c.alias(name) for name, c in columns.items()])
    upto = Window.partitionBy(*lanes).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*lanes).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    through = F.sum(F.col("work").cast(_WIDE)).over(upto).cast(_WIDE)
    blocks = blocks.withColumn("through", through)
    work_before = F.col("through") - F.col("work")
    for clock in clocks:
        offset = F.max(F.col(f"{clock}_finish").cast(_WIDE) - F.col("through")).over(earlier)
        if free_at is not None:
            offset = F.greatest(offset, F.col("free_at").cast(_WIDE))
        blocks = blocks.withColumn(f"{clock}_carry", (offset + work_before).cast(_WIDE))
    return blocks


def fifo_schedule(
    routed: DataFrame, lanes: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``start_us`` and ``finish_us`` to every routed sample."""
    return schedule_from(routed, lanes, block_rows, None)


def schedule_from(
    routed: DataFrame, lanes: Sequence[str], block_rows: int, free_at: Column | None
) -> DataFrame:
    """As :func:`fifo_schedule`, from workers that are busy until ``free_at``."""
    # Two steps read the blocks: written once, they cost one scan, shuffle and sort of the stream.
    local = written(
        local_schedule(blocks_of(routed, block_rows), lanes, {"own": F.col("arrival_us")}), "blocks"
    )
    # One small row per lane and block, computed once; then one row per block,
    # so that the samples are joined where they already are.
    carry = written(
        block_carry(local, lanes, ["own"], free_at).select(*lanes, "block", "own_carry"), "carry"
    )
    by_lane = carry.groupBy("block").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct(*lanes), F.col("own_carry").cast("bigint")))
        ).alias("carries")
    )
    joined = local.join(by_lane, "block")
    mine = F.element_at("carries", F.struct(*lanes))
    after_carry = mine + F.col("done_us") - F.col("service_us")
    return (
        joined.withColumn("start_us", F.greatest("own_start", after_carry))
        .withColumn("finish_us", F.col("start_us") + F.col("service_us"))
        .drop("block", "done_us", "own_start", "carries")
    )


def lane_totals(
    samples: DataFrame,
    route: Callable[[DataFrame], DataFrame],
    lanes: Sequence[str],
    arrivals: dict[str, Column],
    stops: dict[str, int],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per lane and clock: samples enqueued, and those started before the stop.

    Start times never fall along a lane. A block whose last row starts in time
    counts whole and one whose first row is late counts nothing, so only the
    block that the stop time cuts through is looked at row by row. There is at
    most one of those per lane and clock, however long the stream.
    """
    clocks = list(arrivals)

    def scheduled(part: DataFrame) -> DataFrame:
        return local_schedule(route(blocks_of(part, block_rows)), lanes, arrivals)

    # One row per lane and block: small, and needed twice below.
    carry = written(block_carry(scheduled(samples), lanes, clocks), "block-carry")
    blocks = _block_clocks(carry, lanes, stops)
    first = F.greatest("first_start", "carry")
    last = F.greatest("last_start", F.col("carry") + F.col("lead"))
    in_time = last < F.col("stop")
    counted = blocks.select(
        *lanes,
        "clock",
        F.col("rows").alias("enqueued"),
        F.when(in_time, F.col("rows")).otherwise(F.lit(0)).alias("processed"),
    )

    cut = blocks.filter(~in_time & (first < F.col("stop")))
    # At most one row per lane and clock; the ranges reach the scan as filters.
    cut_blocks = sorted({row["block"] for row in cut.select("block").distinct().collect()})
    if cut_blocks:
        in_cut = reduce(
            Column.__or__,
            [
                F.col("seq").between(block * block_rows, (block + 1) * block_rows - 1)
                for block in cut_blocks
            ],
        )
        start = F.map_from_arrays(
            F.array(*[F.lit(c) for c in clocks]),
            F.array(*[F.col(f"{c}_start") for c in clocks]),
        )
        work_before = F.col("done_us") - F.col("service_us")
        actual = F.greatest(F.element_at(start, F.col("clock")), F.col("carry") + work_before)
        cut_counts = (
            scheduled(samples.filter(in_cut))
            .join(cut.select(*lanes, "block", "clock", "stop", "carry"), [*lanes, "block"])
            .filter(actual < F.col("stop"))
            .groupBy(*lanes, "clock")
            .agg(F.lit(0).cast("bigint").alias("enqueued"), F.count(F.lit(1)).alias("processed"))
        )
        counted = counted.unionByName(cut_counts)
    return counted.groupBy(*lanes, "clock").agg(
        F.sum("enqueued").alias("enqueued"), F.sum("processed").alias("processed")
    )


def _block_clocks(blocks: DataFrame, lanes: Sequence[str], stops: dict[str, int]) -> DataFrame:
    """One row per lane, block and clock."""
    per_clock = [
        F.struct(
            F.lit(clock).alias("clock"),
            F.lit(stop).cast("bigint").alias("stop"),
            F.col(f"{clock}_first").alias("first_start"),
            F.col(f"{clock}_last").alias("last_start"),
            # A worker that is busy past the stop starts nothing more, so the
            # carry need not be told apart beyond it.
            F.when(F.col(f"{clock}_carry") > stop, F.lit(stop))
            .otherwise(F.col(f"{clock}_carry"))
            .cast("bigint")
            .alias("carry"),
        )
        for clock, stop in stops.items()
    ]
    return blocks.select(*lanes, "block", "rows", "lead", F.inline(F.array(*per_clock)))
