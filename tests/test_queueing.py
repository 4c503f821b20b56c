import random

import pytest
from pyspark.sql import functions as F

from apportion.operators.assign import STRATEGIES, assign
from apportion.operators.prefix import running_sum
from apportion.operators.queueing import fifo_schedule
from apportion.plans.stream_matrix import (
    WORKER_COUNTS,
    cell_outcomes,
    profile_stream,
    worker_details,
    worker_outcomes,
)
from apportion.sources import event_samples


def stream(spark, n, slow, seed=3):
    """A random stream; content repeats, and a third of it is the same."""
    rng = random.Random(seed)
    arrival, rows = 1_000, []
    for seq in range(n):
        arrival += rng.randrange(0, 50)
        content = "hot" if rng.random() < 1 / 3 else str(rng.randrange(n))
        rows.append((seq, arrival, rng.randrange(0, slow), content, 100, 7))
    return spark.createDataFrame(
        rows,
        "seq long, arrival_us long, service_us long, content string, cpu_centi long, memory_mb long",
    )


def simulate(rows):
    """Worker by worker, sample by sample."""
    free, schedule = {}, {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        start = max(row["arrival_us"], free.get(row["worker"], 0))
        free[row["worker"]] = start + row["service_us"]
        schedule[row["worker"], row["seq"]] = (start, free[row["worker"]])
    return schedule


@pytest.mark.parametrize("slow", [20, 120])
@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("block_rows", [16, 1 << 16])
def test_schedule_matches_a_sequential_queue(spark, slow, strategy, block_rows):
    routed = assign(stream(spark, 400, slow), strategy, 3)
    expected = simulate(routed.collect())
    scheduled = fifo_schedule(routed, ["worker"], block_rows)
    got = {(r["worker"], r["seq"]): (r["start_us"], r["finish_us"]) for r in scheduled.collect()}
    assert got == expected


@pytest.mark.parametrize("slow", [20, 60, 300])
@pytest.mark.parametrize("block_rows", [16, 128])
def test_outcomes_match_a_sequential_queue(spark, slow, block_rows):
    samples = stream(spark, 500, slow)
    profile = profile_stream(samples)
    rates = (250, 500, 900)
    outcomes = worker_outcomes(samples, rates=rates, profile=profile, block_rows=block_rows)
    got = {
        (r["strategy"], r["workers"], r["stream_rate"], r["worker_id"]): (
            r["enqueued"],
            r["processed"],
            r["residual"],
        )
        for r in outcomes.collect()
    }
    expected = {}
    for strategy in STRATEGIES:
        for workers in WORKER_COUNTS:
            routed = [r.asDict() for r in assign(samples, strategy, workers).collect()]
            for rate in rates:
                at = lambda us: (us - profile.first_us) * 500 // rate + profile.first_us
                stop = profile.first_us + profile.elapsed_us * 500 // rate
                rows = [{**r, "arrival_us": at(r["arrival_us"])} for r in routed]
                schedule = simulate(rows)
                for worker in range(workers):
                    starts = [s for (w, _), (s, _) in schedule.items() if w == worker]
                    done = sum(s < stop for s in starts)
                    cell = (strategy, workers, rate, worker)
                    expected[cell] = (len(starts), done, len(starts) - done)
    assert got == expected


def test_flagship_golden_table(spark):
    samples = event_samples(spark, "/root/testdata/sf0.01")
    cells = cell_outcomes(worker_outcomes(samples, block_rows=1024), 10_000)
    got = {
        (r["strategy"], r["workers"]): (r["enqueued"], r["processed"], r["efficiency"])
        for r in cells.collect()
    }
    assert got == {
        ("uniform", 1): (10_000, 5_221, 52.21),
        ("uniform", 2): (10_000, 9_987, 99.87),
        ("uniform", 4): (10_000, 9_999, 99.99),
        ("dynamic", 1): (10_000, 5_221, 52.21),
        ("dynamic", 2): (20_000, 10_442, 104.42),
        ("dynamic", 4): (40_000, 20_884, 208.84),
        ("sharded", 1): (10_000, 5_221, 52.21),
        ("sharded", 2): (10_000, 9_988, 99.88),
        ("sharded", 4): (10_000, 9_999, 99.99),
    }


def test_totals_beyond_64_bits_of_microseconds(spark):
    """Block totals add up past a bigint; what starts in time is still exact."""
    huge = 1 << 60
    samples = spark.range(64).select(
        F.col("id").alias("seq"),
        (F.col("id") * 10).alias("arrival_us"),
        F.when(F.col("id") < 4, 1).otherwise(F.lit(huge)).alias("service_us"),
        F.lit("x").alias("content"),
        F.lit(0).alias("cpu_centi"),
        F.lit(0).alias("memory_mb"),
    )
    outcomes = worker_outcomes(samples, ["uniform"], [1], block_rows=4)
    assert [r["processed"] for r in outcomes.collect()] == [5]


def test_empty_stream(spark):
    samples = stream(spark, 10, 5).filter("seq < 0")
    details = worker_details(worker_outcomes(samples))
    assert {r["processed_samples"] for r in details.collect()} == {0}
    assert details.count() == 3 * (1 + 2 + 4)


def test_stream_is_shuffled_once_and_by_block(spark):
    samples = stream(spark, 100, 5)
    scheduled = fifo_schedule(assign(samples, "uniform", 2), ["worker"], 16)
    plan = scheduled._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_running_sum_over_hot_group(spark, block_rows):
    rows = [("hot" if i % 3 else f"g{i}", i, i * i) for i in range(300)]
    table = spark.createDataFrame(rows, "g string, i long, v long")
    expected, totals = {}, {}
    for g, i, v in rows:
        totals[g] = totals.get(g, 0) + v
        expected[i] = totals[g]
    got = running_sum(table, ["g"], "i", "v", "total", block_rows)
    assert {r["i"]: r["total"] for r in got.collect()} == expected
