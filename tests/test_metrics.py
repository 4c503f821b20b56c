import pytest
from pyspark.sql import functions as F

from apportion.functions import batch_latency_ms, or_zero, percent, ratio
from apportion.operators.assign import APPROACHES
from apportion.operators.statistics import gated_statistics, run_statistics
from apportion.operators.tasks import batch_tasks, milestones, run_metrics, with_empty_runs
from apportion.plans import matrix
from apportion.plans.reports import report_lines, title_block


def samples(spark, n):
    return spark.range(n).select(
        F.col("id").alias("ordinal"),
        F.lit(1_000_000).cast("long").alias("service_us"),
        (F.col("id") % 7).alias("cpu_centi"),
        F.lit(50).cast("long").alias("memory_mb"),
    )


def test_guards(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("a"),
        percent(F.lit(1), F.lit(4)).alias("b"),
        batch_latency_ms(F.lit(0), F.lit(5.0)).alias("c"),
        batch_latency_ms(F.lit(256), F.lit(1.0)).alias("d"),
        or_zero(F.lit(None).cast("double")).alias("e"),
    ).first()
    assert tuple(row) == (0.0, 25.0, 0.0, 500.0, 0.0)


def test_all_approaches_score_every_sample(spark):
    runs = run_metrics(batch_tasks(samples(spark, 1000), 1000, [1, 2, 4]), 1.0)
    rows = {(r["approach"], r["workers"]): r for r in runs.collect()}
    assert {r["total_inferences"] for r in rows.values()} == {1000}
    assert rows["uniform", 4]["total_duration"] == 250.0
    # Eight chunks of 128 and fewer, dealt to two workers in turn.
    assert rows["dynamic", 2]["total_duration"] == 512.0
    assert rows["dynamic", 2]["completed_tasks"] == 8
    assert rows["sharded", 1]["throughput"] == 1.0


def test_runs_with_nothing_to_score_are_zero(spark):
    runs = run_metrics(batch_tasks(samples(spark, 0), 0, [2]), 1.0)
    rows = with_empty_runs(runs, APPROACHES, [2]).collect()
    assert len(rows) == 3
    assert all(r["throughput"] == 0.0 and r["total_inferences"] == 0 for r in rows)


def test_milestones(spark):
    tasks = spark.range(101).select(F.lit("x").alias("g"), F.col("id").alias("task_id"))
    tenth = milestones(tasks, ["g"], "task_id", 10)
    assert sorted(r["task_id"] for r in tenth.collect()) == list(range(9, 100, 10))
    fiftieth = milestones(tasks, ["g"], "task_id", 50, at_first=True)
    assert sorted(r["task_id"] for r in fiftieth.collect()) == [0, 50, 100]


RUNS = (
    "approach string, run int, error string, throughput double, latency_ms double, "
    "avg_cpu_percent double, avg_memory_mb double, total_duration double"
)


def test_statistics_skip_missing_metrics(spark):
    runs = spark.createDataFrame(
        [("a", 1, None, 1.0, None, 1.0, 1.0, 1.0), ("a", 2, None, 3.0, None, 1.0, 1.0, 1.0),
         ("a", 3, None, None, None, 1.0, 1.0, 1.0)], RUNS)
    rows = {r["metric"]: r for r in run_statistics(runs).collect()}
    assert "latency_ms" not in rows
    assert (rows["throughput"]["mean"], rows["throughput"]["std"]) == (2.0, 1.0)


def test_only_the_first_run_decides_on_an_error(spark):
    ok = (1.0, 2.0, 3.0, 4.0, 5.0)
    none = (None,) * 5
    runs = spark.createDataFrame(
        [("uniform", 1, None, *ok), ("uniform", 2, "late", *none),
         ("dynamic", 1, "boom", *none), ("dynamic", 2, None, *ok)], RUNS)
    rows = gated_statistics(runs).collect()
    assert {r["approach"] for r in rows if r["error"] is None} == {"uniform"}
    assert [r["error"] for r in rows if r["approach"] == "dynamic"] == ["boom"]
    lines = [r["line"] for r in report_lines(gated_statistics(runs)).orderBy("line_no").collect()]
    assert lines[4].startswith("uniform         1.00            2.00            3.0        4.0")
    assert lines[5].split() == ["dynamic", "ERROR", "ERROR", "ERROR", "ERROR"]
    assert lines[-2:] == ["Error: boom", ""] and "  Median: 5.00" in lines


def test_unlisted_approaches_follow_and_errors_have_a_text(spark):
    ok, none = (1.0, 2.0, 3.0, 4.0, 5.0), (None,) * 5
    runs = spark.createDataFrame(
        [("zigzag", 1, None, *ok), ("dynamic", 1, "  ", *none), ("a new one", 1, None, *ok)], RUNS)
    title = title_block("2024-01-01 00:00:00", "machine", 8, 31.96)
    rows = report_lines(gated_statistics(runs), title=title).orderBy("line_no").collect()
    numbers, lines = [r.line_no for r in rows], [r.line for r in rows]
    assert numbers[0] == 0 and len(set(numbers)) == len(numbers)
    assert lines[:7] == ["=" * 80, "DATA PARTITIONING BENCHMARK REPORT", "=" * 80, "Timestamp: 2024-01-01 00:00:00",
                         "System: machine with 8 CPUs", "Memory: 32.0 GB", ""]
    assert [line.split("  ")[0] for line in lines[11:14]] == ["dynamic", "a new one", "zigzag"] and lines[14] == ""
    titles = [line for line in lines if line.endswith("DETAILS")]
    assert titles == [f"{x} PARTITIONING DETAILS" for x in ("DYNAMIC", "A NEW ONE", "ZIGZAG")]
    assert "Error: Unknown error" in lines


COMBINED = (
    "scope string, approach string, workers int, node string, throughput double, "
    "latency_ms double, cpu_percent double, memory_mb double"
)


def test_speedup_needs_a_baseline(spark):
    rows = [("aggregate", "uniform", 2, "all", 10.0, 0.0, 0.0, 0.0),
            ("aggregate", "uniform", 4, "all", 15.0, 0.0, 0.0, 0.0),
            ("node", "uniform", 4, "0", 99.0, 0.0, 0.0, 0.0),
            ("aggregate", "sharded", 4, "all", 5.0, 0.0, 0.0, 0.0),
            ("aggregate", "dynamic", 2, "all", 0.0, 0.0, 0.0, 0.0),
            ("aggregate", "dynamic", 4, "all", 5.0, 0.0, 0.0, 0.0)]
    combined = spark.createDataFrame(rows, COMBINED)
    got = {(r["approach"], r["workers"]): (r["speedup"], r["efficiency_percent"])
           for r in matrix.speedup(combined, 2).collect()}
    assert got == {("uniform", 2): (1.0, 50.0), ("uniform", 4): (1.5, 37.5),
                   ("dynamic", 2): (0.0, 0.0), ("dynamic", 4): (0.0, 0.0)}
    board = {(r["workers"], r["metric"]): r for r in matrix.scoreboard(combined).collect()}
    assert board[2, "throughput"]["sharded"] == 0.0


def test_scalability_is_null_when_a_side_is_missing(spark):
    rows = [("uniform", 1, 500, 50.0, 10.0), ("uniform", 4, 500, 75.0, 30.0), ("sharded", 4, 500, 1.0, 1.0)]
    summary = spark.createDataFrame(
        rows, "strategy string, workers int, stream_rate int, efficiency double, throughput double")
    got = {r["strategy"]: (r["efficiency_improvement"], r["throughput_improvement"])
           for r in matrix.scalability(summary).collect()}
    assert got == {"uniform": (50.0, 200.0), "sharded": (None, None)}
    pivot = matrix.pivot_strategies(summary, "efficiency").orderBy("workers").first()
    assert (pivot["uniform"], pivot["dynamic"]) == (50.0, None)
    best = matrix.best_by(summary, ["efficiency"]).first()
    assert (best["strategy"], best["workers"], best["value"]) == ("uniform", 4, 75.0)


def test_sweep_and_sizes(spark):
    assert matrix.scalability_sizes(7) == [1, 2, 4] and matrix.scalability_sizes(8)[-1] == 8
    cells = matrix.sweep(spark, a=["x", "y"], b=[1, 2, 3])
    assert sorted((r["a"], r["b"]) for r in cells.collect()) == [(a, b) for a in "xy" for b in (1, 2, 3)]


def test_tags(spark):
    row = matrix.tagged(spark.range(1), {"b": 2, "a": "x"}, "2024-01-01 00:00:00").first()
    assert row["config"] == '{"a":"x","b":2}'


def test_unknown_approach():
    from apportion.operators.assign import check_approach

    with pytest.raises(ValueError):
        check_approach("none")
