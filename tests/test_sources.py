from pyspark.sql import functions as F

from apportion import schemas
from apportion.plans.documents import failed_documents, flatten_documents, flatten_workers
from apportion.plans.matrix import by_strategy, outcome_counts, sweep
from apportion.session import scratch_dir
from apportion.sources import (
    append_experiments,
    cyclic_replay,
    first_n,
    read_csv,
    read_experiments,
    read_table,
    read_text,
    write_csv,
    write_text,
)


def test_missing_csv_is_an_empty_table(spark):
    table = read_csv(spark, scratch_dir(spark, "nowhere"), schemas.WORKER_DETAILS)
    assert table.count() == 0 and table.columns[0] == "strategy"


def test_empty_details_leave_no_file(spark):
    empty = spark.createDataFrame([], schemas.WORKER_DETAILS)
    path = scratch_dir(spark, "empty")
    assert write_csv(empty, path, skip_empty=True) is False
    assert read_csv(spark, path, schemas.WORKER_DETAILS).count() == 0


def documents(spark, strategies, processed):
    cells = sweep(spark, strategy=strategies, workers=[1, 2], stream_rate=[500])
    empty = spark.createDataFrame([], schemas.EXPERIMENT)
    done = cells.select(
        "strategy",
        F.col("workers").alias("num_workers"),
        "stream_rate",
        F.lit(processed).cast("bigint").alias("total_processed"),
        F.lit(50.0).alias("efficiency"),
        F.lit(1.0).alias("experiment_time"),
        F.array(F.struct(F.lit(0).alias("worker_id"), F.lit(processed).cast("bigint").alias(
            "processed_samples"), F.lit(0).cast("bigint").alias("queue_size"))).alias("worker_metrics"),
    )
    return empty.unionByName(done, allowMissingColumns=True)


def test_storing_a_cell_again_replaces_only_that_cell(spark):
    path = scratch_dir(spark, "cells")
    append_experiments(documents(spark, ["uniform", "sharded"], 10), path)
    append_experiments(documents(spark, ["sharded"], 20), path)
    got = {(r["strategy"], r["num_workers"]): r["total_processed"]
           for r in read_experiments(spark, path).collect()}
    assert got == {("uniform", 1): 10, ("uniform", 2): 10, ("sharded", 1): 20, ("sharded", 2): 20}


def test_failed_experiments_are_kept_out_of_summaries(spark):
    failed = failed_documents(sweep(spark, strategy=["dynamic"], workers=[4], stream_rate=[500]), "boom")
    every = documents(spark, ["uniform"], 10).unionByName(failed, allowMissingColumns=True)
    summary = flatten_documents(every)
    assert {r["strategy"] for r in summary.collect()} == {"uniform"}
    # Metrics a document lacks count as zero.
    assert {r["throughput"] for r in summary.collect()} == {0.0}
    assert flatten_workers(every).count() == 2
    flat = every.select("strategy", "efficiency", "error", F.lit(1.0).alias("throughput"),
                        F.lit(None).cast("double").alias("rate_accuracy"))
    assert by_strategy(flat).first()["avg_rate_accuracy"] == 0.0
    assert tuple(outcome_counts(flat).first()) == (2, 1)


def test_report_file_keeps_line_order(spark):
    lines = spark.createDataFrame([(i, f"line {i}") for i in reversed(range(50))], "line_no int, line string")
    path = scratch_dir(spark, "lines")
    write_text(lines, path)
    assert [r["line"] for r in read_text(spark, path).collect()] == [f"line {i}" for i in range(50)]


def test_replay_cycles_and_first_n_is_bounded(spark):
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "ordinal long, name string")
    stream = spark.range(8).withColumnRenamed("id", "seq")
    got = {r["seq"]: r["name"] for r in cyclic_replay(stream, samples, 3).collect()}
    assert got == {i: f"s{i % 3}" for i in range(8)}
    assert first_n(samples, 2).count() == 2 and first_n(samples, 9).count() == 3


def test_scan_reads_only_the_columns_asked_for(spark, sf_dir):
    plan = read_table(spark, sf_dir, "orders", "o_orderkey").filter("o_orderkey < 5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in text and "LessThan(o_orderkey,5)" in text
