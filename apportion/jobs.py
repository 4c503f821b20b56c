"""Whole studies that read a sample table and leave result files behind."""

from __future__ import annotations

import os
import platform
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion import schemas
from apportion.operators.assign import APPROACHES, STRATEGIES, check_strategy, check_workers
from apportion.operators.ordinal import number_rows
from apportion.operators.scoring import Model, feature_width, measured_tasks, split_faulty
from apportion.operators.statistics import gated_statistics
from apportion.operators.tasks import assigned_rows, batch_tasks, node_metrics, run_metrics
from apportion.plans import matrix
from apportion.plans.documents import experiment_documents, failed_documents, flatten_documents
from apportion.plans.reports import report_lines, title_block
from apportion.plans.stream_matrix import (
    BASE_RATE,
    STREAM_RATES,
    WORKER_COUNTS,
    profile_stream,
    streaming_summary,
    worker_details,
    worker_outcomes,
)
from apportion.session import written
from apportion.sources import (
    append_experiments,
    first_n,
    read_experiments,
    stored_experiments,
    write_csv,
    write_json,
    write_text,
)


def batch_matrix(
    samples: DataFrame,
    key: str,
    out: str,
    sizes: Sequence[int] = WORKER_COUNTS,
    batch_size: int = 128,
    num_samples: int | None = None,
    time_scale: float = 1.0,
) -> DataFrame:
    """Compare the batch approaches: ``combined_results`` and ``speedup_efficiency``."""
    numbered, count = number_rows(samples, key)
    if num_samples is not None:
        numbered, count = first_n(numbered, num_samples), min(count, num_samples)
    tasks = written(batch_tasks(numbered, count, sizes, batch_size, batch_size), "tasks")
    combined = matrix.combined_results(run_metrics(tasks, time_scale), node_metrics(tasks, time_scale))
    write_csv(combined, f"{out}/combined_results")
    write_csv(matrix.speedup(combined, sizes[0]), f"{out}/speedup_efficiency")
    return combined


def streaming_matrix(
    samples: DataFrame,
    out: str,
    strategies: Sequence[str] = STRATEGIES,
    worker_counts: Sequence[int] = WORKER_COUNTS,
    rates: Sequence[int] = STREAM_RATES,
    max_samples: int | None = None,
    time_scale: float = 1.0,
) -> DataFrame:
    """Compare the stream strategies: experiments, summary, details, analysis.

    A failure is recorded for the cells that have no result yet. Wrong settings are
    refused before any job, and a result file that can't be written is an error of its own:
    neither touches stored cells.
    """
    for workers in worker_counts:
        check_workers(workers)
    for strategy in strategies:
        check_strategy(strategy)
    if not all(rate > 0 for rate in rates):
        raise ValueError(f"rates must be positive, got {list(rates)}")
    if time_scale <= 0:
        raise ValueError(f"the time scale must be positive, got {time_scale}")
    spark = samples.sparkSession
    if max_samples is not None:
        samples = samples.filter(F.col("seq") < max_samples)
    store = f"{out}/experiments"
    try:
        profile = profile_stream(samples)
        outcomes = written(
            worker_outcomes(samples, strategies, worker_counts, rates, BASE_RATE, profile), "outcomes"
        )
        summary, details = streaming_summary(outcomes, profile, time_scale), worker_details(outcomes)
        append_experiments(experiment_documents(summary, details, profile), store)
    except Exception as error:
        details = None
        cells = matrix.sweep(
            spark, strategy=list(strategies), workers=list(worker_counts), stream_rate=list(rates)
        )
        known = stored_experiments(spark, store).where("error IS NULL").select(
            "strategy", F.col("num_workers").alias("workers"), "stream_rate"
        )
        missing = cells.join(written(known, "stored"), ["strategy", "workers", "stream_rate"], "left_anti")
        failed = failed_documents(missing, error_text(error))
        empty = spark.createDataFrame([], schemas.EXPERIMENT)
        append_experiments(empty.unionByName(failed, allowMissingColumns=True), store)
    if details is not None:
        write_csv(details, f"{out}/worker_details", skip_empty=True)
    experiments = read_experiments(spark, store)
    write_csv(flatten_documents(experiments), f"{out}/summary")
    write_json(matrix.analysis_document(_flat(experiments)), f"{out}/analysis")
    return experiments


def error_text(error: Exception) -> str:
    """The kind of an error and the last line it has to say."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return f"{type(error).__name__}: {lines[-1] if lines else ''}"


def _flat(experiments: DataFrame) -> DataFrame:
    return experiments.select(
        "strategy",
        F.col("num_workers").alias("workers"),
        "stream_rate",
        "error",
        "efficiency",
        F.col("overall_metrics.throughput").alias("throughput"),
        F.col("stream_metrics.rate_accuracy").alias("rate_accuracy"),
    )


def measured_suite(
    samples: DataFrame,
    load_model: Callable[[], Model],
    out: str,
    workers: int = 4,
    num_runs: int = 3,
    batch_size: int = 128,
    chunk_size: int = 128,
    num_shards: int | None = None,
) -> DataFrame:
    """Score ``sample_id, features`` repeatedly with every approach, for real.

    Runs are repeated because they are measured. Samples that can't be scored are set
    aside in ``quarantine`` with their fault, and the others are scored. Tasks that the model fails
    on are left out of their run and listed in ``failed_tasks``; a run of which no task is left, or that
    fails as a whole, becomes an error record; the statistics and the text report follow the first run.
    """
    check_workers(workers)
    for size in (num_runs, batch_size, chunk_size, 1 if num_shards is None else num_shards):
        if size < 1:
            raise ValueError(f"runs, batches, chunks and shards must be positive, got {size}")
    spark = samples.sparkSession
    good, faulty = split_faulty(samples, feature_width(samples))
    write_json(faulty, f"{out}/quarantine")
    numbered, count = number_rows(good, "sample_id")
    assigned = assigned_rows(numbered, count, [workers], batch_size, chunk_size, num_shards)
    runs = failed = None
    for run in range(1, num_runs + 1):
        for approach in APPROACHES:
            began = time.time()
            mine = assigned.filter(F.col("approach") == approach)
            try:
                tasks = written(measured_tasks(mine, load_model), f"run-{approach}")
                done = tasks.filter(F.col("error").isNull())
                lost = tasks.filter(F.col("error").isNotNull()).withColumn("run", F.lit(run))
                failed = lost if failed is None else failed.unionByName(lost)
                result = run_metrics(done, 1.0).withColumn("error", F.lit(None).cast("string"))
                if done.isEmpty() and not lost.isEmpty():
                    result = lost.groupBy("approach").agg(F.min("error").alias("error"))
            except Exception as error:
                result = spark.createDataFrame(
                    [(approach, error_text(error))],
                    "approach string, error string",
                )
            row = result.withColumns(
                {"run": F.lit(run), "benchmark_duration": F.lit(time.time() - began)}
            )
            empty = spark.createDataFrame([], f"approach string, {schemas.RUN_METRICS}")
            row = empty.unionByName(row, allowMissingColumns=True)
            runs = row if runs is None else runs.unionByName(row, allowMissingColumns=True)
    runs = written(runs, "runs")
    statistics = gated_statistics(runs)
    if failed is not None:
        write_json(failed.select("run", "approach", "workers", "worker", "task_id", "error"), f"{out}/failed_tasks")
    write_json(runs, f"{out}/runs")
    write_json(statistics, f"{out}/statistics")
    memory_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    title = title_block(time.strftime("%Y-%m-%d %H:%M:%S"), platform.platform(), os.cpu_count() or 1, memory_gb)
    write_text(report_lines(statistics, title=title), f"{out}/report")
    return statistics
