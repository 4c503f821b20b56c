"""Run and task metrics of the batch approaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.catalog.data import (
    TIME_SCALE,
    event_tasks,
    experiment_cells,
    numbered_events,
    repeated_runs,
)
from apportion.catalog.registry import SAMPLES_SQL, TASK_DECIMALS, query, rounded
from apportion.catalog.sql import (
    experiment_cells_sql,
    nodes_sql,
    repeated_runs_sql,
    rounded_sql,
    runs_sql,
    statistics_sql,
    tasks_sql,
    timed_sql,
)
from apportion.operators.assign import APPROACHES, assign, contiguous_part
from apportion.operators.queueing import fifo_schedule
from apportion.operators.statistics import (
    first_run_gate,
    gated_statistics,
    run_envelope,
    run_statistics,
)
from apportion.operators.tasks import (
    BATCHES_PER_NOTE,
    CHUNKS_PER_NOTE,
    SHARDS_PER_NOTE,
    batch_tasks,
    milestones,
    node_metrics,
    run_metrics,
    systematic_readings,
    task_results,
    with_empty_runs,
)
from apportion.plans.reports import report_lines, title_block
from apportion.plans.stream_matrix import WORKER_COUNTS
from apportion.session import scratch_dir, written
from apportion.sources import event_samples, mini_batches, read_text, write_text

# Shards of the progress notes.
SHARDS = 16

_SECONDS = f"{1e6 * TIME_SCALE}::DOUBLE"
_RUN_DOUBLES = ("throughput", "latency_ms", "avg_cpu_percent", "avg_memory_mb", "total_duration")


@query(
    "a1_run_metrics",
    f"""
    SELECT event_type, count(*) AS total_inferences,
           round(sum(service_us)::DOUBLE / {_SECONDS}, 6) AS total_duration,
           round(count(*) / (sum(service_us)::DOUBLE / {_SECONDS}), 6) AS throughput,
           round(sum(service_us)::DOUBLE / {_SECONDS} * 1000.0 / (count(*) / 128.0), 6) AS latency_ms,
           round(sum(cpu_centi)::DOUBLE / 100.0 / count(*), 6) AS avg_cpu_percent,
           round(sum(memory_mb)::DOUBLE / count(*), 6) AS avg_memory_mb
    FROM ({SAMPLES_SQL}) GROUP BY 1
    """,
)
def run_totals(spark, base):
    """Every event type as a run of its own, scored one sample after another."""
    tasks = event_samples(spark, base).groupBy("event_type").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("service_us").cast("double")).alias("busy_us"),
        (F.sum("cpu_centi") / 100.0 / F.count("*")).alias("cpu_usage"),
        (F.sum("memory_mb") / F.count("*")).alias("memory_usage"),
    )
    one_worker = {"workers": F.lit(1), "worker": F.lit(0)}
    runs = tasks.withColumnRenamed("event_type", "approach").withColumns(one_worker)
    metrics = run_metrics(runs, TIME_SCALE).withColumnRenamed("approach", "event_type")
    return rounded(metrics.select("event_type", "total_inferences", *_RUN_DOUBLES))


@query(
    "a2_node_rows",
    rounded_sql(nodes_sql(), "approach, workers, worker AS node, task_id, total_inferences", _RUN_DOUBLES, TASK_DECIMALS),
)
def node_rows(spark, base):
    nodes = node_metrics(event_tasks(spark, base), TIME_SCALE)
    node = F.coalesce("rank", "actor_id", "worker_id").alias("node")
    return rounded(
        nodes.select("approach", "workers", node, "task_id", "total_inferences", *_RUN_DOUBLES),
        TASK_DECIMALS,
    )


@query(
    "a3_rank_aggregate",
    rounded_sql(runs_sql(), "workers, total_inferences", _RUN_DOUBLES) + " WHERE approach = 'uniform'",
)
def rank_aggregate(spark, base):
    tasks = event_tasks(spark, base).filter(F.col("approach") == "uniform")
    metrics = run_metrics(tasks, TIME_SCALE)
    return rounded(metrics.select("workers", "total_inferences", *_RUN_DOUBLES))


@query(
    "a4_empty_runs",
    "SELECT approach, CAST(workers AS INTEGER) AS workers, CAST(0 AS BIGINT) AS total_inferences, "
    "0.0::DOUBLE AS throughput, 0.0::DOUBLE AS latency_ms, 0.0::DOUBLE AS avg_cpu_percent, "
    "0.0::DOUBLE AS avg_memory_mb, 0.0::DOUBLE AS total_duration "
    "FROM (VALUES ('uniform'), ('dynamic'), ('sharded')) a(approach), (VALUES (1), (2), (4)) w(workers) "
    "WHERE NOT EXISTS (SELECT 1 FROM events WHERE value < 0)",
)
def empty_runs(spark, base):
    """No event has a negative value, so every run has nothing to score."""
    samples = event_samples(spark, base).filter(F.col("service_us") < 0)
    numbered = samples.withColumn("ordinal", F.col("seq"))
    tasks = batch_tasks(numbered, 0, WORKER_COUNTS)
    metrics = with_empty_runs(run_metrics(tasks, TIME_SCALE), APPROACHES, WORKER_COUNTS)
    return metrics.select("approach", "workers", "total_inferences", *_RUN_DOUBLES)


@query(
    "a5_task_aggregate",
    rounded_sql(
        runs_sql(),
        "approach, workers, total_inferences, completed_tasks, busy_workers",
        ("total_inference_time", "avg_cpu_percent", "avg_memory_mb"),
    )
    + " WHERE approach <> 'uniform'",
)
def task_aggregate(spark, base):
    tasks = event_tasks(spark, base).filter(F.col("approach") != "uniform")
    return rounded(
        run_metrics(tasks, TIME_SCALE).select(
            "approach",
            "workers",
            "total_inferences",
            "completed_tasks",
            "busy_workers",
            "total_inference_time",
            "avg_cpu_percent",
            "avg_memory_mb",
        )
    )


@query(
    "a6_cumulative_inferences",
    f"""
    SELECT approach, workers, worker AS worker_id, task_id, rows AS batch_size,
           round(busy_us / {_SECONDS}, {TASK_DECIMALS}) AS inference_time,
           CAST(sum(rows) OVER (PARTITION BY approach, workers, worker ORDER BY task_id) AS BIGINT)
               AS total_inferences,
           round(cpu_usage, {TASK_DECIMALS}) AS cpu_usage,
           round(memory_usage, {TASK_DECIMALS}) AS memory_usage
    FROM ({tasks_sql()})
    """,
)
def cumulative_inferences(spark, base):
    return rounded(task_results(event_tasks(spark, base), TIME_SCALE), TASK_DECIMALS)


@query(
    "a7_actor_totals",
    f"""
    SELECT worker_id AS worker, count(*) AS total_inferences,
           max(start_us + service_us) - min(start_us) AS uptime_us
    FROM ({timed_sql()}) WHERE strategy = 'uniform' AND workers = 4 GROUP BY 1
    """,
)
def actor_totals(spark, base):
    """Inferences of a worker, and the time from its first start to its last finish."""
    samples = event_samples(spark, base).select("seq", "arrival_us", "service_us")
    scheduled = fifo_schedule(assign(samples, "uniform", 4), ["worker"])
    return scheduled.groupBy("worker").agg(
        F.count("*").alias("total_inferences"),
        (F.max("finish_us") - F.min("start_us")).alias("uptime_us"),
    )


@query(
    "a8_milestones",
    f"""
    WITH t AS ({tasks_sql()}),
    c AS (SELECT approach, workers, task_id,
                 row_number() OVER (PARTITION BY approach, workers ORDER BY task_id) AS completed
          FROM t WHERE approach = 'dynamic'),
    o AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS ordinal FROM ({SAMPLES_SQL})),
    b AS (SELECT ordinal // 128 AS task_id, count(*) AS n FROM o GROUP BY 1),
    h AS (SELECT least(ordinal // ((SELECT count(*) FROM o) // 16), 15) AS task_id FROM o GROUP BY 1)
    SELECT 'chunks' AS kind, workers, task_id, completed FROM c WHERE completed % {CHUNKS_PER_NOTE} = 0
    UNION ALL
    SELECT 'shards', CAST(4 AS INTEGER), task_id, task_id + 1 FROM h
    WHERE (task_id + 1) % {SHARDS_PER_NOTE} = 0
    UNION ALL
    SELECT 'batches', CAST(1 AS INTEGER), task_id, task_id + 1 FROM b
    WHERE task_id % {BATCHES_PER_NOTE} = 0
    """,
)
def progress(spark, base):
    """Tenth chunks, fifth shards of sixteen, and every fiftieth batch."""
    numbered, count = numbered_events(spark, base)
    # One pass over the samples: rows per mini-batch and shard, from which all three tables follow.
    shard = contiguous_part(F.col("ordinal"), F.lit(count), SHARDS)
    parts = mini_batches(numbered, 128).groupBy("batch_id", shard.alias("shard")).agg(F.count("*").alias("rows"))
    parts = written(parts, "progress")

    def tasks(approach, workers, task):
        found = parts.groupBy(F.col(task).cast("bigint").alias("task_id")).agg(F.sum("rows").alias("rows"))
        return found.withColumns({"approach": F.lit(approach), "workers": F.lit(workers)})

    batches = tasks("batches", 1, "batch_id")
    chunks = batches.drop("workers").withColumn("workers", F.explode(F.array(*map(F.lit, WORKER_COUNTS))))

    def noted(tasks, kind, every, at_first=False):
        notes = milestones(tasks, ["approach", "workers"], "task_id", every, at_first)
        return notes.select(F.lit(kind).alias("kind"), "workers", "task_id", "completed")

    return (
        noted(chunks, "chunks", CHUNKS_PER_NOTE)
        .unionByName(noted(tasks("shards", 4, "shard"), "shards", SHARDS_PER_NOTE))
        .unionByName(noted(batches, "batches", BATCHES_PER_NOTE, at_first=True))
    )


@query(
    "a9_systematic_readings",
    f"""
    SELECT count(*) AS readings, round(sum(cpu_centi)::DOUBLE / 100.0 / count(*), 6) AS avg_cpu_percent,
           round(sum(memory_mb)::DOUBLE / count(*), 6) AS avg_memory_mb
    FROM (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 128 AS batch_id FROM ({SAMPLES_SQL}))
    WHERE batch_id % 10 = 0
    """,
)
def readings(spark, base):
    numbered, _ = numbered_events(spark, base)
    return rounded(systematic_readings(mini_batches(numbered, 128)))


@query(
    "a10_run_statistics",
    rounded_sql(
        statistics_sql(repeated_runs_sql()), "approach, metric", ("mean", "std", "min", "max", "median")
    ),
)
def statistics(spark, base):
    return rounded(run_statistics(repeated_runs(spark, base)))


@query(
    "a11_run_envelope",
    f"""
    SELECT strategy AS approach, workers, stream_rate, error,
           CASE WHEN error IS NULL THEN total_processed END AS total_processed,
           CASE WHEN error IS NULL THEN round(experiment_time, 6) END AS benchmark_duration
    FROM ({experiment_cells_sql()})
    """,
)
def envelope(spark, base):
    cells = experiment_cells(spark, base).withColumnRenamed("strategy", "approach")
    ok = F.col("error").isNull()
    succeeded = cells.filter(ok).select(
        "approach",
        "workers",
        "stream_rate",
        "total_processed",
        F.col("experiment_time").alias("benchmark_duration"),
    )
    failed = cells.filter(~ok).select("approach", "workers", "stream_rate", "error")
    return rounded(run_envelope(succeeded, failed))


@query(
    "a12_first_run_gate",
    f"SELECT approach, arg_min(coalesce(error, ''), run) AS first_error, count(*) AS runs "
    f"FROM ({repeated_runs_sql()}) GROUP BY 1",
)
def gate(spark, base):
    gated = first_run_gate(repeated_runs(spark, base))
    return gated.select("approach", F.coalesce("error", F.lit("")).alias("first_error"), "runs")


@query(
    "s10_text_report",
    f"""
    WITH runs AS ({repeated_runs_sql()}),
    g AS (SELECT approach, nullif(arg_min(coalesce(error, ''), run), '') AS error FROM runs GROUP BY 1),
    st AS ({statistics_sql('SELECT * FROM runs')}),
    m AS (SELECT approach,
            coalesce(max(mean) FILTER (metric = 'throughput'), 0.0) AS t,
            coalesce(max(mean) FILTER (metric = 'latency_ms'), 0.0) AS l,
            coalesce(max(mean) FILTER (metric = 'avg_cpu_percent'), 0.0) AS c,
            coalesce(max(mean) FILTER (metric = 'avg_memory_mb'), 0.0) AS y
          FROM st GROUP BY 1),
    lines AS (
        SELECT unnest([repeat('=', 80), 'DATA PARTITIONING BENCHMARK REPORT', repeat('=', 80),
                       'Timestamp: ' || (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events),
                       'System: test tables with 8 CPUs', 'Memory: 32.0 GB', '', '']) AS line
        UNION ALL SELECT 'PERFORMANCE SUMMARY'
        UNION ALL SELECT repeat('-', 80) UNION ALL SELECT repeat('-', 80)
        UNION ALL SELECT printf('%-15s %-15s %-15s %-10s %-12s',
                                'Approach', 'Throughput', 'Latency', 'CPU %', 'Memory MB')
        UNION ALL
        SELECT CASE WHEN error IS NOT NULL
               THEN printf('%-15s %-15s %-15s %-10s %-12s', g.approach, 'ERROR', 'ERROR', 'ERROR', 'ERROR')
               ELSE printf('%-15s %-15.2f %-15.2f %-10.1f %-12.1f', g.approach, t, l, c, y) END
        FROM g LEFT JOIN m USING (approach)
        UNION ALL SELECT upper(approach) || ' PARTITIONING DETAILS' FROM g
        UNION ALL SELECT repeat('-', 40) FROM g
        UNION ALL SELECT unnest(['Error: ' || error, '']) FROM g WHERE error IS NOT NULL
        UNION ALL
        SELECT unnest([metric || ':', printf('  Mean: %.2f', mean), printf('  Std:  %.2f', std),
                       printf('  Min:  %.2f', min), printf('  Max:  %.2f', max),
                       printf('  Median: %.2f', median), ''])
        FROM st JOIN g USING (approach) WHERE error IS NULL)
    SELECT rtrim(line) AS line FROM lines
    """,
)
def text_report(spark, base):
    latest = event_samples(spark, base).agg(F.date_format(F.max("arrival"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    title = title_block(latest, "test tables", 8, 32.0)
    lines = report_lines(gated_statistics(repeated_runs(spark, base)), title=title)
    path = scratch_dir(spark, "report")
    write_text(lines, path)
    return read_text(spark, path).select(F.rtrim("line").alias("line"))
