"""SQL counterparts of the analyses that several queries build on."""

from __future__ import annotations

from apportion.catalog.data import LOWEST_EFFICIENCY, TIME_SCALE
from apportion.catalog.registry import DECIMALS, SAMPLES_SQL, shard_sql
from apportion.plans.stream_matrix import BASE_RATE, STREAM_RATES

_SECOND = f"{1e6 * TIME_SCALE}"


def timed_sql(rates=(BASE_RATE,)) -> str:
    """Every routed sample of every cell with the time its worker starts it."""
    values = ", ".join(f"({rate})" for rate in rates)
    lane = "PARTITION BY strategy, workers, stream_rate, worker_id ORDER BY seq"
    return f"""
    WITH s AS ({SAMPLES_SQL}),
    p AS (SELECT min(arrival_us) AS first_us, max(arrival_us) AS last_us, count(*) AS generated
          FROM s),
    k(workers) AS (VALUES (1), (2), (4)),
    r(stream_rate) AS (VALUES {values}),
    routed AS (
        SELECT 'uniform' AS strategy, workers, seq % workers AS worker_id, s.* FROM s, k
        UNION ALL
        SELECT 'dynamic', workers, unnest(range(workers)), s.* FROM s, k
        UNION ALL
        SELECT 'sharded', workers, {shard_sql('content', 'workers')}, s.* FROM s, k),
    arriving AS (
        SELECT routed.*, r.stream_rate, p.generated,
               first_us + (arrival_us - first_us) * {BASE_RATE} // stream_rate AS at_us,
               first_us + (last_us - first_us) * {BASE_RATE} // stream_rate AS stop_us,
               last_us - first_us AS elapsed_us
        FROM routed, r, p),
    summed AS (SELECT *, sum(service_us) OVER ({lane}) - service_us AS before_us FROM arriving)
    SELECT strategy, CAST(workers AS INTEGER) AS workers,
           CAST(stream_rate AS INTEGER) AS stream_rate, CAST(worker_id AS INTEGER) AS worker_id,
           seq, at_us, service_us, stop_us, elapsed_us, generated, cpu_centi, memory_mb,
           CAST(before_us + max(at_us - before_us) OVER ({lane}) AS BIGINT) AS start_us
    FROM summed
    """


def outcomes_sql(rates=(BASE_RATE,)) -> str:
    return f"""
    SELECT strategy, workers, stream_rate, worker_id, count(*) AS enqueued,
           count(*) FILTER (start_us < stop_us) AS processed,
           count(*) FILTER (start_us >= stop_us) AS residual,
           any_value(generated) AS generated, any_value(elapsed_us) AS elapsed_us
    FROM ({timed_sql(rates)}) GROUP BY 1, 2, 3, 4
    """


def details_sql(rates=(BASE_RATE,)) -> str:
    return (
        "SELECT strategy, workers, stream_rate, worker_id, processed AS processed_samples, "
        f"residual AS queue_size FROM ({outcomes_sql(rates)})"
    )


def cells_sql(rates=(BASE_RATE,)) -> str:
    return f"""
    SELECT strategy, workers, stream_rate, sum(enqueued)::BIGINT AS enqueued,
           sum(processed)::BIGINT AS processed, sum(residual)::BIGINT AS residual,
           sum(processed)::BIGINT * 100.0 / any_value(generated) AS efficiency
    FROM ({outcomes_sql(rates)}) GROUP BY 1, 2, 3
    """


def summary_sql(rates=(BASE_RATE,), decimals: int = DECIMALS) -> str:
    return f"""
    SELECT strategy, workers, stream_rate, processed AS total_processed,
           round(efficiency, {decimals}) AS efficiency,
           round(seconds, {decimals}) AS experiment_time,
           round(processed / seconds, {decimals}) AS throughput,
           round(CASE WHEN processed > 0 THEN seconds * 1000.0 / (processed / 128.0) ELSE 0.0 END,
                 {decimals}) AS latency_ms,
           round(cpu, {decimals}) AS cpu_percent,
           round(memory, {decimals}) AS memory_mb,
           round(generated / seconds * 100.0 / stream_rate, {decimals}) AS rate_accuracy
    FROM (
        SELECT c.*, p.*, p.elapsed_us * {BASE_RATE} / stream_rate / {_SECOND}::DOUBLE AS seconds
        FROM ({cells_sql(rates)}) c,
             (SELECT count(*) AS generated, max(arrival_us) - min(arrival_us) AS elapsed_us,
                     sum(cpu_centi)::BIGINT / 100.0 / count(*) AS cpu,
                     sum(memory_mb)::BIGINT / count(*) AS memory
              FROM ({SAMPLES_SQL})) p)
    """


def experiment_cells_sql() -> str:
    return f"""
    SELECT *, CASE WHEN efficiency > 100 THEN 'duplicated work'
                   WHEN efficiency < {LOWEST_EFFICIENCY} THEN 'overloaded' END AS error
    FROM ({summary_sql(STREAM_RATES, 12)})
    """


def repeated_runs_sql() -> str:
    return f"""
    SELECT strategy AS approach, error,
           CAST(row_number() OVER (PARTITION BY strategy ORDER BY workers DESC, stream_rate DESC)
                AS INTEGER) AS run,
           CASE WHEN error IS NULL THEN throughput END AS throughput,
           CASE WHEN error IS NULL THEN latency_ms END AS latency_ms,
           CASE WHEN error IS NULL THEN cpu_percent END AS avg_cpu_percent,
           CASE WHEN error IS NULL THEN memory_mb END AS avg_memory_mb,
           CASE WHEN error IS NULL THEN experiment_time END AS total_duration
    FROM ({experiment_cells_sql()})
    """


def statistics_sql(source: str) -> str:
    return f"""
    SELECT approach, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min,
           max(value) AS max, median(value) AS median
    FROM (UNPIVOT ({source}) ON throughput, latency_ms, avg_cpu_percent, avg_memory_mb,
          total_duration INTO NAME metric VALUE value)
    GROUP BY 1, 2
    """


def tasks_sql() -> str:
    """Tasks of the three batch approaches for one, two and four workers."""
    return f"""
    WITH s AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS ordinal, count(*) OVER () AS n
               FROM ({SAMPLES_SQL})),
    k(workers) AS (VALUES (1), (2), (4)),
    b AS (SELECT s.*, workers, ordinal % 128 AS pos, ordinal // 128 AS batch_id,
                 least(128, n - (ordinal - ordinal % 128)) // workers AS slice,
                 n // workers AS run
          FROM s, k),
    u AS (SELECT 'uniform' AS approach, workers,
                 CASE WHEN slice = 0 THEN workers - 1 ELSE least(pos // slice, workers - 1) END
                     AS worker,
                 CASE WHEN slice = 0 THEN workers - 1 ELSE least(pos // slice, workers - 1) END
                     AS task_id,
                 batch_id % 10 = 0 AS sampled, service_us, cpu_centi, memory_mb FROM b),
    d AS (SELECT 'dynamic', workers, batch_id % workers, batch_id, true, service_us, cpu_centi,
                 memory_mb FROM b),
    h AS (SELECT 'sharded', workers,
                 CASE WHEN run = 0 THEN workers - 1 ELSE least(ordinal // run, workers - 1) END,
                 CASE WHEN run = 0 THEN workers - 1 ELSE least(ordinal // run, workers - 1) END,
                 true, service_us, cpu_centi, memory_mb FROM b),
    every AS (SELECT * FROM u UNION ALL SELECT * FROM d UNION ALL SELECT * FROM h)
    SELECT approach, CAST(workers AS INTEGER) AS workers, CAST(worker AS INTEGER) AS worker,
           task_id, count(*) AS rows, CAST(sum(service_us) AS DOUBLE) AS busy_us,
           coalesce(sum(cpu_centi) FILTER (sampled) / 100.0
                    / nullif(count(*) FILTER (sampled), 0), 0.0) AS cpu_usage,
           coalesce(CAST(sum(memory_mb) FILTER (sampled) AS DOUBLE)
                    / nullif(count(*) FILTER (sampled), 0), 0.0) AS memory_usage
    FROM every GROUP BY 1, 2, 3, 4
    """


def nodes_sql() -> str:
    return f"""
    SELECT approach, workers, worker, task_id, rows AS total_inferences,
           busy_us / {_SECOND}::DOUBLE AS total_duration,
           rows / (busy_us / {_SECOND}::DOUBLE) AS throughput,
           CASE WHEN approach = 'uniform'
                THEN busy_us / {_SECOND}::DOUBLE * 1000.0 / (rows / 128.0)
                ELSE busy_us / {_SECOND}::DOUBLE * 1000.0 END AS latency_ms,
           cpu_usage AS avg_cpu_percent, memory_usage AS avg_memory_mb
    FROM ({tasks_sql()})
    """


def runs_sql() -> str:
    return f"""
    WITH w AS (SELECT approach, workers, worker, sum(rows) AS rows, sum(busy_us) AS busy_us,
                      sum(cpu_usage) AS cpu, sum(memory_usage) AS memory, count(*) AS tasks
               FROM ({tasks_sql()}) GROUP BY 1, 2, 3),
    r AS (SELECT approach, workers, sum(rows)::BIGINT AS rows,
                 max(busy_us) / {_SECOND}::DOUBLE AS seconds,
                 sum(busy_us) / {_SECOND}::DOUBLE AS all_seconds, sum(cpu) AS cpu,
                 sum(memory) AS memory, sum(tasks)::BIGINT AS tasks, count(*) AS busy_workers
          FROM w GROUP BY 1, 2)
    SELECT approach, workers, rows / seconds AS throughput,
           seconds * 1000.0 / (rows / 128.0) AS latency_ms, cpu / tasks AS avg_cpu_percent,
           memory / tasks AS avg_memory_mb, seconds AS total_duration, rows AS total_inferences,
           all_seconds AS total_inference_time, tasks AS completed_tasks, busy_workers
    FROM r
    """


def combined_sql(decimals: int = DECIMALS) -> str:
    names = {
        "throughput": "throughput",
        "latency_ms": "latency_ms",
        "avg_cpu_percent": "cpu_percent",
        "avg_memory_mb": "memory_mb",
    }
    columns = ", ".join(f"round({c}, {decimals}) AS {name}" for c, name in names.items())
    return f"""
    SELECT 'aggregate' AS scope, approach, workers, 'all' AS node, {columns} FROM ({runs_sql()})
    UNION ALL
    SELECT 'node', approach, workers, CAST(worker AS VARCHAR), {columns} FROM ({nodes_sql()})
    """


def rounded_sql(
    source: str, keep: str, doubles: tuple[str, ...], decimals: int = DECIMALS
) -> str:
    columns = ", ".join(f"round({c}, {decimals}) AS {c}" for c in doubles)
    return f"SELECT {keep}, {columns} FROM ({source})"
