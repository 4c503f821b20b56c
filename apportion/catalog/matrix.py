"""Tables behind the comparison of approaches, strategies and worker counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from apportion import schemas
from apportion.catalog.data import (
    TIME_SCALE,
    combined,
    event_tasks,
    experiment_cells,
    rated_matrix,
    small_matrix,
)
from apportion.catalog.registry import SAMPLES_SQL, TASK_DECIMALS, query, rounded
from apportion.catalog.sql import (
    combined_sql,
    details_sql,
    experiment_cells_sql,
    outcomes_sql,
    summary_sql,
)
from apportion.operators.assign import APPROACHES, STRATEGIES
from apportion.operators.tasks import run_metrics
from apportion.plans import matrix
from apportion.plans.stream_matrix import BASE_RATE, STREAM_RATES, WORKER_COUNTS
from apportion.session import scratch_dir
from apportion.sources import read_csv, read_json, write_csv, write_json

_RATED = summary_sql(STREAM_RATES, 12)
_METRICS = ("efficiency", "throughput", "rate_accuracy", "cpu_percent")


@query(
    "a13_strategy_rollup",
    f"""
    SELECT strategy, round(avg(efficiency), 6) AS avg_efficiency,
           round(avg(throughput), 6) AS avg_throughput,
           round(avg(rate_accuracy), 6) AS avg_rate_accuracy, count(*) AS experiment_count
    FROM ({experiment_cells_sql()}) WHERE error IS NULL GROUP BY 1
    """,
)
def strategy_rollup(spark, base):
    return rounded(matrix.by_strategy(experiment_cells(spark, base)))


@query(
    "a14_worker_rollup",
    f"""
    SELECT workers, round(avg(efficiency), 6) AS avg_efficiency,
           round(avg(throughput), 6) AS avg_throughput, count(*) AS experiment_count
    FROM ({experiment_cells_sql()}) WHERE error IS NULL GROUP BY 1
    """,
)
def worker_rollup(spark, base):
    return rounded(matrix.by_workers(experiment_cells(spark, base)))


@query(
    "a15_outcome_counts",
    f"""
    SELECT count(*) FILTER (error IS NULL) AS total_successful_experiments,
           count(*) FILTER (error IS NOT NULL) AS total_failed_experiments
    FROM ({experiment_cells_sql()})
    """,
)
def outcome_counts(spark, base):
    return matrix.outcome_counts(experiment_cells(spark, base))


@query(
    "m1_sweep",
    f"""
    WITH k(workers) AS (VALUES (1), (2), (4), (8)),
    a(approach) AS (VALUES ('uniform'), ('dynamic'), ('sharded'))
    SELECT approach, CAST(workers AS INTEGER) AS workers, count(*) AS total_inferences
    FROM ({SAMPLES_SQL}), k, a GROUP BY 1, 2
    """,
)
def sweep(spark, base):
    """All approaches at all sizes of a scalability study, as one job."""
    sizes = matrix.scalability_sizes(8)
    cells = matrix.sweep(spark, approach=list(APPROACHES), workers=sizes)
    runs = run_metrics(event_tasks(spark, base, sizes), TIME_SCALE)
    return cells.join(runs, ["approach", "workers"]).select(
        "approach", "workers", "total_inferences"
    )


@query("m2_flat_rows", combined_sql(TASK_DECIMALS))
def flat_rows(spark, base):
    return rounded(combined(spark, base), TASK_DECIMALS)


@query(
    "m3_accumulate",
    f"SELECT approach, workers, round(throughput, 6) AS throughput FROM ({combined_sql()}) "
    "WHERE scope = 'aggregate'",
)
def accumulate(spark, base):
    """Rows of separate cases appended to one table."""
    tasks = event_tasks(spark, base)
    cases = [
        run_metrics(tasks.filter(F.col("approach") == approach), TIME_SCALE)
        for approach in APPROACHES
    ]
    rows = cases[0].unionByName(cases[1]).unionByName(cases[2])
    return rounded(rows.select("approach", "workers", "throughput"))


@query(
    "m4_speedup",
    f"""
    WITH r AS (SELECT * FROM ({combined_sql()}) WHERE scope = 'aggregate')
    SELECT r.approach, r.workers, round(r.throughput / b.throughput, 4) AS speedup,
           round(r.throughput / b.throughput / r.workers * 100.0, 3) AS efficiency_percent
    FROM r JOIN r b ON r.approach = b.approach AND b.workers = 1
    """,
)
def speedup(spark, base):
    gains = matrix.speedup(combined(spark, base), WORKER_COUNTS[0])
    return gains.select(
        "approach",
        "workers",
        F.round("speedup", 4).alias("speedup"),
        F.round("efficiency_percent", 3).alias("efficiency_percent"),
    )


@query(
    "m5_scalability",
    f"""
    SELECT strategy, stream_rate,
           round((max(efficiency) FILTER (workers = 4) - max(efficiency) FILTER (workers = 1))
                 / max(efficiency) FILTER (workers = 1) * 100.0, 6) AS efficiency_improvement,
           round((max(throughput) FILTER (workers = 4) - max(throughput) FILTER (workers = 1))
                 / max(throughput) FILTER (workers = 1) * 100.0, 6) AS throughput_improvement
    FROM ({_RATED}) GROUP BY 1, 2
    """,
)
def scalability(spark, base):
    return rounded(matrix.scalability(rated_matrix(spark, base)[0]))


@query(
    "m6_pivot_strategy",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, stream_rate, workers, "
        + ", ".join(
            f"round(max({m}) FILTER (strategy = '{s}'), 6) AS {s}" for s in STRATEGIES
        )
        + f" FROM ({_RATED}) GROUP BY 1, 2, 3"
        for m in _METRICS
    )
    + ")",
)
def pivot_strategy(spark, base):
    summary, _, _ = rated_matrix(spark, base)
    tables = [
        matrix.pivot_strategies(summary, m).withColumn("metric", F.lit(m)) for m in _METRICS
    ]
    pivoted = tables[0]
    for table in tables[1:]:
        pivoted = pivoted.unionByName(table)
    return rounded(pivoted)


@query(
    "m7_pivot_workers",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, stream_rate, strategy, "
        + ", ".join(
            f"round(max({m}) FILTER (workers = {w}), 6) AS workers_{w}" for w in WORKER_COUNTS
        )
        + f" FROM ({_RATED}) GROUP BY 1, 2, 3"
        for m in _METRICS[:2]
    ),
)
def pivot_workers(spark, base):
    summary, _, _ = rated_matrix(spark, base)
    efficiency, throughput = (
        matrix.pivot_workers(summary, m, WORKER_COUNTS).withColumn("metric", F.lit(m))
        for m in _METRICS[:2]
    )
    return rounded(efficiency.unionByName(throughput))


@query(
    "m8_scoreboard",
    f"""
    WITH r AS (UNPIVOT (SELECT approach, workers, throughput, latency_ms, cpu_percent, memory_mb
                        FROM ({combined_sql()}) WHERE scope = 'aggregate')
               ON throughput, latency_ms, cpu_percent, memory_mb INTO NAME metric VALUE value)
    SELECT workers, metric, coalesce(max(value) FILTER (approach = 'uniform'), 0.0) AS uniform,
           coalesce(max(value) FILTER (approach = 'dynamic'), 0.0) AS dynamic,
           coalesce(max(value) FILTER (approach = 'sharded'), 0.0) AS sharded
    FROM r GROUP BY 1, 2
    """,
)
def scoreboard(spark, base):
    return rounded(matrix.scoreboard(combined(spark, base)))


@query(
    "m9_ordered_series",
    f"SELECT strategy, workers, stream_rate, round(efficiency, 6) AS efficiency, "
    f"row_number() OVER (PARTITION BY strategy, stream_rate ORDER BY workers)::INTEGER AS position "
    f"FROM ({_RATED})",
)
def ordered_series(spark, base):
    """Each strategy's points in order of worker count."""
    summary, _, _ = rated_matrix(spark, base)
    series = Window.partitionBy("strategy", "stream_rate").orderBy("workers")
    ordered = summary.select(
        "strategy",
        "workers",
        "stream_rate",
        "efficiency",
        F.row_number().over(series).alias("position"),
    )
    return rounded(ordered.orderBy("strategy", "stream_rate", "workers"))


@query("m9_strategies", f"SELECT DISTINCT strategy FROM ({details_sql()})")
def strategies(spark, base):
    return small_matrix(spark, base)[1].select("strategy").distinct()


@query(
    "m10_axis_bounds",
    f"SELECT round(min(rate_accuracy) - 0.1, 6) AS low, round(max(rate_accuracy) + 0.1, 6) AS high "
    f"FROM ({summary_sql((BASE_RATE,), 12)})",
)
def axis_bounds(spark, base):
    return rounded(matrix.axis_bounds(small_matrix(spark, base)[0], "rate_accuracy"))


@query(
    "m11_load_distribution",
    f"SELECT workers, strategy, worker_id, sum(processed_samples)::BIGINT AS processed_samples "
    f"FROM ({details_sql()}) GROUP BY 1, 2, 3",
)
def load_distribution(spark, base):
    return matrix.load_distribution(small_matrix(spark, base)[1])


@query(
    "m12_worker_rate",
    f"""
    SELECT strategy, workers, stream_rate, worker_id,
           round(stream_rate * 1.0::DOUBLE / workers, 6) AS expected_rate,
           round(processed / seconds, 6) AS actual_rate,
           round(processed / seconds * 100.0 / (stream_rate * 1.0::DOUBLE / workers), 6) AS share_percent
    FROM (SELECT *, elapsed_us / {1e6 * TIME_SCALE}::DOUBLE AS seconds FROM ({outcomes_sql()}))
    """,
)
def worker_rate(spark, base):
    _, details, profile = small_matrix(spark, base)
    seconds = profile.elapsed_us / (1e6 * TIME_SCALE)
    return rounded(matrix.per_worker_rate(details, seconds, BASE_RATE))


@query(
    "m13_best_by_metric",
    f"""
    WITH r AS (UNPIVOT (SELECT strategy, workers, efficiency, throughput, cpu_percent, memory_mb
                        FROM ({summary_sql()}))
               ON efficiency, throughput, cpu_percent, memory_mb INTO NAME metric VALUE value),
    o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, strategy, workers) AS place
          FROM r)
    SELECT metric, strategy, workers, value FROM o WHERE place = 1
    """,
)
def best_by_metric(spark, base):
    summary = rounded(small_matrix(spark, base)[0])
    return matrix.best_by(summary, ("efficiency", "throughput", "cpu_percent", "memory_mb"))


@query(
    "m14_environment_tags",
    f"""
    SELECT strategy, workers, total_processed, '2024-01-01 00:00:00' AS "timestamp",
           '{{"max_samples":' || (SELECT count(*) FROM events) || ',"num_runs":1}}' AS config
    FROM ({summary_sql()})
    """,
)
def environment_tags(spark, base):
    summary, _, profile = small_matrix(spark, base)
    config = {"num_runs": 1, "max_samples": profile.generated}
    tagged = matrix.tagged(summary, config, "2024-01-01 00:00:00")
    return tagged.select("strategy", "workers", "total_processed", "timestamp", "config")


@query(
    "s7_analysis_document",
    f"""
    WITH c AS ({experiment_cells_sql()}),
    t AS (SELECT count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS bad FROM c)
    SELECT strategy, round(avg(efficiency), 6) AS avg_efficiency, count(*) AS experiment_count,
           any_value(ok) AS total_successful_experiments, any_value(bad) AS total_failed_experiments
    FROM c, t WHERE error IS NULL GROUP BY 1
    """,
)
def analysis_document(spark, base):
    """The analysis written as one JSON document and read back."""
    path = scratch_dir(spark, "analysis")
    write_json(matrix.analysis_document(experiment_cells(spark, base)), path)
    document = read_json(spark, path, schemas.ANALYSIS)
    rows = document.select(
        F.inline("strategy_analysis"), "total_successful_experiments", "total_failed_experiments"
    )
    return rounded(rows.drop("avg_throughput", "avg_rate_accuracy"))


@query(
    "s8_csv_speedup",
    f"""
    WITH r AS (SELECT * FROM ({combined_sql()}) WHERE scope = 'aggregate')
    SELECT r.approach, r.workers, round(r.throughput / b.throughput, 4) AS speedup
    FROM r JOIN r b ON r.approach = b.approach AND b.workers = 1
    """,
)
def csv_speedup(spark, base):
    path = scratch_dir(spark, "speedup-csv")
    write_csv(matrix.speedup(combined(spark, base), WORKER_COUNTS[0]), path)
    stored = read_csv(spark, path, schemas.SPEEDUP)
    return stored.select("approach", "workers", F.round("speedup", 4).alias("speedup"))
