"""Analytics over an experiment matrix: the tables behind every chart.

Inputs are metric tables whose size follows from the configuration, not from
the samples, apart from node rows, which grow with the number of tasks and
stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.functions.guards import or_zero, percent, ratio
from apportion.operators.assign import APPROACHES, STRATEGIES

# The metrics of a summary table and the margin of an axis.
SCORE_METRICS = ("throughput", "latency_ms", "cpu_percent", "memory_mb")
AXIS_MARGIN = 0.1


def scalability_sizes(configured_workers: int) -> list[int]:
    """Worker counts of a scalability study."""
    return [1, 2, 4, 8] if configured_workers >= 8 else [1, 2, 4]


def sweep(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the given axes, one row each."""
    rows = spark.range(1).select()
    for name, values in axes.items():
        rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return rows


def node_label(nodes: DataFrame) -> DataFrame:
    """Name a node by rank, else actor, else worker, else its position."""
    return nodes.withColumn(
        "node", F.coalesce("rank", "actor_id", "worker_id", "task_id").cast("string")
    )


def combined_results(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per run (node ``all``) and one per node, in one flat table."""
    columns = (
        "scope",
        "approach",
        "workers",
        "node",
        "throughput",
        "latency_ms",
        F.col("avg_cpu_percent").alias("cpu_percent"),
        F.col("avg_memory_mb").alias("memory_mb"),
    )
    overall = runs.withColumns({"scope": F.lit("aggregate"), "node": F.lit("all")})
    each = node_label(nodes).withColumn("scope", F.lit("node"))
    return overall.select(*columns).unionByName(each.select(*columns))


def aggregate_rows(combined: DataFrame) -> DataFrame:
    return combined.filter(F.col("scope") == "aggregate")


def speedup(combined: DataFrame, baseline_workers: int) -> DataFrame:
    """Throughput against the run at ``baseline_workers``.

    An approach without that run is left out.
    """
    runs = aggregate_rows(combined)
    base = runs.filter(F.col("workers") == baseline_workers).select(
        "approach", F.col("throughput").alias("base")
    )
    gain = ratio(F.col("throughput"), F.col("base"))
    return runs.join(base, "approach").select(
        "approach",
        "workers",
        gain.alias("speedup"),
        (gain / F.col("workers") * 100.0).alias("efficiency_percent"),
    )


def scalability(summary: DataFrame, low: int = 1, high: int = 4) -> DataFrame:
    """Improvement in percent between two worker counts, null if one is missing."""

    def gain(metric: str):
        at_low = F.max(F.when(F.col("workers") == low, F.col(metric)))
        at_high = F.max(F.when(F.col("workers") == high, F.col(metric)))
        return F.when(at_low > 0, (at_high - at_low) / at_low * 100.0)

    return summary.groupBy("strategy", "stream_rate").agg(
        gain("efficiency").alias("efficiency_improvement"),
        gain("throughput").alias("throughput_improvement"),
    )


def pivot_strategies(summary: DataFrame, metric: str, strategies=STRATEGIES) -> DataFrame:
    """Worker counts down, strategies across; a missing cell is null."""
    return (
        summary.groupBy("stream_rate", "workers")
        .pivot("strategy", list(strategies))
        .agg(F.first(metric))
    )


def pivot_workers(summary: DataFrame, metric: str, worker_counts: Sequence[int]) -> DataFrame:
    """Strategies down, worker counts across."""
    pivoted = (
        summary.groupBy("stream_rate", "strategy")
        .pivot("workers", list(worker_counts))
        .agg(F.first(metric))
    )
    return pivoted.withColumnsRenamed({str(w): f"workers_{w}" for w in worker_counts})


def scoreboard(combined: DataFrame, approaches: Sequence[str] = APPROACHES) -> DataFrame:
    """Per worker count and metric, one column per approach; missing is zero."""
    return (
        aggregate_rows(combined)
        .unpivot(["workers", "approach"], list(SCORE_METRICS), "metric", "value")
        .groupBy("workers", "metric")
        .pivot("approach", list(approaches))
        .agg(F.first("value"))
        .fillna(0.0)
    )


def axis_bounds(summary: DataFrame, metric: str, margin: float = AXIS_MARGIN) -> DataFrame:
    return summary.agg(
        (F.min(metric) - margin).alias("low"), (F.max(metric) + margin).alias("high")
    )


def load_distribution(details: DataFrame) -> DataFrame:
    return details.groupBy("workers", "strategy", "worker_id").agg(
        F.sum("processed_samples").alias("processed_samples")
    )


def per_worker_rate(details: DataFrame, elapsed_seconds: float, base_rate: int) -> DataFrame:
    """Rate each worker should see against the rate it kept up."""
    seconds = F.lit(elapsed_seconds) * base_rate / F.col("stream_rate")
    actual = ratio(F.col("processed_samples"), seconds)
    expected = F.col("stream_rate") / F.col("workers")
    return details.select(
        "strategy",
        "workers",
        "stream_rate",
        "worker_id",
        expected.alias("expected_rate"),
        actual.alias("actual_rate"),
        percent(actual, expected).alias("share_percent"),
    )


def best_by(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The configuration with the highest value of each metric.

    Equal values go to the first strategy by name, then the fewest workers.
    """
    long = summary.unpivot(["strategy", "workers"], list(metrics), "metric", "value")
    rank = F.struct((-F.col("value")).alias("negated"), F.col("strategy"), F.col("workers"))
    return (
        long.groupBy("metric")
        .agg(F.min(rank).alias("best"))
        .select(
            "metric", "best.strategy", "best.workers", (-F.col("best.negated")).alias("value")
        )
    )


def by_strategy(experiments: DataFrame) -> DataFrame:
    """Means per strategy over experiments that did not fail."""
    return (
        experiments.filter(F.col("error").isNull())
        .groupBy("strategy")
        .agg(
            F.avg("efficiency").alias("avg_efficiency"),
            F.avg(or_zero(F.col("throughput"))).alias("avg_throughput"),
            F.avg(or_zero(F.col("rate_accuracy"))).alias("avg_rate_accuracy"),
            F.count(F.lit(1)).alias("experiment_count"),
        )
    )


def by_workers(experiments: DataFrame) -> DataFrame:
    return (
        experiments.filter(F.col("error").isNull())
        .groupBy("workers")
        .agg(
            F.avg("efficiency").alias("avg_efficiency"),
            F.avg(or_zero(F.col("throughput"))).alias("avg_throughput"),
            F.count(F.lit(1)).alias("experiment_count"),
        )
    )


def outcome_counts(experiments: DataFrame) -> DataFrame:
    return experiments.agg(
        F.count_if(F.col("error").isNull()).alias("total_successful_experiments"),
        F.count_if(F.col("error").isNotNull()).alias("total_failed_experiments"),
    )


def analysis_document(experiments: DataFrame) -> DataFrame:
    """The whole analysis as one nested row: per strategy, per worker count, counts.

    It has one entry per strategy and one per worker count.
    """

    def listed(rollup: DataFrame, name: str) -> DataFrame:
        return rollup.agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name))

    strategies = listed(by_strategy(experiments), "strategy_analysis")
    workers = listed(by_workers(experiments), "worker_analysis")
    one = F.lit(1).alias("one")
    return (
        outcome_counts(experiments)
        .select("*", one)
        .join(strategies.select("*", one), "one")
        .join(workers.select("*", one), "one")
        .drop("one")
    )


def tagged(results: DataFrame, config: dict, timestamp: str) -> DataFrame:
    """Attach the run's configuration and start time to every result row."""
    entries = [F.lit(v).alias(k) for k, v in sorted(config.items())]
    return results.withColumns(
        {"config": F.to_json(F.struct(*entries)), "timestamp": F.lit(timestamp)}
    )
