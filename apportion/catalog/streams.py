"""Pacing, queues and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.catalog.data import TIME_SCALE
from apportion.catalog.registry import SAMPLES_SQL, query, rounded, shard_sql
from apportion.catalog.sql import cells_sql, outcomes_sql, summary_sql, timed_sql
from apportion.operators.assign import assign
from apportion.operators.queueing import fifo_schedule
from apportion.plans.pacing import rate_metrics, schedule, sojourn_profile
from apportion.plans.stream_matrix import (
    BASE_RATE,
    STREAM_RATES,
    cell_outcomes,
    profile_stream,
    streaming_summary,
    worker_outcomes,
)
from apportion.session import scratch_dir
from apportion.sources import event_samples, to_event_samples
from apportion.streaming.keyed import keyed_backlog
from apportion.streaming.operators import backlog, once_per_sample, routed_counts, window_counts, windowed_rates
from apportion.streaming.runner import run_aggregate, run_numbered, run_to_table, run_windows
from apportion.streaming.sources import replay_delay, table_stream

# Interval of a stream at the base rate, in event time.
WINDOW_SECONDS = f"{6 * 3600 / TIME_SCALE!r}::DOUBLE"
INTERVAL_US = TIME_SCALE * 1_000_000 // BASE_RATE
BIN_US = 60_000_000


def _stream(spark, base):
    return to_event_samples(table_stream(spark, base, "events"))


@query(
    "w1_schedule_lag",
    f"""
    WITH s AS ({SAMPLES_SQL}), p AS (SELECT min(arrival_us) AS first_us FROM s)
    SELECT seq, arrival_us, first_us + seq * {INTERVAL_US} AS due_us,
           greatest(first_us + seq * {INTERVAL_US} - arrival_us, 0) AS wait_us,
           greatest(arrival_us - first_us - seq * {INTERVAL_US}, 0) AS lag_us
    FROM s, p
    """,
)
def schedule_lag(spark, base):
    samples = event_samples(spark, base)
    return schedule(samples, profile_stream(samples).first_us, BASE_RATE, TIME_SCALE)


@query(
    "w2_rate_metrics",
    f"""
    SELECT CAST({BASE_RATE} AS INTEGER) AS target_rate, round(generated / seconds, 6) AS actual_rate,
           round(seconds, 6) AS elapsed_time, generated AS generated_samples,
           round(generated / seconds * 100.0 / {BASE_RATE}, 6) AS rate_accuracy
    FROM (SELECT count(*) AS generated,
                 (max(arrival_us) - min(arrival_us)) / {1e6 * TIME_SCALE}::DOUBLE AS seconds
          FROM ({SAMPLES_SQL}))
    """,
)
def stream_rate(spark, base):
    return rounded(rate_metrics(event_samples(spark, base), BASE_RATE, TIME_SCALE))


_WINDOWED_SQL = f"""
    SELECT arrival_us // 21600000000 * 21600000000 AS window_us,
           {shard_sql('content', '4')} AS worker, count(*) AS samples
    FROM ({SAMPLES_SQL}) GROUP BY 1, 2
"""


@query("w3_routed_counts", _WINDOWED_SQL)
def routed_batch(spark, base):
    return routed_counts(event_samples(spark, base), "sharded", 4, "6 hours")


@query("w3_routed_counts_stream", _WINDOWED_SQL)
def routed_stream(spark, base):
    return run_aggregate(routed_counts(_stream(spark, base), "sharded", 4, "6 hours"), "routed")


@query(
    "w2_windowed_rate",
    f"""
    SELECT window_us, count(*) AS generated_samples, round(count(*) / {WINDOW_SECONDS}, 6) AS actual_rate,
           round(count(*) / {WINDOW_SECONDS} * 100.0 / {BASE_RATE}, 6) AS rate_accuracy
    FROM (SELECT arrival_us // 21600000000 * 21600000000 AS window_us FROM ({SAMPLES_SQL})) GROUP BY 1
    """,
)
def windowed_rate(spark, base):
    """The rate of each six hours of a stream, by windows that close as event time goes on."""
    windows, _ = _windows(spark, base, window_counts("6 hours"), lambda rows: rows)
    return rounded(windowed_rates(windows, BASE_RATE, TIME_SCALE))


@query(
    "w3_windowed_stream",
    f"""
    SELECT arrival_us // 21600000000 * 21600000000 AS window_us, {shard_sql('content', '4')} AS worker,
           count(*) AS samples, 0 AS late_rows FROM ({SAMPLES_SQL}) GROUP BY 1, 2
    """,
)
def routed_windows(spark, base):
    """Routed counts in append mode, beside the number of rows that came too late for their window."""
    windows, late = _windows(
        spark, base, window_counts("6 hours", "worker"), lambda rows: assign(rows, "sharded", 4)
    )
    return windows.select(
        F.unix_micros("window.start").alias("window_us"), "worker", "samples", F.lit(late.count()).cast("int").alias("late_rows")
    )


def _windows(spark, base, counts, route):
    delay = replay_delay(spark, base, "events", "ts")
    return run_windows(counts, route(_stream(spark, base)), "arrival", delay, scratch_dir(spark, "windows"))


def _finish_sql(strategy: str, workers: int) -> str:
    return (
        "SELECT seq, worker_id AS worker, start_us, start_us + service_us AS finish_us "
        f"FROM ({timed_sql()}) WHERE strategy = '{strategy}' AND workers = {workers}"
    )


@query("w4_fifo_finish", _finish_sql("sharded", 2))
def fifo_finish(spark, base):
    samples = event_samples(spark, base).select("seq", "arrival_us", "service_us", "content")
    routed = assign(samples, "sharded", 2).drop("content")
    return fifo_schedule(routed, ["worker"], block_rows=4096).select(
        "seq", "worker", "start_us", "finish_us"
    )


@query("w4_fifo_finish_stream", _finish_sql("uniform", 2))
def fifo_stream(spark, base):
    samples = _stream(spark, base).select("seq", "arrival_us", "service_us")
    scheduled = backlog(samples, ["worker"], 4096, route=lambda rows: assign(rows, "uniform", 2))
    return scheduled.select("seq", "worker", "start_us", "finish_us")


@query(
    "w4_keyed_workers",
    f"""
    WITH t AS (SELECT seq, worker_id AS worker, start_us, start_us + service_us AS finish_us
               FROM ({timed_sql()}) WHERE strategy = 'sharded' AND workers = 2),
    o AS (SELECT *, lead(start_us) OVER (PARTITION BY worker ORDER BY seq) AS next_us FROM t),
    p AS (SELECT *, coalesce(sum(CAST(next_us > finish_us AS INT)) OVER (PARTITION BY worker ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS period FROM o)
    SELECT 'sample' AS kind, worker, seq, start_us, finish_us, 1::BIGINT AS samples FROM t
    UNION ALL
    SELECT 'idle', worker, max(seq), max(finish_us), max(finish_us), count(*)
    FROM p GROUP BY worker, period HAVING bool_or(next_us > finish_us)
    """,
)
def keyed_workers(spark, base):
    """Finishing times and idle times from state that is kept by worker, in the stream's checkpoint.

    Whether a worker's last sample leaves it idle is not known before the stream goes on.
    """
    routed = assign(_stream(spark, base), "sharded", 2)
    events = keyed_backlog(routed, ["worker"], replay_delay(spark, base, "events", "ts"))
    last = events.filter("kind = 'sample'").groupBy("worker").agg(F.max("seq").alias("last"))
    known = (F.col("kind") == "sample") | (F.col("seq") < F.col("last"))
    return events.join(last, "worker").filter(known).select("kind", "worker", "seq", "start_us", "finish_us", "samples")


@query(
    "w4_fifo_backlog",
    f"SELECT strategy, workers, worker_id, enqueued, processed, residual FROM ({outcomes_sql()})",
)
def fifo_backlog(spark, base):
    outcomes = worker_outcomes(event_samples(spark, base))
    return outcomes.drop("stream_rate")


@query(
    "w5_strategy_matrix",
    f"SELECT strategy, workers, enqueued, processed, residual, round(efficiency, 6) AS efficiency "
    f"FROM ({cells_sql()})",
)
def strategy_matrix(spark, base):
    samples = event_samples(spark, base)
    profile = profile_stream(samples)
    outcomes = worker_outcomes(samples, profile=profile)
    return rounded(cell_outcomes(outcomes, profile.generated).drop("stream_rate"))


@query(
    "w6_sojourn",
    f"""
    WITH t AS (SELECT worker_id AS worker, service_us, start_us + service_us - at_us AS sojourn_us
               FROM ({timed_sql()}) WHERE strategy = 'uniform' AND workers = 4),
    o AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY sojourn_us) AS place,
                 count(*) OVER (PARTITION BY worker) AS n FROM t)
    SELECT worker, count(*) AS samples,
           round(sum(service_us)::DOUBLE / count(*), 6) AS mean_service_us,
           round(sum(sojourn_us)::DOUBLE / count(*), 6) AS mean_sojourn_us,
           max(sojourn_us) AS longest_us,
           min(sojourn_us // {BIN_US}) FILTER (place >= ceil(n * 0.95)) AS quantile_bin
    FROM o GROUP BY 1
    """,
)
def sojourn(spark, base):
    samples = event_samples(spark, base).select("seq", "arrival_us", "service_us")
    scheduled = fifo_schedule(assign(samples, "uniform", 4), ["worker"])
    return rounded(sojourn_profile(scheduled, ["worker"], BIN_US, 0.95))


@query("w7_rate_matrix", summary_sql(STREAM_RATES))
def rate_matrix(spark, base):
    samples = event_samples(spark, base)
    profile = profile_stream(samples)
    outcomes = worker_outcomes(samples, rates=STREAM_RATES, profile=profile)
    return rounded(streaming_summary(outcomes, profile, TIME_SCALE))


@query(
    "w8_once_per_sample",
    "SELECT event_id AS seq FROM events",
)
def deduplicated(spark, base):
    """Four copies of every sample come in by broadcast; one goes out."""
    copies = assign(_stream(spark, base).select("seq", "arrival"), "dynamic", 4)
    return run_to_table(once_per_sample(copies, replay_delay(spark, base, "events", "ts")), "deduplicated").select("seq")


@query(
    "w9_restarted_stream",
    f"SELECT CAST(seq % 4 AS INTEGER) AS worker, count(*) AS samples FROM ({SAMPLES_SQL}) GROUP BY 1",
)
def restarted(spark, base):
    """A stream run twice on one checkpoint routes every sample exactly once."""
    folder = scratch_dir(spark, "restarted")
    for _ in range(2):
        table = run_numbered(
            _stream(spark, base).select("seq"), "restarted", lambda rows: assign(rows, "uniform", 4), folder
        )
    return table.groupBy("worker").agg(F.count("*").alias("samples"))
