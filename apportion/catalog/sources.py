"""Scans, sources and sinks; projections and per-row expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion import schemas
from apportion.catalog.data import combined, experiment_documents, numbered_orders, small_matrix
from apportion.catalog.registry import ORDERS_SQL, SAMPLES_SQL, TASK_DECIMALS, query, rounded
from apportion.catalog.sql import combined_sql, details_sql, summary_sql
from apportion.functions import chw_from_hwc, normalise, or_zero, ratio
from apportion.functions.guards import whole
from apportion.operators.ordinal import number_rows, with_ordinal
from apportion.operators.scoring import stack_batches
from apportion.plans.documents import failed_documents, flatten_documents, flatten_workers
from apportion.plans.matrix import node_label, sweep
from apportion.plans.pacing import completion
from apportion.plans.stream_matrix import BASE_RATE
from apportion.session import scratch_dir
from apportion.sources import (
    append_experiments,
    cyclic_replay,
    event_samples,
    first_n,
    image_samples,
    mini_batches,
    read_csv,
    read_experiments,
    read_json,
    read_table,
    to_event_samples,
    vector_samples,
    write_csv,
    write_json,
)
from apportion.streaming.runner import run_numbered
from apportion.streaming.sources import bounded, table_stream


@query(
    "s1_ordered_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders",
)
def ordered_scan(spark, base):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    return with_ordinal(read_table(spark, base, "orders", *columns), "o_orderkey")


@query("s2_first_n", f"SELECT o_orderkey, ordinal FROM ({ORDERS_SQL}) WHERE ordinal < 10000")
def first_samples(spark, base):
    numbered, _ = numbered_orders(spark, base)
    return first_n(numbered, 10_000).select("o_orderkey", "ordinal")


@query(
    "s3_mini_batches",
    f"SELECT ordinal // 128 AS batch_id, count(*) AS batch_rows FROM ({ORDERS_SQL}) GROUP BY 1",
)
def batches(spark, base):
    numbered, _ = numbered_orders(spark, base)
    return mini_batches(numbered, 128).groupBy("batch_id").agg(F.count("*").alias("batch_rows"))


@query(
    "s4_paced_stream",
    f"SELECT seq // {BASE_RATE} AS due_second, count(*) AS samples "
    f"FROM ({SAMPLES_SQL}) GROUP BY 1",
)
def paced_stream(spark, base):
    """The table replayed at a fixed rate: a sample is due at ``seq / rate``."""
    stream = to_event_samples(table_stream(spark, base, "events")).select("seq")
    due = whole(F.col("seq"), BASE_RATE).alias("due_second")
    paced = run_numbered(stream, "paced", lambda rows: rows.select("seq", due))
    return paced.groupBy("due_second").agg(F.count("*").alias("samples"))


@query(
    "s5_cyclic_replay",
    f"""
    WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal,
                      count(*) OVER () AS n FROM embeddings)
    SELECT v.vec_id AS sample_id, v.label, count(*) AS replays, min(s.seq) AS first_seq
    FROM ({SAMPLES_SQL}) s JOIN v ON s.seq % v.n = v.ordinal GROUP BY 1, 2
    """,
)
def replay(spark, base):
    samples, count = number_rows(vector_samples(spark, base).select("sample_id", "label"), "sample_id")
    replayed = cyclic_replay(event_samples(spark, base).select("seq"), samples, count)
    return replayed.groupBy("sample_id", "label").agg(
        F.count("*").alias("replays"), F.min("seq").alias("first_seq")
    )


@query(
    "s6_bounded_stream",
    f"SELECT least(count(*), 10000) AS generated, least(count(*), 10000) >= 10000 AS complete "
    f"FROM ({SAMPLES_SQL})",
)
def bounded_stream(spark, base):
    stream = to_event_samples(table_stream(spark, base, "events")).select("seq")
    emitted = run_numbered(stream, "bounded", lambda rows: bounded(rows, 10_000))
    return completion(emitted, 10_000)


@query("s7_json_round_trip", summary_sql())
def json_round_trip(spark, base):
    path = scratch_dir(spark, "experiments-json")
    write_json(experiment_documents(spark, base), path)
    return rounded(flatten_documents(read_json(spark, path, schemas.EXPERIMENT)))


@query("s8_csv_sink", details_sql())
def csv_sink(spark, base):
    path = scratch_dir(spark, "worker-details-csv")
    write_csv(flatten_workers(experiment_documents(spark, base)), path, skip_empty=True)
    return read_csv(spark, path, schemas.WORKER_DETAILS)


@query("s8_csv_combined", combined_sql(TASK_DECIMALS))
def csv_combined(spark, base):
    path = scratch_dir(spark, "combined-csv")
    write_csv(combined(spark, base), path)
    return rounded(read_csv(spark, path, schemas.COMBINED_RESULTS), TASK_DECIMALS)


@query("s9_csv_source", summary_sql())
def csv_source(spark, base):
    """A summary that exists, together with one that was never written."""
    summary, _, _ = small_matrix(spark, base)
    path = scratch_dir(spark, "summary-csv")
    write_csv(summary, path)
    present = read_csv(spark, path, schemas.STREAMING_SUMMARY)
    absent = read_csv(spark, f"{path}-absent", schemas.STREAMING_SUMMARY)
    return rounded(present.unionByName(absent))


@query(
    "s11_incremental_results",
    f"SELECT strategy AS strategy, workers AS num_workers, stream_rate, total_processed, "
    f"efficiency, CAST(NULL AS VARCHAR) AS error FROM ({summary_sql()}) "
    "UNION ALL SELECT 'uniform', CAST(8 AS INTEGER), CAST(500 AS INTEGER), CAST(0 AS BIGINT), "
    "CAST(0 AS DOUBLE), 'not run'",
)
def incremental_results(spark, base):
    """Cells stored one by one; storing a cell twice leaves it there once."""
    documents = experiment_documents(spark, base)
    skipped = failed_documents(
        sweep(spark, strategy=["uniform"], workers=[8], stream_rate=[BASE_RATE]), "not run"
    )
    path = scratch_dir(spark, "experiments-by-cell")
    append_experiments(documents, path)
    append_experiments(documents.filter("strategy = 'dynamic'"), path)
    append_experiments(documents.limit(0).unionByName(skipped, allowMissingColumns=True), path)
    return rounded(
        read_experiments(spark, path).select(
            "strategy", "num_workers", "stream_rate", "total_processed", "efficiency", "error"
        )
    )


@query(
    "p1_normalise_pixels",
    """
    WITH px AS (
        SELECT vec_id AS sample_id,
               list_transform(embedding, lambda x: CAST(least(greatest(
                   floor((CAST(x AS DOUBLE) + 1.0) * 127.5), 0), 255) AS INTEGER)) AS pixels
        FROM embeddings),
    spread AS (SELECT sample_id, pixels, unnest(range(64)) AS pos FROM px)
    SELECT sample_id, CAST(pos AS INTEGER) AS pos,
           round((pixels[(pos % 16) * 4 + pos // 16 + 1] / 255.0 - 0.5) / 0.5, 6) AS value
    FROM spread
    """,
)
def normalised_pixels(spark, base):
    """4 x 4 images of 4 channels, reordered to planes and normalised."""
    images = image_samples(vector_samples(spark, base))
    planes = normalise(chw_from_hwc(F.col("pixels"), 4, 4, 4))
    return rounded(images.select("sample_id", F.posexplode(planes).alias("pos", "value")))


@query(
    "p2_stack_batches",
    """
    WITH v AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings)
    SELECT ordinal // 32 AS batch_id, CAST(count(*) AS INTEGER) AS batch_rows, CAST(64 AS INTEGER) AS width,
           round(CAST(arg_max(embedding[64], ordinal) AS DOUBLE), 6) AS last_value
    FROM v GROUP BY 1
    """,
)
def stacked(spark, base):
    samples = with_ordinal(vector_samples(spark, base), "sample_id")
    tensor = F.col("tensor")
    return rounded(
        stack_batches(mini_batches(samples, 32)).select(
            "batch_id",
            F.size(tensor).alias("batch_rows"),
            F.size(tensor[0]).alias("width"),
            F.element_at(F.element_at(tensor, -1), -1).cast("double").alias("last_value"),
        )
    )


@query(
    "p4_drop_missing_samples",
    f"SELECT event_type, count(*) AS samples FROM ({SAMPLES_SQL}) "
    "WHERE event_type <> 'error' GROUP BY 1",
)
def drop_missing(spark, base):
    """An error event brings no data; such a sample is never enqueued."""
    data = F.when(F.col("event_type") != "error", F.col("content"))
    samples = event_samples(spark, base).withColumn("data", data)
    kept = samples.filter(F.col("data").isNotNull())
    return kept.groupBy("event_type").agg(F.count("*").alias("samples"))


@query(
    "p5_node_id",
    f"""
    WITH v AS (SELECT seq, event_type, user_id, row_number() OVER (ORDER BY seq) - 1 AS task_id
               FROM ({SAMPLES_SQL}))
    SELECT seq, CAST(coalesce(CASE WHEN event_type = 'view' THEN user_id END,
                              CASE WHEN event_type = 'click' THEN user_id + 1000 END,
                              CASE WHEN event_type = 'error' THEN user_id + 2000 END,
                              task_id) AS VARCHAR) AS node
    FROM v
    """,
)
def node_id(spark, base):
    """Rank, else actor, else worker, else position; one kind per event type."""
    samples = with_ordinal(event_samples(spark, base), "seq", name="task_id")
    user, kind = F.col("user_id"), F.col("event_type")
    nodes = samples.select(
        "seq",
        "task_id",
        F.when(kind == "view", user).alias("rank"),
        F.when(kind == "click", user + 1000).alias("actor_id"),
        F.when(kind == "error", user + 2000).alias("worker_id"),
    )
    return node_label(nodes).select("seq", "node")


@query(
    "p6_ordinal",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, "
    "row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice) - 1 AS ordinal FROM lineitem",
)
def ordinal(spark, base):
    """Positions by a leading key of three values, each a third of the table."""
    columns = [
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    ]
    return with_ordinal(
        read_table(spark, base, "lineitem", *columns), *columns, rows_per_range=5_000
    ).drop("l_returnflag")


@query(
    "p7_filters",
    f"SELECT scope, approach, workers, node, throughput FROM ({combined_sql()}) "
    "WHERE scope = 'aggregate' AND approach = 'dynamic' AND workers = 4",
)
def filters(spark, base):
    rows = combined(spark, base).filter(
        (F.col("scope") == "aggregate") & (F.col("approach") == "dynamic") & (F.col("workers") == 4)
    )
    return rounded(rows.select("scope", "approach", "workers", "node", "throughput"))


@query(
    "p8_missing_as_zero",
    f"SELECT seq, CASE WHEN event_type = 'error' THEN 0 ELSE cpu_centi END AS cpu_centi "
    f"FROM ({SAMPLES_SQL})",
)
def missing_as_zero(spark, base):
    reading = F.when(F.col("event_type") != "error", F.col("cpu_centi"))
    return event_samples(spark, base).select("seq", or_zero(reading).alias("cpu_centi"))


@query(
    "p9_guarded_ratio",
    f"SELECT seq, round(CASE WHEN user_id > 0 THEN CAST(service_us AS DOUBLE) / user_id ELSE 0.0 END, 6) AS ratio "
    f"FROM ({SAMPLES_SQL})",
)
def guarded_ratio(spark, base):
    value = ratio(F.col("service_us"), F.col("user_id"))
    return rounded(event_samples(spark, base).select("seq", value.alias("ratio")))
