"""Every schema the engine reads or writes, as DDL, declared rather than inferred."""

from __future__ import annotations

# Input tables. Zone-less Parquet timestamps are read as instants, so their
# microseconds do not depend on the session time zone.
TABLES: dict[str, str] = {
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": (
        "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"
    ),
}

# One scored task: a chunk on an actor, or a shard on a worker.
TASK_RESULT = (
    "worker_id INT, task_id BIGINT, batch_size BIGINT, inference_time DOUBLE, "
    "total_inferences BIGINT, cpu_usage DOUBLE, memory_usage DOUBLE"
)

RUN_METRICS = (
    "throughput DOUBLE, latency_ms DOUBLE, avg_cpu_percent DOUBLE, avg_memory_mb DOUBLE, "
    "total_duration DOUBLE, total_inferences BIGINT"
)

COMBINED_RESULTS = (
    "scope STRING, approach STRING, workers INT, node STRING, throughput DOUBLE, "
    "latency_ms DOUBLE, cpu_percent DOUBLE, memory_mb DOUBLE"
)

SPEEDUP = "approach STRING, workers INT, speedup DOUBLE, efficiency_percent DOUBLE"

STREAMING_SUMMARY = (
    "strategy STRING, workers INT, stream_rate INT, total_processed BIGINT, efficiency DOUBLE, "
    "experiment_time DOUBLE, throughput DOUBLE, latency_ms DOUBLE, cpu_percent DOUBLE, "
    "memory_mb DOUBLE, rate_accuracy DOUBLE"
)

WORKER_DETAILS = (
    "strategy STRING, workers INT, stream_rate INT, worker_id INT, "
    "processed_samples BIGINT, queue_size BIGINT"
)

# One streaming experiment as a nested document; `error` is null on success.
EXPERIMENT = (
    "strategy STRING, num_workers INT, stream_rate INT, error STRING, "
    "stream_metrics STRUCT<target_rate: INT, actual_rate: DOUBLE, elapsed_time: DOUBLE, "
    "generated_samples: BIGINT, rate_accuracy: DOUBLE>, "
    "worker_metrics ARRAY<STRUCT<worker_id: INT, processed_samples: BIGINT, queue_size: BIGINT>>, "
    "overall_metrics STRUCT<throughput: DOUBLE, latency_ms: DOUBLE, avg_cpu_percent: DOUBLE, "
    "avg_memory_mb: DOUBLE, total_duration: DOUBLE, total_inferences: BIGINT>, "
    "total_processed BIGINT, efficiency DOUBLE, experiment_time DOUBLE"
)

RUN_STATISTICS = (
    "approach STRING, metric STRING, mean DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE, median DOUBLE"
)

ANALYSIS = (
    "total_successful_experiments BIGINT, total_failed_experiments BIGINT, "
    "strategy_analysis ARRAY<STRUCT<strategy: STRING, avg_efficiency: DOUBLE, "
    "avg_throughput: DOUBLE, avg_rate_accuracy: DOUBLE, experiment_count: BIGINT>>, "
    "worker_analysis ARRAY<STRUCT<workers: INT, avg_efficiency: DOUBLE, "
    "avg_throughput: DOUBLE, experiment_count: BIGINT>>"
)
