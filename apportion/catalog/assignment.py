"""Worker assignment rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from apportion.catalog.data import numbered_orders
from apportion.catalog.registry import ORDERS_SQL, SAMPLES_SQL, query, shard_sql
from apportion.functions import content_shard, vector_content
from apportion.operators.assign import (
    STRATEGIES,
    assign,
    ceil_chunks,
    contiguous_split,
    fixed_chunks,
    lay_out_by_worker,
    rank_slices,
    round_robin,
    sub_chunks,
)
from apportion.sources import event_samples, read_table, vector_samples


def _split_sql(size: str, position: str, parts: str, name: str = "worker") -> str:
    return (
        f"CAST(CASE WHEN {size} // {parts} = 0 THEN {parts} - 1 "
        f"ELSE least({position} // ({size} // {parts}), {parts} - 1) END AS INTEGER) AS {name}"
    )


@query(
    "c1_rank_slice",
    f"""
    WITH b AS (SELECT o_orderkey, ordinal % 128 AS pos,
                      least(128, n - (ordinal - ordinal % 128)) AS size FROM ({ORDERS_SQL}))
    SELECT o_orderkey, {_split_sql('size', 'pos', '3')} FROM b
    """,
)
def rank_slice(spark, base):
    numbered, count = numbered_orders(spark, base)
    return rank_slices(numbered, 3, 128, count).select("o_orderkey", "worker")


@query(
    "c2_contiguous", f"SELECT o_orderkey, {_split_sql('n', 'ordinal', '7')} FROM ({ORDERS_SQL})"
)
def contiguous(spark, base):
    numbered, count = numbered_orders(spark, base)
    return contiguous_split(numbered, 7, count).select("o_orderkey", "worker")


@query(
    "c3_shards",
    f"SELECT o_orderkey, {_split_sql('n', 'ordinal', '16', 'shard')} FROM ({ORDERS_SQL})",
)
def shards(spark, base):
    numbered, count = numbered_orders(spark, base)
    return contiguous_split(numbered, 16, count, "shard").select("o_orderkey", "shard")


@query(
    "c4_ceil_chunk",
    "SELECT o_orderkey, CAST(ordinal // ((n + 6) // 7) AS INTEGER) AS worker "
    f"FROM ({ORDERS_SQL})",
)
def ceil_chunk(spark, base):
    numbered, count = numbered_orders(spark, base)
    return ceil_chunks(numbered, 7, count).select("o_orderkey", "worker")


@query(
    "c5_fixed_chunks", f"SELECT o_orderkey, ordinal // 1000 AS chunk_id FROM ({ORDERS_SQL})"
)
def chunks(spark, base):
    numbered, _ = numbered_orders(spark, base)
    return fixed_chunks(numbered, 1000).select("o_orderkey", "chunk_id")


@query(
    "c6_round_robin",
    f"SELECT ordinal // 128 AS chunk_id, CAST((ordinal // 128) % 4 AS INTEGER) AS worker, "
    f"count(*) AS chunk_rows FROM ({ORDERS_SQL}) GROUP BY 1, 2",
)
def dealt_chunks(spark, base):
    numbered, _ = numbered_orders(spark, base)
    sizes = fixed_chunks(numbered, 128).groupBy("chunk_id").agg(F.count("*").alias("chunk_rows"))
    return round_robin(sizes, 4)


@query(
    "c7_broadcast",
    f"SELECT seq, CAST(unnest(range(4)) AS INTEGER) AS worker FROM ({SAMPLES_SQL})",
)
def broadcast_copies(spark, base):
    return assign(event_samples(spark, base), "dynamic", 4).select("seq", "worker")


@query(
    "c8_stream_round_robin",
    f"SELECT seq, CAST(seq % 3 AS INTEGER) AS worker FROM ({SAMPLES_SQL})",
)
def stream_round_robin(spark, base):
    return assign(event_samples(spark, base), "uniform", 3).select("seq", "worker")


@query(
    "c9_hash_shard", f"SELECT seq, {shard_sql('content', '4')} AS worker FROM ({SAMPLES_SQL})"
)
def hash_shard(spark, base):
    return assign(event_samples(spark, base), "sharded", 4).select("seq", "worker")


@query(
    "c9_hash_shard_documents",
    f"SELECT worker, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM "
    f"(SELECT {shard_sql('text', '4')} AS worker, n_chars FROM documents) GROUP BY 1",
)
def hash_shard_documents(spark, base):
    """Whole texts decide the shard; only the shard number is shuffled."""
    documents = read_table(spark, base, "documents", "text", "n_chars")
    shard = content_shard(F.col("text"), 4)
    return documents.groupBy(shard.alias("worker")).agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars")
    )


@query(
    "c9_hash_shard_vectors",
    "SELECT vec_id AS sample_id, "
    + shard_sql(
        "array_to_string(list_transform(embedding, "
        "lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',')",
        "4",
    )
    + " AS worker FROM embeddings",
)
def hash_shard_vectors(spark, base):
    content = vector_content(F.col("features"))
    return vector_samples(spark, base).select(
        "sample_id", content_shard(content, 4).alias("worker")
    )


@query(
    "c10_sub_chunks",
    f"""
    WITH s AS (SELECT o_orderkey, ordinal, {_split_sql('n', 'ordinal', '4', 'shard')}
               FROM ({ORDERS_SQL})),
    z AS (SELECT *, count(*) OVER (PARTITION BY shard) AS length,
                 row_number() OVER (PARTITION BY shard ORDER BY ordinal) - 1 AS pos FROM s)
    SELECT o_orderkey, shard,
           CASE WHEN length > 1000 THEN pos // 1000 ELSE 0 END AS sub_chunk
    FROM z
    """,
)
def shard_pieces(spark, base):
    numbered, count = numbered_orders(spark, base)
    sharded = contiguous_split(numbered, 4, count, "shard")
    return sub_chunks(sharded, True, 1000, 4, count).select("o_orderkey", "shard", "sub_chunk")


@query(
    "c11_dispatch",
    f"""
    WITH s AS ({SAMPLES_SQL}),
    r AS (SELECT 'uniform' AS strategy, seq % 4 AS worker FROM s
          UNION ALL SELECT 'dynamic', unnest(range(4)) FROM s
          UNION ALL SELECT 'sharded', {shard_sql('content', '4')} FROM s)
    SELECT strategy, CAST(worker AS INTEGER) AS worker, count(*) AS samples FROM r GROUP BY 1, 2
    """,
)
def dispatch(spark, base):
    samples = event_samples(spark, base).select("seq", "content")
    routed = None
    for strategy in STRATEGIES:
        counts = (
            assign(samples, strategy, 4)
            .groupBy("worker")
            .agg(F.count("*").alias("samples"))
            .withColumn("strategy", F.lit(strategy))
        )
        routed = counts if routed is None else routed.unionByName(counts)
    return routed


@query(
    "c12_layout",
    f"SELECT worker, count(*) AS samples, true AS own_tasks, true AS spread_evenly "
    f"FROM (SELECT {shard_sql('content', '4')} AS worker FROM ({SAMPLES_SQL})) GROUP BY 1",
)
def layout(spark, base):
    """Rows brought together by worker, each worker spread over its own tasks."""
    samples = assign(event_samples(spark, base).select("seq", "content"), "sharded", 4)
    laid_out = lay_out_by_worker(samples.select("seq", "worker"), 4, "seq", 8)
    placed = laid_out.withColumn("task", F.spark_partition_id())
    per_task = placed.groupBy("task", "worker").agg(F.count("*").alias("samples"))
    mixed = Window.partitionBy("task")
    checked = per_task.withColumn("workers", F.count("*").over(mixed))
    fair = F.sum("samples") / F.count("*")
    return checked.groupBy("worker").agg(
        F.sum("samples").alias("samples"),
        (F.max("workers") == 1).alias("own_tasks"),
        # Twice the worker's mean, or what a few rows may deviate by.
        (F.max("samples") <= F.greatest(fair * 2, fair + 50)).alias("spread_evenly"),
    )
