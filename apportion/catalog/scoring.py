"""Models and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from apportion.catalog.registry import query, rounded
from apportion.operators.assign import contiguous_part
from apportion.operators.ordinal import number_rows, with_ordinal
from apportion.operators.scoring import (
    feature_width,
    forward_counts,
    linear_model,
    load_weights,
    measured_tasks,
    observed,
    prototype_model,
    score_batches,
    score_blocks,
    score_native,
    score_tasks,
    split_faulty,
)
from apportion.operators.tasks import run_metrics
from apportion.session import scratch_dir, written
from apportion.sources import mini_batches, vector_samples
from apportion.streaming.runner import run_scoring, run_to_table
from apportion.streaming.sources import table_stream

# Batches whose first features reach this far make the failing model raise.
FAILING = 0.25

_MODEL_SQL = """
    SELECT class_id, dimension, avg(x) AS weight FROM (
        SELECT label AS class_id, unnest(range(1, len(embedding) + 1)) AS dimension,
               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2
"""
_SCORES_SQL = f"""
    WITH m AS ({_MODEL_SQL}),
    l AS (SELECT vec_id, label, class_id, sum(CAST(embedding[dimension] AS DOUBLE) * weight) AS logit
          FROM embeddings, m GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class_id) AS place
             FROM l)
    SELECT vec_id AS sample_id, class_id AS prediction, round(logit, 6) AS logit
    FROM best WHERE place = 1
"""


def _scorable(spark, base):
    """Samples that can be scored, their model, and its width."""
    samples = vector_samples(spark, base)
    width = feature_width(samples)
    good, _ = split_faulty(samples, width)
    return good, prototype_model(good, width), width


def _damaged(features):
    """Some vectors missing, some short, some not finite."""
    not_finite = F.transform(features, lambda x: F.lit(float("nan")).cast("float"))
    return (
        F.when(features[0] > 0.2, F.lit(None).cast("array<float>"))
        .when(features[1] > 0.2, F.slice(features, 1, F.size(features) - 1))
        .when(features[2] > 0.2, not_finite)
        .otherwise(features)
    )


@query(
    "i1_prototype_model",
    f"SELECT class_id, CAST(dimension - 1 AS INTEGER) AS dimension, round(weight, 6) AS weight FROM ({_MODEL_SQL})",
)
def model_weights(spark, base):
    model = prototype_model(vector_samples(spark, base))
    return rounded(model.select("class_id", F.posexplode("weights").alias("dimension", "weight")))


@query(
    "i2_batch_forward",
    "SELECT ordinal // 128 AS batch_id, count(*) AS scored FROM "
    "(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings) GROUP BY 1",
)
def batch_forward(spark, base):
    samples, model, _ = _scorable(spark, base)
    _, weights = load_weights(model)
    batched = mini_batches(with_ordinal(samples, "sample_id"), 128)
    return forward_counts(batched, linear_model(weights))


@query("i3_argmax_score", _SCORES_SQL)
def argmax_native(spark, base):
    samples, model, _ = _scorable(spark, base)
    scored = score_native(samples, model)
    return rounded(scored.select("sample_id", "prediction", "logit"))


@query("i3_argmax_score_batches", _SCORES_SQL)
def argmax_batches(spark, base):
    samples, model, _ = _scorable(spark, base)
    class_ids, weights = load_weights(model)
    return rounded(score_batches(samples, linear_model(weights), class_ids))


@query("i4_stream_score", _SCORES_SQL)
def stream_score(spark, base):
    """The batch scorer on a stream of vectors, with a model made beforehand."""
    _, model, width = _scorable(spark, base)
    class_ids, weights = load_weights(model)
    stream = table_stream(spark, base, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").alias("features")
    )
    good, _ = split_faulty(stream, width)
    scored = score_batches(good, linear_model(weights), class_ids)
    return rounded(run_to_table(scored, "stream-scores"))


_DAMAGED_SQL = """
    SELECT *, CASE WHEN embedding[1] > 0.2 THEN 'missing features'
                   WHEN embedding[2] > 0.2 THEN 'wrong length'
                   WHEN embedding[3] > 0.2 THEN 'not finite' END AS fault FROM embeddings
"""


@query(
    "i4_dead_letters",
    f"""
    SELECT d.vec_id AS sample_id, CASE WHEN fault IS NULL THEN prediction END AS prediction,
           CASE WHEN fault IS NULL THEN logit END AS logit, fault
    FROM ({_DAMAGED_SQL}) d LEFT JOIN ({_SCORES_SQL}) s ON s.sample_id = d.vec_id
    """,
)
def dead_letters(spark, base):
    """A stream scored twice on one checkpoint: what can't be scored comes out beside the scores, once."""
    samples = vector_samples(spark, base)
    width = feature_width(samples)
    class_ids, weights = load_weights(prototype_model(samples, width))
    stream = table_stream(spark, base, "embeddings").select(
        F.col("vec_id").alias("sample_id"), _damaged(F.col("embedding")).alias("features")
    )
    folder = scratch_dir(spark, "dead-letters")
    for _ in range(2):
        scored, faulty = run_scoring(
            stream,
            lambda rows: split_faulty(rows, width),
            lambda rows: score_batches(rows, linear_model(weights), class_ids),
            folder,
        )
    letters = faulty.select("sample_id", "fault")
    out = scored.unionByName(letters, allowMissingColumns=True)
    return rounded(out.select("sample_id", "prediction", "logit", "fault"))


@query("i3_argmax_blocks", _SCORES_SQL)
def argmax_blocks(spark, base):
    """The same scores by blocks of samples and classes, as for a model that no task could hold."""
    samples, model, width = _scorable(spark, base)
    return rounded(score_blocks(samples, model, weights=3 * width))


@query(
    "i5_failing_batches",
    f"""
    WITH n AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch_id FROM embeddings),
    b AS (SELECT batch_id, max(embedding[1]) > {FAILING} AS failed FROM n GROUP BY 1)
    SELECT n.batch_id, n.vec_id AS sample_id, CASE WHEN NOT failed THEN prediction END AS prediction,
           CASE WHEN NOT failed THEN logit END AS logit,
           CASE WHEN failed THEN 'ValueError: out of range' END AS error
    FROM n JOIN b USING (batch_id) JOIN ({_SCORES_SQL}) s ON s.sample_id = n.vec_id
    """,
)
def failing_batches(spark, base):
    """A model that refuses some batches of sixteen loses those and no others."""
    samples, model, _ = _scorable(spark, base)
    class_ids, weights = load_weights(model)

    def load():
        transposed = np.ascontiguousarray(weights.T)

        def forward(features):
            if features[:, 0].max() > np.float32(FAILING):
                raise ValueError("out of range")
            return features.astype(np.float64) @ transposed

        return forward

    batched = mini_batches(with_ordinal(samples, "sample_id"), 16)
    return rounded(score_tasks(batched, load, class_ids))


@query(
    "i5_quarantine",
    """
    SELECT coalesce(fault, 'scored') AS outcome, count(*) AS samples FROM (
        SELECT CASE WHEN embedding[1] > 0.2 THEN 'missing features'
                    WHEN embedding[2] > 0.2 THEN 'wrong length'
                    WHEN embedding[3] > 0.2 THEN 'not finite' END AS fault
        FROM embeddings) GROUP BY 1
    """,
)
def quarantine(spark, base):
    damaged = _damaged(F.col("features"))
    samples = vector_samples(spark, base)
    width = feature_width(samples)
    _, weights = load_weights(prototype_model(samples, width))
    good, bad = split_faulty(samples.withColumn("features", damaged), width)
    scored = score_batches(good, linear_model(weights)).select(F.lit("scored").alias("outcome"))
    outcomes = scored.unionByName(bad.select(F.col("fault").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("samples"))


@query(
    "i6_user_model",
    "SELECT vec_id AS sample_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) "
    "AS prediction, round(CAST(list_max(embedding) AS DOUBLE), 6) AS logit FROM embeddings",
)
def user_model(spark, base):
    """Any callable can be the model; here the features are the logits."""
    samples = vector_samples(spark, base)
    good, _ = split_faulty(samples, feature_width(samples))
    return rounded(score_batches(good, lambda: np.asarray))


@query(
    "a16_observed_scoring",
    f"SELECT count(*) AS rows, count(prediction) AS predicted, min(prediction) AS lowest, "
    f"max(prediction) AS highest FROM ({_SCORES_SQL})",
)
def observed_scoring(spark, base):
    """Counts taken while the scores are written, without a second pass."""
    samples, model, _ = _scorable(spark, base)
    class_ids, weights = load_weights(model)
    scores, seen = observed(score_batches(samples, linear_model(weights), class_ids), "scoring")
    scores.write.parquet(scratch_dir(spark, "observed-scores"))
    facts = seen.get
    return spark.createDataFrame(
        [(facts["rows"], facts["predicted"], facts["lowest"], facts["highest"])],
        "rows bigint, predicted bigint, lowest int, highest int",
    )


@query(
    "a16_measured_scoring",
    """
    SELECT CAST(workers AS INTEGER) AS workers, count(*) AS total_inferences,
           CAST(workers AS BIGINT) AS completed_tasks, true AS measured
    FROM embeddings, (VALUES (1), (2), (4)) k(workers) GROUP BY workers
    """,
)
def measured_scoring(spark, base):
    """Shards scored for real: each task reports its own time, CPU and memory."""
    samples, model, _ = _scorable(spark, base)
    _, weights = load_weights(model)
    numbered, count = number_rows(samples, "sample_id")
    sizes = [1, 2, 4]
    shard = [contiguous_part(F.col("ordinal"), F.lit(count), k) for k in sizes]
    cells = F.array(
        *[
            F.struct(
                F.lit("sharded").alias("approach"),
                F.lit(k).alias("workers"),
                worker.alias("worker"),
                worker.cast("bigint").alias("task_id"),
            )
            for k, worker in zip(sizes, shard)
        ]
    )
    assigned = numbered.select("features", F.inline(cells))
    # What was measured is kept: measuring again would give other numbers.
    tasks = written(measured_tasks(assigned, linear_model(weights)), "measured")
    runs = run_metrics(tasks, 1.0)
    return runs.select(
        "workers",
        "total_inferences",
        "completed_tasks",
        ((F.col("throughput") > 0) & (F.col("avg_memory_mb") > 0)).alias("measured"),
    )
