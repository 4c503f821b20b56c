from collections import Counter

import pytest
from pyspark.sql import functions as F

from apportion.operators import assign as rules
from apportion.sources import event_samples, mini_batches, read_table

SIZES = [0, 1, 2, 3, 7, 10, 1000]
PARTS = [1, 2, 3, 4, 5, 8]


def numbered(spark, n):
    return spark.range(n).withColumnRenamed("id", "ordinal")


def counts(table, column="worker"):
    return dict(sorted((r[column], r["count"]) for r in table.groupBy(column).count().collect()))


def worker_list(table, column="worker"):
    return [r[column] for r in table.orderBy("ordinal").collect()]


def contiguous_model(n, parts):
    run = n // parts
    return [parts - 1 if run == 0 else min(i // run, parts - 1) for i in range(n)]


@pytest.mark.parametrize("n", SIZES)
def test_contiguous_split(spark, n):
    table = numbered(spark, n)
    for parts in PARTS:
        split = rules.contiguous_split(table, parts, n)
        assert worker_list(split) == contiguous_model(n, parts)


@pytest.mark.parametrize("n", [1, 7, 300])
def test_rank_slices_cut_every_batch(spark, n):
    for workers in PARTS:
        expected = []
        for start in range(0, n, 128):
            expected += contiguous_model(min(128, n - start), workers)
        assert worker_list(rules.rank_slices(numbered(spark, n), workers, 128, n)) == expected


def test_literal_expectations(spark):
    split = lambda n, k: counts(rules.contiguous_split(numbered(spark, n), k, n))
    chunk = lambda n, k: counts(rules.ceil_chunks(numbered(spark, n), k, n))
    assert split(10, 4) == {0: 2, 1: 2, 2: 2, 3: 4}
    assert split(3, 8) == {7: 3}
    assert chunk(10, 4) == {0: 3, 1: 3, 2: 3, 3: 1}
    assert chunk(5, 4) == {0: 2, 1: 2, 2: 1}
    ranks = rules.rank_slices(numbered(spark, 10_000), 3, 128, 10_000)
    assert counts(ranks) == {0: 3281, 1: 3281, 2: 3438}


def test_chunks_keep_a_short_tail_and_are_dealt_in_turn(spark):
    chunks = rules.fixed_chunks(numbered(spark, 1000), 128)
    assert counts(chunks, "chunk_id") == {**{i: 128 for i in range(7)}, 7: 104}
    dealt = rules.round_robin(chunks.select("chunk_id").distinct(), 3)
    assert all(r["worker"] == r["chunk_id"] % 3 for r in dealt.collect())


def test_mini_batches(spark):
    batched = mini_batches(numbered(spark, 300), 128)
    assert counts(batched, "batch_id") == {0: 128, 1: 128, 2: 44}


def test_sub_chunks_only_in_oversized_shards(spark):
    shards = rules.contiguous_split(numbered(spark, 103), 4, 103, "shard")
    pieces = rules.sub_chunks(shards, True, 25, 4, 103)
    assert counts(pieces.filter("shard < 3"), "sub_chunk") == {0: 75}
    assert counts(pieces.filter("shard = 3"), "sub_chunk") == {0: 25, 1: 3}
    assert counts(rules.sub_chunks(shards, False, 5, 4, 103), "sub_chunk") == {0: 103}


def test_stream_strategies(spark, sf_dir):
    samples = event_samples(spark, sf_dir)
    n = samples.count()
    assert counts(rules.assign(samples, "uniform", 4)) == {w: n // 4 for w in range(4)}
    assert counts(rules.assign(samples, "dynamic", 3)) == {w: n for w in range(3)}
    sharded = rules.assign(samples, "sharded", 4)
    assert sum(counts(sharded).values()) == n


def test_equal_content_shares_a_worker_even_when_hot(spark):
    content = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    samples = spark.range(3000).select(F.col("id").alias("seq"), content.alias("content"))
    workers = rules.assign(samples, "sharded", 4).groupBy("content").agg(
        F.count_distinct("worker").alias("w")
    )
    assert workers.filter("w > 1").count() == 0


def test_hash_shards_of_documents(spark):
    documents = read_table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    samples = documents.select(F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    assert counts(rules.assign(samples, "sharded", 4)) == {0: 261, 1: 252, 2: 257, 3: 230}


def test_layout_spreads_a_hot_worker_over_tasks(spark):
    hot = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(1).alias("worker"))
    laid_out = rules.lay_out_by_worker(hot, 2, "id", 8).withColumn("task", F.spark_partition_id())
    tasks = {r["task"]: r["workers"] for r in laid_out.groupBy("task").agg(
        F.count_distinct("worker").alias("workers")).collect()}
    assert set(tasks.values()) == {1} and len(tasks) == 7
    assert laid_out.groupBy("task").count().agg(F.max("count")).first()[0] < 800
    assert Counter(r["worker"] for r in laid_out.collect()) == {0: 2666, 1: 1334}


def test_bad_parameters_fail_before_any_job(spark):
    table = numbered(spark, 1)
    for call in (
        lambda: rules.assign(table, "random", 2),
        lambda: rules.assign(table, "uniform", 0),
        lambda: rules.check_approach("other"),
        lambda: rules.contiguous_split(table, 0, 1),
        lambda: rules.fixed_chunks(table, 0),
        lambda: mini_batches(table, 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_sizes_and_rates_are_checked_before_any_job(spark):
    from apportion.operators.assign import sub_chunks
    from apportion.plans.stream_matrix import worker_outcomes

    rows = spark.range(5).selectExpr("id AS ordinal", "0 AS shard")
    for wrong in ({"chunk_size": 0, "shards": 1}, {"chunk_size": 3, "shards": 0}):
        with pytest.raises(ValueError):
            sub_chunks(rows, True, count=5, **wrong)
    with pytest.raises(ValueError):
        worker_outcomes(rows, rates=[0])
