from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from apportion.operators.ordinal import number_rows, with_ordinal
from apportion.sources import read_table


def ordinals(table, key):
    return {row[key]: row["ordinal"] for row in table.collect()}


def test_many_ranges_match_a_sort(spark):
    table = spark.range(1000).select((((F.col("id") * 7919) % 1000) * 3).alias("k"))
    numbered, count = number_rows(table, "k", rows_per_range=37)
    assert count == 1000
    assert ordinals(numbered, "k") == {k * 3: k for k in range(1000)}


def test_gapless_integers_are_positions_already(spark):
    table = spark.range(1000).select((((F.col("id") * 7919) % 1000) - 40).alias("k"))
    numbered, count = number_rows(table, "k")
    assert count == 1000
    assert ordinals(numbered, "k") == {k - 40: k for k in range(1000)}
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[0, 0, 2], [5, 7, 7, 8], [None, 1, 2], [1, 2, 2, 3, 5]])
def test_repeats_and_gaps_are_not_taken_for_positions(spark, keys):
    table = spark.createDataFrame([(k,) for k in keys], "k int")
    numbered = with_ordinal(table, "k").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in numbered] == list(range(len(keys)))
    assert [r["k"] for r in numbered] == sorted(keys, key=lambda k: (k is not None, k))


def test_filters_on_a_gapless_position_reach_the_scan(spark, sf_dir):
    orders = with_ordinal(read_table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey")
    plan = orders.filter("ordinal < 10")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderkey,10)" in plan


def test_hot_leading_key_is_cut_by_the_second_key(spark):
    table = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("a"),
        (-F.col("id")).alias("b"),
    )
    rows = sorted((r["a"], r["b"]) for r in table.collect())
    numbered = with_ordinal(table, "a", "b", rows_per_range=50)
    assert {(r["a"], r["b"]): r["ordinal"] for r in numbered.collect()} == {
        row: i for i, row in enumerate(rows)
    }
    # Three hundred rows share the key; no range holds many more than asked for.
    assert numbered.filter("a = 'hot'").count() == 300


def test_nulls_come_first(spark):
    table = spark.createDataFrame([(None, 1), (3, 2), (1, 3), (None, 0)], "a int, b int")
    numbered = with_ordinal(table, "a", "b", rows_per_range=1)
    assert [r["b"] for r in numbered.orderBy("ordinal").collect()] == [0, 1, 3, 2]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_times_order_with_fractions(spark, kind):
    start = datetime(2024, 3, 31, 0, 0)
    step = timedelta(days=1) if kind == "date" else timedelta(minutes=7, microseconds=10)
    rows = [(str(start + i * step), i) for i in range(200)]
    table = spark.createDataFrame(rows, "t string, i long").withColumn("t", F.col("t").cast(kind))
    numbered = with_ordinal(table.repartition(5), "t", rows_per_range=20)
    assert all(r["i"] == r["ordinal"] for r in numbered.collect())


def test_empty_table(spark):
    numbered, count = number_rows(spark.range(0), "id")
    assert count == 0 and numbered.count() == 0


def test_needs_a_key(spark):
    with pytest.raises(ValueError):
        with_ordinal(spark.range(3))


def test_no_window_runs_over_the_whole_table(spark):
    gaps = spark.range(0, 2000, 2)
    numbered = with_ordinal(gaps, "id", rows_per_range=100)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "double", "binary", "boolean"])
def test_keys_of_every_kind(spark, kind):
    texts = ["0", "-1.5", "2.25", "10", "3", "true", "é", "zz", 'a"b', "9007199254740993"]
    usable = [t for t in texts if kind in ("string", "binary") or t.replace("-", "").replace(".", "").isdigit()]
    if kind == "boolean":
        usable = ["true", "false"] * 3
    table = spark.createDataFrame([(t, i) for i, t in enumerate(usable)], "t string, i int")
    table = table.withColumn("k", F.col("t").cast(kind))
    numbered = with_ordinal(table, "k", "i", rows_per_range=1).orderBy("ordinal").collect()
    ordered = table.orderBy("k", "i").collect()
    assert [r["i"] for r in numbered] == [r["i"] for r in ordered]
    assert [r["ordinal"] for r in numbered] == list(range(len(usable)))
