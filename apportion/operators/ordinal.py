"""Dense 0-based positions in a total order, without a global sort.

A single integer key without gaps is taken as it is. For other keys, the rows
are cut into key ranges at split points fixed up front. One narrow pass counts
the rows of each range; a window numbers the rows inside a range, and the
running total of the counts before it is added. The ranges are sized so that
none outgrows a task, whatever the number of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apportion.functions.constants import constant

ROWS_PER_RANGE = 1 << 21
MIN_ROWS_PER_RANGE = 1 << 12
MAX_RANGES = 1 << 15
SAMPLED_KEYS_PER_RANGE = 64
MAX_SAMPLED_KEYS = 1 << 18
_RANGE = "__range"


def with_ordinal(
    table: DataFrame,
    *keys: str,
    name: str = "ordinal",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add the position of each row when ordered by ``keys``, nulls first.

    The keys have to identify a row. A leading key may be heavily repeated:
    the ranges are cut on all keys together, so a hot value spans many ranges.
    """
    return number_rows(table, *keys, name=name, rows_per_range=rows_per_range)[0]


def number_rows(
    table: DataFrame,
    *keys: str,
    name: str = "ordinal",
    rows_per_range: int | None = None,
) -> tuple[DataFrame, int]:
    """As :func:`with_ordinal`, together with the number of rows."""
    if not keys:
        raise ValueError("an ordinal needs at least one ordering key")
    count, first = _dense_run(table, keys[0]) if len(keys) == 1 else (table.count(), None)
    if first is not None:
        position = F.col(keys[0]).cast("bigint")
        return table.withColumn(name, position - first if first else position), count
    ranges = _range_count(table, count, rows_per_range)
    leading, splits = _split_points(table, keys, count, ranges)
    if not splits:
        window = Window.partitionBy(F.lit(0)).orderBy(*keys)
        return table.withColumn(name, _position(window)), count

    ranged = table.withColumn(_RANGE, _locate(table, leading, splits))
    # One row per range comes back, at most MAX_RANGES of them.
    sizes = {row[0]: row[1] for row in ranged.groupBy(_RANGE).count().collect()}
    starts, total = [], 0
    for index in range(len(splits) + 1):
        starts.append(total)
        total += sizes.get(index, 0)
    start = F.get(constant(starts, "array<bigint>"), F.col(_RANGE))
    window = Window.partitionBy(_RANGE).orderBy(*keys)
    return ranged.withColumn(name, _position(window) + start).drop(_RANGE), total


def _dense_run(table: DataFrame, key: str) -> tuple[int, int | None]:
    """Row count, and the smallest key if the keys are a gapless run of integers.

    Such a key already is a position up to a shift: no sort and no shuffle, and
    if it starts at zero, filters on the position reach the scan. Extremes and
    count leave only repeats to rule out; two 64-bit sums over hashes of the
    keys do that, by comparison with those of the run itself.
    """
    if not isinstance(table.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return table.count(), None
    value = F.col(key).cast("bigint")
    prints = [F.bit_xor(F.xxhash64(value)), F.bit_xor(F.xxhash64(value, F.lit(1)))]
    count, present, low, high, *seen = table.agg(
        F.count(F.lit(1)), F.count(value), F.min(value), F.max(value), *prints
    ).first()
    if count == 0 or present != count or high - low + 1 != count:
        return count, None
    run = table.sparkSession.range(low, high + 1).withColumnRenamed("id", key)
    return count, low if list(run.agg(*prints).first()) == seen else None


def _position(window) -> Column:
    return (F.row_number().over(window) - 1).cast("bigint")


def _range_count(table: DataFrame, count: int, rows_per_range: int | None) -> int:
    if rows_per_range is not None:
        return min(MAX_RANGES, max(1, -(-count // rows_per_range)))
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for_parallelism = min(tasks, count // MIN_ROWS_PER_RANGE)
    return min(MAX_RANGES, max(1, for_parallelism, -(-count // ROWS_PER_RANGE)))


def _sortable(table: DataFrame, key: str) -> Column:
    """A key as a type whose literals compare as the key does."""
    kind = table.schema[key].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.TimestampNTZType):
        return F.col(key).cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(key)
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    return F.col(key)


def _split_points(
    table: DataFrame, keys: Sequence[str], count: int, ranges: int
) -> tuple[Sequence[str], list[tuple]]:
    """Evenly spaced keys of a sample, cut to the leading keys that tell them apart.

    The sample only places the cuts. Rows that agree on the leading keys stay
    in one range, so those keys are as few as leave no value with more than a
    fair share of the sample.
    """
    if ranges < 2:
        return keys, []
    wanted = min(ranges * SAMPLED_KEYS_PER_RANGE, MAX_SAMPLED_KEYS)
    key_columns = table.select(*[_sortable(table, key).alias(key) for key in keys])
    if wanted < count:
        key_columns = key_columns.sample(fraction=wanted / count, seed=7)
    sampled = [tuple(row) for row in key_columns.orderBy(*keys).collect()]
    fair_share = max(1, len(sampled) // ranges // 4)
    width = next(
        (
            w
            for w in range(1, len(keys))
            if max(Counter(row[:w] for row in sampled).values(), default=0) <= fair_share
        ),
        len(keys),
    )
    cuts = [sampled[len(sampled) * i // ranges][:width] for i in range(1, ranges) if sampled]
    return keys[:width], [cut for i, cut in enumerate(cuts) if i == 0 or cut != cuts[i - 1]]


def _locate(table: DataFrame, keys: Sequence[str], splits: list[tuple]) -> Column:
    """How many split points are at or below the key, by halving steps."""
    kinds = table.select(*[_sortable(table, key).alias(key) for key in keys]).schema

    if len(keys) == 1:
        kind = kinds[0].dataType.simpleString()
        points = constant([split[0] for split in splits], f"array<{kind}>")
    else:
        fields = ",".join(f"k{i}:{field.dataType.simpleString()}" for i, field in enumerate(kinds))
        rows = [{f"k{i}": v for i, v in enumerate(split)} for split in splits]
        points = constant(rows, f"array<struct<{fields}>>")
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(splits).bit_length()))])

    def search(key: Column) -> Column:
        return F.aggregate(
            steps,
            F.lit(0),
            lambda low, width: F.when(
                F.get(points, low + width - 1) <= key, low + width
            ).otherwise(low),
        )

    # Inside the array the key is built once per row, not once per step.
    parts = [_sortable(table, key).alias(f"k{i}") for i, key in enumerate(keys)]
    key = parts[0] if len(parts) == 1 else F.struct(*parts)
    return F.transform(F.array(key), search)[0]
