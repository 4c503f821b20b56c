"""Canonical text of a sample, and the shard that text belongs to.

A content shard has to be the same in every process and on every engine, so it
is derived from MD5 rather than from a seeded or engine-specific hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Stands for a missing part, so that differing contents keep differing texts.
MISSING = "\\N"


def event_content(event_type: Column, value: Column, props: Column) -> Column:
    cents = F.round(value * 100).try_cast("bigint").cast("string")
    return F.concat_ws("|", *[F.coalesce(c, F.lit(MISSING)) for c in (event_type, cents, props)])


def vector_content(vector: Column) -> Column:
    """Elements to six decimals; equal to that precision is equal content.

    What is no number of that size (NaN, infinity) keeps its own text.
    """

    def text(x: Column) -> Column:
        scaled = F.round(x.cast("double") * 1e6)
        return F.coalesce(scaled.try_cast("bigint").cast("string"), scaled.cast("string"), F.lit(MISSING))

    return F.array_join(F.transform(vector, text), ",")


def content_hash(content: Column) -> Column:
    """The first 32 bits of the content's MD5, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("bigint")


def content_shard(content: Column, workers: Column | int) -> Column:
    return (content_hash(content) % _col(workers)).cast("int")


def _col(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
