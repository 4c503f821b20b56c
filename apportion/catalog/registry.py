"""Registration of queries and the SQL text shared by their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

# Readings and durations are compared to this many decimals. Readings of single
# tasks are hundredths over 128 rows, which end at the ninth decimal; fewer
# would make exact ties, which engines round differently.
DECIMALS = 6
TASK_DECIMALS = 9


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = function
        if sql is not None:
            _oracles[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)


def rounded(table: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Doubles to the compared precision."""
    return table.select(
        *[F.round(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes]
    )


# SQL for the samples of the event stream; a sample's number is its position.
SAMPLES_SQL = """
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq,
           epoch_us(ts) AS arrival_us,
           CAST(round(value * 10 * 1e6) AS BIGINT) AS service_us,
           concat_ws('|', event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), props)
               AS content,
           CAST(round(value * 100) AS BIGINT) % 10000 AS cpu_centi,
           user_id + 100 AS memory_mb,
           user_id,
           event_type
    FROM events
"""

# SQL for orders numbered by date, then key.
ORDERS_SQL = """
    SELECT o_orderkey, o_totalprice, count(*) OVER () AS n,
           row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal
    FROM orders
"""


def shard_sql(content: str, workers: str) -> str:
    return f"CAST(('0x' || substr(md5({content}), 1, 8))::BIGINT % {workers} AS INTEGER)"
