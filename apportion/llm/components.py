"""Connected components by stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.session import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest member, for the ends of ``links`` (a, b).

    Every round points the larger neighbours of a node at its smallest neighbour
    (large star), then the smaller ones (small star); the number of links never grows
    and a chain halves each round. A round is written before the next, so
    a lost executor costs its tasks only.
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = state
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-star")
        small = _star(large)
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
            small.select("a", F.col("low").alias("b"))
        )
        edges = written(small.where("a <> b").distinct(), "small-star")


def _star(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``low``, the smallest of a and everything beside it."""
    low = pairs.groupBy("a").agg(F.min("b").alias("near"))
    return pairs.join(low, "a").select("a", "b", F.least("a", "near").alias("low"))
