"""Exact top-k by inner product with M-trees, searched best first.

Vectors are whole numbers. With one more component, sqrt(M - |p|^2) for the
greatest squared norm M, and 0 for a query, the inner product falls as the
distance grows: d^2 = |q|^2 + M - 2 q.p. So an M-tree over distances answers it.

Rows are dealt by a hash of their id to shards of a bounded size. Every shard
builds one tree: pages of entries around routing vectors with covering radii,
each entry with its distance to the page's own routing vector. A search visits
pages in the order of their lower bounds and skips entries by the triangle
inequality before any distance is computed. Queries meet shards in bounded
blocks, and the best of all shards are merged. Final scores are integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 13
QUERY_ROWS = 1 << 12
PAGE = 512
# Whole numbers up to this size are exact in floating point, which multiplies faster.
_EXACT = float(1 << 52)
_SLACK = 1e-6


@dataclass
class Page:
    """Entries around a routing vector: vectors of a leaf, or pages below."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    pages: list["Page"] | None
    to_parent: np.ndarray
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


class MTree:
    """An M-tree over the rows of one shard, loaded in bulk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, page: int = PAGE):
        self.ids, self.vectors, self.page = ids, vectors, page
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        lift = np.sqrt(np.maximum(top - norms, 0.0))
        self.points = np.column_stack([vectors.astype(np.float64), lift])
        self.top = top
        self.computed = 0
        # No partial sum of a product exceeds the greatest squared norm times the length.
        if top * max(1, vectors.shape[-1]) < _EXACT:
            self.vectors = vectors.astype(np.float64)
        every = np.arange(len(ids))
        self.root = self._load(every, self.points.mean(axis=0)) if len(ids) else None

    def _load(self, rows: np.ndarray, centre: np.ndarray) -> Page:
        away = _distances(self.points[rows], centre)
        radius = float(away.max())
        if len(rows) <= self.page:
            return Page(centre, radius, rows, None, away)
        k = min(self.page, -(-len(rows) // self.page) * 2)
        # Routing vectors at even steps of the order by distance; equal rows are cut evenly.
        order = np.argsort(away, kind="stable")
        routes = self.points[rows[order[np.linspace(0, len(rows) - 1, k).astype(int)]]]
        near = (
            (routes**2).sum(axis=1)[None, :] - 2.0 * self.points[rows] @ routes.T
        ).argmin(axis=1)
        parts = [rows[near == i] for i in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:
            parts = np.array_split(rows, k)
        below = [self._load(p, self.points[p].mean(axis=0)) for p in parts]
        centres = np.array([b.centre for b in below])
        return Page(
            centre, radius, None, below, _distances(centres, centre), centres,
            np.array([b.radius for b in below]),
        )

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) but for the query's own id, ties to the smaller id."""
        if self.root is None:
            return []
        q = query.astype(np.float64)
        at = np.append(q, 0.0)
        base = float(q @ q) + self.top
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        reach = np.inf
        start = float(_distances(self.root.centre[None, :], at)[0])
        heap = [(max(0.0, start - self.root.radius), 0, start, self.root)]
        serial = 0
        while heap:
            low, _, to_centre, page = heapq.heappop(heap)
            if low > reach:
                break
            gap = np.abs(to_centre - page.to_parent)
            if page.pages is None:
                rows = page.rows[gap <= reach]
                self.computed += len(rows)
                scores = self.vectors[rows] @ query.astype(self.vectors.dtype)
                if len(best) == k:
                    keep = scores >= best[0][0]
                    rows, scores = rows[keep], scores[keep]
                for score, name in zip(map(int, scores.tolist()), self.ids[rows].tolist(), strict=True):
                    if name == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -name))
                    elif (score, -name) > best[0]:
                        heapq.heapreplace(best, (score, -name))
                if len(best) == k:
                    reach = np.sqrt(max(0.0, base - 2.0 * best[0][0])) + _SLACK
                continue
            some = np.flatnonzero(gap - page.radii <= reach)
            self.computed += len(some)
            away = _distances(page.centres[some], at)
            lows = np.maximum(away - page.radii[some], 0.0)
            for i in np.flatnonzero(lows <= reach).tolist():
                serial += 1
                heapq.heappush(heap, (float(lows[i]), serial, float(away[i]), page.pages[some[i]]))
        return [(s, -n) for s, n in sorted(best, reverse=True)]


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and floor(scale * x) of each component, x as double.

    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do
    rows without an id.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return table.where(F.col("vec_id").isNotNull() & finite & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(doubles, lambda x: F.floor(x * scale).cast("bigint")).alias("v"),
    )


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each query the k highest inner products with all other rows.

    ``vectors`` has vec_id and v, whole numbers. Only vectors of one length are
    compared with each other. Rows that share an id count as the same vector's:
    a query never meets its id, and equal (query, candidate) pairs show once.
    Fewer candidates give fewer rows; an empty table gives none.
    """
    rows = vectors.withColumn("size", F.size("v")).withColumn("is_query", is_query)
    norm = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    n, queries, top = rows.agg(
        F.count("*"), F.count(F.when(F.col("is_query"), 1)), F.max(norm)
    ).first()
    shards, blocks = -(-n // shard_rows) or 1, -(-queries // query_rows) or 1
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    mine = F.xxhash64("vec_id")
    candidates = rows.select(
        "vec_id", "v", "size", F.pmod(mine, F.lit(shards)).cast("int").alias("shard"),
        every(blocks).alias("block"),
    )
    asked = rows.where("is_query").dropDuplicates(["vec_id", "v"]).select(
        "vec_id", "v", "size", every(shards).alias("shard"),
        F.pmod(mine, F.lit(blocks)).cast("int").alias("block"),
    )
    top = float(top or 0)

    def search(data: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(data) and len(probes):
            data = data.sort_values("vec_id", kind="stable")
            tree = MTree(data.vec_id.to_numpy(), np.array(data.v.tolist(), dtype=np.int64), top)
            for own, vector in zip(probes.vec_id.tolist(), probes.v, strict=True):
                query = np.array(vector, dtype=np.int64)
                found += [(own, n, s) for s, n in tree.search(own, query, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["size", "shard", "block"]
    partial = (
        candidates.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        partial.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
