"""Rank-one updates against a dense solver, and whole tables against numpy."""

import math

import numpy as np
import pytest

from apportion.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, c string, x int"


def dense(rows):
    centred = rows - rows.mean(axis=0)
    return centred.T @ centred


@pytest.mark.parametrize("rows", [
    np.random.default_rng(1).integers(-99, 99, (400, 12)),
    np.random.default_rng(2).integers(0, 2, (60, 7)),
    np.outer(np.arange(30), [1, -2, 3, 0]) + [5, 5, 5, 5],
    np.vstack([np.eye(6, dtype=int) * 9, -np.eye(6, dtype=int) * 9]),
    np.random.default_rng(3).integers(-3, 3, (50, 9)) * np.array([1, 10, 100, 1000, 10**4, 10**5, 10**6, 1, 1]),
    np.full((5, 3), 7),
])
def test_updates_and_merges(rows):
    want = dense(rows)
    one, parts = w.Spectrum.empty(rows.shape[1]), [w.Spectrum.empty(rows.shape[1]) for _ in range(3)]
    for row in rows:
        one.add(row[None, :])
    for i, part in enumerate(parts):
        part.add(rows[i::3])
    for part in parts[1:]:
        parts[0].merge(w.Spectrum.of(part.row()))
    for got in (one, parts[0]):
        assert got.n == len(rows) and got.sums == rows.sum(axis=0).tolist()
        scale = max(1.0, np.abs(want).max())
        assert np.abs((got.vectors * got.values) @ got.vectors.T - want).max() < 1e-11 * scale
        assert np.abs(got.vectors.T @ got.vectors - np.eye(rows.shape[1])).max() < 1e-11


def brute(vectors):
    """vec_id -> rows, by numpy in one piece."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    x = np.array([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh(dense(fit) / n)
    e, q = e[::-1], q[:, ::-1]
    y = (x - sums / n) @ q[:, :4] / np.sqrt(e[:4])
    dev = ((n * x - sums) ** 2).sum(axis=1)
    return n, dev, y, e[:4] / e.sum(), kept


def test_table_is_whitened(spark):
    pick = np.random.default_rng(5)
    scales = np.linspace(3, 0.5, 9)
    vectors = [(i if i % 7 else None, (pick.normal(size=9) * scales).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[4][1]) for i in range(40)]
    bad = [(-1, None), (-2, []), (-3, [None] + [0.0] * 8), (-4, [math.nan] + [0.0] * 8), (-5, [math.inf] + [0.0] * 8), (-6, [1.0] * 8),
           (-7, [1e38] + [0.0] * 8)]
    rows = [(i, v, "own", 1) for i, v in vectors + bad]
    table = spark.createDataFrame(rows, SCHEMA).repartition(23)
    found = w.whitened(table).collect()
    n, dev, y, explained, kept = brute(vectors)
    assert n == 300 and len(found) == 4 * len(kept)
    assert {(r.n, r.identity_error < 1e-10) for r in found} == {(300, True)}
    by = {}
    for r in found:
        by.setdefault((r.deviation, r.component), []).append(r)
    signs = {}
    for row, (vec_id, _) in enumerate(kept):
        for k in range(4):
            got = [r for r in by[(int(dev[row]), k + 1)] if r.vec_id == vec_id][0]
            assert got.explained == pytest.approx(explained[k], rel=1e-10)
            assert abs(got.whitened) == pytest.approx(abs(y[row, k]), rel=1e-8, abs=1e-9)
            if abs(y[row, k]) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(got.whitened * y[row, k]))
    assert all(len(s) == 1 for s in signs.values())


def test_no_variance_few_dimensions_and_no_rows(spark):
    def run(vectors):
        rows = [(i, v, "own", 1) for i, v in enumerate(vectors)]
        return [tuple(r) for r in w.whitened(spark.createDataFrame(rows, SCHEMA)).collect()]

    assert run([]) == []
    assert run([None, [math.nan]]) == []
    assert run([[1.0, 2.0]] * 2) == [(i, k, 1, 0, None, None, None) for i in range(2) for k in (1, 2)]
    line = run([[0.0, 1.0, 2.0], [1.0, 1.0, 2.0]])
    assert [(r[1], None if r[4] is None else abs(round(r[4], 9)), round(r[5], 9), round(r[6], 9)) for r in line] == [
        (1, 1.0, 1.0, 0.0), (2, None, 0.0, 0.0), (3, None, 0.0, 0.0)
    ] * 2


def test_wide_integers_are_exact():
    rows = np.array([[1 << 50, 3], [-(1 << 50), 4]], dtype=np.int64)
    assert w.column_sums(np.repeat(rows, 3000, axis=0)) == [0, 21000]
    assert w.deviations(rows, 2, [0, 7]) == [None, None]
    assert w.deviations(np.array([[1 << 30, 0]]), 2, [5, 0]) == [((1 << 31) - 5) ** 2]
