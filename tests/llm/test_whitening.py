"""Whitening against a dense eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm.whitening import corrections, eigenpairs, train_whitening, whitening


def usable(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, dims, components):
    """({vec_id: (deviation, whitened)}, n, explained) by whole matrices; rows (vec_id, vector)."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows if usable(v, dims)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        d = [n * a - s for a, s in zip(v, sums)]
        out[i] = (sum(a * a for a in d), np.array(d) / n @ vectors / np.sqrt(values))
    return out, n, values / np.trace(centred.T @ centred / n)


def check(rows, got, dims, components):
    wanted, n, explained = brute(rows, dims, components)
    by_row = {}
    for r in got:
        assert r.n == n and r.deviation == wanted[r.vec_id][0] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        by_row.setdefault(r.vec_id, {})[r.component] = r.whitened
    assert set(by_row) == set(wanted) and all(sorted(v) == list(range(1, components + 1)) for v in by_row.values())
    ids = sorted(wanted)
    for k in range(components):
        ours, theirs = np.array([by_row[i][k + 1] for i in ids]), np.array([wanted[i][1][k] for i in ids])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8


def test_whitened_coordinates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) * np.linspace(2, 0.3, 12) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, rows) for i, rows in enumerate([x[0].tolist()] * 40)]
    rows += [(-1, None), (-2, [1.0] * 11 + [None]), (-3, [float("nan")] * 12), (-4, [float("inf")] * 12), (-5, [1.0]), (-6, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    check(rows, whitening(docs, 5, 12).collect(), 12, 5)


def test_all_embeddings(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    check(rows, whitening(docs).collect(), 64, 16)


@pytest.mark.parametrize("values", (np.arange(40, 0, -1.0), np.array([5.0] * 3 + [4.0] * 20 + [1.0] * 17), 10.0 ** -np.arange(40)))
def test_pairs_by_products_alone(values):
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(40, 40)))[0]
    a = (turn * values) @ turn.T
    asked = []

    def product(u):
        asked.append(u.shape[1])
        return a @ u

    found, vectors, worst = eigenpairs(product, 40, 8)
    assert np.abs(found - values[:8]).max() < 1e-12 * values[0] and worst <= 1e-13 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-12 * values[0]
    assert max(asked) <= 12  # a block at a time, never the whole matrix


def test_corrections_solve_the_projected_equation():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    fixed = [np.linalg.qr(rng.normal(size=(20, k)))[0] for k in (1, 4)]
    shifts, residuals = np.array([0.3, -2.0]), np.column_stack([(np.eye(20) - q @ q.T) @ rng.normal(size=20) for q in fixed])
    t = corrections(lambda u: a @ u, shifts, fixed, residuals, 1e-12, 60)
    for j, q in enumerate(fixed):
        p = np.eye(20) - q @ q.T
        assert np.abs(p @ (a - shifts[j] * np.eye(20)) @ p @ t[:, j] + residuals[:, j]).max() < 1e-8 and np.abs(q.T @ t[:, j]).max() < 1e-10


def test_rank_constant_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, Component string, n string, x string"
    docs = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], None, "c", "n" * 100_000, None) for i in range(10)] + [(None, [0.0, 0.0, 1.0], 1, None, "", "")], schema)
    got = whitening(docs, 3, 3)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert len(rows) == 11 and {r.component for r in rows} == {1} and {r.n for r in rows} == {10} and abs(rows[0].explained - 1) < 1e-12
    assert sum(r.vec_id is None for r in rows) == 1
    for none in (docs.limit(0), docs.where("vec_id = 3"), spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")):
        assert whitening(none, 3, 3).count() == 0


def test_a_deviation_that_a_long_cannot_hold_is_null(spark):
    docs = spark.createDataFrame([(i, [1e8 * i, 0.0]) for i in range(3)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in whitening(docs, 1, 2).collect()}
    assert rows[0].deviation is None and rows[1].deviation == 0 and abs(abs(rows[2].whitened) - math.sqrt(1.5)) < 1e-12
    assert train_whitening(docs, 2, 2).values.shape == (1,)
