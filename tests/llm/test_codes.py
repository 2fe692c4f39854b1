"""Vector codes against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes
from tidemark.llm.codes import Cells, books_digest, decode, encode, vector_codes


def brute(rows, parts, entries, rounds, dims):
    """({vec_id: (code, error)}, codebooks) of rows (vec_id, vector) with distinct ids, by plain loops."""
    kept = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)}
    width = dims // parts
    cut = lambda x, p: tuple(x[p * width : (p + 1) * width])
    apart = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b))
    books = [[cut(kept[i], p) for i in sorted(kept)[:entries]] for p in range(parts)]
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (apart(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        found = {i: [nearest(x, p) for p in range(parts)] for i, x in kept.items()}
        new = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(kept[i], p) for i in kept if found[i][p] == e]
                if own:
                    new[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
        books = new
    out = {}
    for i, x in kept.items():
        code = [nearest(x, p) for p in range(parts)]
        out[i] = (code, sum(apart(cut(x, p), books[p][c]) for p, c in enumerate(code)))
    return out, books


def vectors(n, dims, seed, step=None):
    rng = random.Random(seed)
    value = (lambda: rng.randrange(-3, 4) * step) if step else (lambda: rng.gauss(0, 0.2))
    return [(i * 7 % n, [value() for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("step", (None, 1 / 256, 0.25))
def test_codes_and_codebooks(spark, step):
    rows = vectors(151, 8, 3, step) + [(-5, None), (500, [0.0] * 7 + [None]), (501, [float("nan")] * 8), (502, [float("-inf")] + [0.0] * 7), (503, []), (504, [1.0] * 9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]  # as single precision has them
    for rounds in (0, 2):
        got, books = vector_codes(docs, parts=4, entries=10, rounds=rounds, dims=8)
        wanted, plain = brute(rows, 4, 10, rounds, 8)
        assert books.tolist() == [[list(e) for e in b] for b in plain]
        assert {r.vec_id: (r.code, r.error) for r in got.collect()} == wanted


def test_cells_leave_over_the_nearest(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(codes, "REMEMBERED", 40)
    for spread in (1, 6, 3000):
        entries, x = rng.integers(-spread, spread + 1, (24, 3)), rng.integers(-2 * spread, 2 * spread + 1, (900, 3))
        apart = ((x[:, None, :] - entries) ** 2).sum(axis=2)
        cells = Cells(entries)
        for part in np.array_split(x, 7):
            found, error = cells.nearest(part)
            assert found.tolist() == ((part[:, None, :] - entries) ** 2).sum(axis=2).argmin(axis=1).tolist()
        assert len(cells.memory) <= max(40, 900)
        assert (cells.nearest(x)[1] == apart.min(axis=1)).all()
    left = Cells(rng.integers(-3000, 3000, (64, 4))).candidates(rng.integers(-4, 4, (200, 4)))
    assert 1 <= min(map(len, left)) and sum(map(len, left)) < 0.6 * 64 * 200  # most are dominated


def test_repeated_rows_ties_and_few_rows(spark):
    docs = spark.createDataFrame([(1, [0.5, -0.5], "x" * 1_000_000)] * 3 + [(None, [0.25, 0.25], None), (2, [0.5, -0.5], "")], "vec_id long, embedding array<double>, text string")
    got, books = vector_codes(docs, parts=2, entries=4, rounds=1, dims=2)
    assert books.tolist() == [[[(4 * 128 + 64) // 5]] + [[128]] * 3, [[(4 * -128 + 64) // 5]] + [[-128]] * 3]  # all went to the first of equal entries
    rows = got.collect()
    assert len(rows) == 5 and {tuple(r.code) for r in rows if r.vec_id in (1, 2)} == {(1, 1)} and {tuple(r.code) for r in rows if r.vec_id is None} == {(0, 0)}
    assert all(r.error == 0 for r in rows if r.vec_id is not None)


def test_empty_table_clashing_columns_and_large_components(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0], "c", 5, "v"), (2, None, "d", 6, "w")], "vec_id long, embedding array<double>, Code string, error int, vector string")
    got, books = vector_codes(docs, parts=1, entries=3, rounds=2, dims=2)
    assert got.columns == ["vec_id", "embedding", "vector", "code", "error"] and [tuple(r) for r in got.collect()] == [(1, [1.0, 2.0], "v", [0], 0)]
    none, books = vector_codes(docs.where("vec_id = 2"), parts=1, entries=3, rounds=2, dims=2)
    assert none.count() == 0 and books.shape == (1, 0, 2) and none.columns == got.columns
    assert vector_codes(docs.limit(0), parts=1, entries=3, dims=2)[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), parts=1, dims=1)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    docs = spark.createDataFrame(vectors(200, 8, 9), "vec_id long, embedding array<double>")
    got, books = vector_codes(docs, parts=4, entries=16, dims=8)
    for r in got.withColumn("back", decode(F.col("code"), books)).collect():
        assert sum((math.floor(256 * a) - math.floor(256 * b)) ** 2 for a, b in zip(r.embedding, r.back)) == r.error
    assert encode(docs, books).count() == 200 and len(books_digest(books)) == 64
