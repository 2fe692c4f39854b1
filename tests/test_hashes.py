"""Grid hashes against sums written out."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashes import cosine_bits, difference_bits, grid_hashes, hexadecimal, mean_bits, nearest_difference, resampled, resampling


def sinc_weights(size, wanted):
    out = []
    for o in range(wanted):
        ratio = size / wanted
        stretch, centre = max(ratio, 1.0), (o + 0.5) * ratio
        left = min(max(math.floor(centre - 3 * stretch), 0), size - 1)
        right = min(max(math.ceil(centre + 3 * stretch), left + 1), size)
        row = [0.0] * size
        for i in range(left, right):
            x = (i - (centre - 0.5)) / stretch
            row[i] = 1.0 if x == 0 else 0.0 if abs(x) >= 3 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)
        out.append([w / sum(row) for w in row])
    return np.array(out)


@pytest.mark.parametrize("size, wanted", ((8, 9), (8, 32), (40, 8), (7, 1), (1, 5)))
def test_weights_of_resampling(size, wanted):
    assert np.allclose(resampling(size, wanted), sinc_weights(size, wanted)) and np.allclose(resampling(size, wanted).sum(axis=1), 1)


GRIDS = np.random.default_rng(3).integers(0, 256, (20, 12, 10)).astype(float)


def test_bits_of_grids():
    for grid, d, m, c in zip(GRIDS, difference_bits(GRIDS, 4), mean_bits(GRIDS, 4), cosine_bits(GRIDS, 4)):
        wide, flat, large = (resampled(grid[None], h, w)[0] for h, w in ((4, 5), (4, 4), (16, 16)))
        assert d.tolist() == [bool(wide[y, x] < wide[y, x + 1]) for y in range(4) for x in range(4)]
        assert m.tolist() == [bool(p >= flat.mean()) for p in flat.ravel()]
        waves = [sum(large[x, y] * math.cos((2 * x + 1) * u * math.pi / 32) * math.cos((2 * y + 1) * v * math.pi / 32) for x in range(16) for y in range(16)) for u in range(4) for v in range(4)]
        middle = sorted(waves[1:])[7]
        assert c.tolist() == [w > middle and abs(w - middle) > 1e-6 for w in waves]
    assert resampled(GRIDS, 12, 10).tolist() == GRIDS.tolist()


def test_digits():
    assert hexadecimal(np.array([[1, 0, 0, 0, 1, 1, 1, 1, 0, 1], [0] * 10], bool)) == ["8f4", "000"]


def test_nearest_pixels_as_a_signed_long(spark):
    rows = [(i, [int(p) for p in g.ravel()]) for i, g in enumerate(GRIDS)] + [(98, list(range(120))), (99, None)]
    frame = spark.createDataFrame(rows, "i int, pixels array<int>")
    got = {r.i: r.h for r in frame.select("i", nearest_difference(F.col("pixels"), 10, 12).alias("h")).collect()}
    for i, pixels in rows[:-1]:
        grid = [[pixels[y * 12 // 8 * 10 + x * 10 // 9] for x in range(9)] for y in range(8)]
        bits = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if grid[y][x] < grid[y][x + 1])
        assert got[i] == (bits - (1 << 64) if bits >> 63 else bits)
    assert got[98] == -1 and got[99] == 0


def test_odd_grids_and_columns(spark):
    rows = [(1, list(range(120)), "x"), (2, None, None), (3, [1, 2], ""), (4, [None] * 120, "y")]
    frame = spark.createDataFrame(rows, "i int, pixels array<int>, phash string")
    got = {r.i: r for r in grid_hashes(frame, "pixels", 10, 12, 4).collect()}
    assert [len(got[1][m]) for m in ("dhash", "average_hash", "phash")] == [4, 4, 4] and got[1].dhash == "ffff"
    assert all(got[i][m] is None for i in (2, 3, 4) for m in ("dhash", "average_hash", "phash"))
    assert grid_hashes(frame.limit(0), "pixels", 10, 12).count() == 0
    with pytest.raises(ValueError, match="average_hash"):
        grid_hashes(frame, "pixels", 10, 12, methods=("whash",))
