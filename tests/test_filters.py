"""Filters over blocks against the recurrence written out."""

from __future__ import annotations

import math
import random

import pytest

from tidemark.operators.filters import Recurrence, band_pass_section, filtered, low_pass_taps, recursive


def plain(x, b, a):
    """The recurrence, sample by sample."""
    y = []
    for i in range(len(x)):
        y.append(sum(c * x[i - k] for k, c in enumerate(b) if i >= k) - sum(c * y[i - k - 1] for k, c in enumerate(a) if i > k))
    return y


def signals(spark, **values):
    return spark.createDataFrame([(name, i, v) for name, x in values.items() for i, v in enumerate(x)], "signal string, sample_idx long, value double").repartition(5)


def results(frame, name):
    return [r.filtered for r in frame.where(f"signal = '{name}'").orderBy("sample_idx").collect()]


def test_impulse_response_by_hand(spark):
    b, a = band_pass_section(8.0, 1.0, 3.0)  # the middle is a quarter of the rate, so its cosine is 0
    alpha = math.sin(math.pi / 4) / math.sqrt(2)
    assert abs(alpha - 0.5) < 1e-15 and [round(v, 12) for v in (*b, *a)] == [round(1 / 3, 12), 0, -round(1 / 3, 12), 0, round(1 / 3, 12)]
    got = results(filtered(signals(spark, s=[1.0] + [0.0] * 6), "band_pass", 8.0, low=1.0, high=3.0, size=2), "s")
    assert [round(v, 12) for v in got] == [round(v, 12) for v in (1 / 3, 0, -4 / 9, 0, 4 / 27, 0, -4 / 81)]


@pytest.mark.parametrize("size, fan", ((448, 256), (64, 256), (7, 4), (7, 2), (1, 3)))  # one, seven and 64 blocks, and up to six levels of the scan
def test_blocks_change_nothing(spark, size, fan):
    rng = random.Random(4)
    x, short = [rng.uniform(-1, 1) for _ in range(448)], [rng.uniform(-1, 1) for _ in range(5)]
    b, a = band_pass_section(16_000.0, 300.0, 3400.0)
    found = recursive(signals(spark, long=x, short=short, one=[0.5]), b, a, size, fan).cache()
    for name, wave in (("long", x), ("short", short), ("one", [0.5])):
        assert max(abs(p - q) for p, q in zip(results(found, name), plain(wave, b, a), strict=True)) < 1e-12


def test_a_filter_with_more_poles_and_slow_decay(spark):
    rng = random.Random(5)
    x = [rng.uniform(-1, 1) for _ in range(300)]
    b, a = [0.2, -0.1, 0.4, 0.05], [-1.2, 0.31, 0.08]
    assert max(abs(p - q) for p, q in zip(results(recursive(signals(spark, s=x), b, a, 16, 4), "s"), plain(x, b, a), strict=True)) < 1e-10
    lasting = [1.0, 0.0], [-0.9999]
    assert max(abs(p - q) for p, q in zip(results(recursive(signals(spark, s=x), *lasting, 16, 4), "s"), plain(x, *lasting), strict=True)) < 1e-10
    with pytest.raises(ValueError):
        Recurrence([1.0], [0.5])


def test_dispatch_and_settings_that_filter_nothing(spark):
    samples = signals(spark, s=[0.25, -1.0, 0.5])
    for kind, settings in (("none", {}), ("low_pass", {"cutoff": 0.0}), ("band_pass", {"low": 0.0}), ("band_pass", {"high": 8000.0}), ("band_pass", {"low": 500.0, "high": 500.0})):
        assert results(filtered(samples, kind, 16_000.0, **settings), "s") == [0.25, -1.0, 0.5]
    with pytest.raises(ValueError):
        filtered(samples, "notch", 16_000.0)
    assert low_pass_taps(100.0, 80.0, 5) == low_pass_taps(100.0, 49.0, 5) and low_pass_taps(100.0, 10.0, 1) == [1.0]


def test_gaps_nulls_and_empty(spark):
    b, a = band_pass_section(16_000.0, 300.0, 3400.0)
    rows = spark.createDataFrame([("s", 3, 1.0), ("s", 900, None), ("s", 5000, 0.5)], "signal string, sample_idx long, value double")
    got = {r.sample_idx: (r.value, r.filtered) for r in recursive(rows, b, a, 8, 2).collect()}
    wanted = plain([1.0, 0.0, 0.5], b, a)
    assert [got[i][0] for i in (3, 900, 5000)] == [1.0, None, 0.5] and max(abs(got[i][1] - w) for i, w in zip((3, 900, 5000), wanted)) < 1e-14
    assert recursive(rows.limit(0), b, a).count() == 0
