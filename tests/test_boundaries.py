"""Boundary refinement on signals made by hand."""

from __future__ import annotations

import pytest

from tidemark.operators.boundaries import Search, refine

#: 100 samples a second, so levels are taken over 5 samples, jumps over one, and crossings are searched one sample around.
SEARCH = Search(rate=100.0, window_s=1.0, threshold_db=-40.0, min_ms=100.0, snap_s=0.5)
LOUD, SOFT = 1 << 30, 1 << 20  # -6 dB and -66 dB


def wave(quiet, n=600):
    """Loud samples that change their sign each sixth, soft in the ranges."""
    return [(SOFT if any(a <= i < b for a, b in quiet) else LOUD) * (1 if i // 6 % 2 else -1) for i in range(n)]


def run(spark, quiet, steps, gaps=None, keys=None, search=SEARCH):
    samples = spark.createDataFrame([(s, i, v) for s, x in quiet.items() for i, v in enumerate(x)], "signal string, sample_idx long, v long")
    rows = spark.createDataFrame(steps, "boundary long, signal string, track long, ref_start_s double, ref_end_s double, before_ms double, after_ms double")
    gaps = gaps if gaps is None else spark.createDataFrame(gaps, "signal string, start_s double, end_s double")
    keys = keys if keys is None else spark.createDataFrame(keys, "track long, key_s double")
    return {r.boundary: r for r in refine(rows, samples, search, gaps, keys).collect()}


def test_the_quiet_zone_nearest_to_the_middle_is_cut_at_a_crossing(spark):
    got = run(spark, {"a": wave([(200, 230), (300, 330)])}, [(1, "a", 1, 2.9, 3.5, 0.0, 50.0), (2, "a", 1, 2.1, 2.3, 0.0, 50.0), (3, "a", 1, 3.6, 3.8, 500.0, 0.0)])
    assert {b: (r.source, r.zone_start, r.zone_end) for b, r in got.items()} == {1: ("rms", 3.0, 3.3), 2: ("rms", 2.0, 2.3), 3: ("rms", 3.0, 3.3)}
    assert abs(got[1].target_s - 3.2) < 1e-12 and abs(got[3].target_s - 3.2) < 1e-12  # a delay of 500 ms moves 3.7 there
    assert got[1].crossed_s == 3.15 or abs(got[1].crossed_s - 3.15) <= 0.01 + 1e-12
    assert abs(got[3].ref_s - got[3].splice_s - 0.5) < 1e-12 and got[1].snap == "none" and got[1].key_s is None


def test_no_zone_keeps_the_middle_and_takes_no_keyframe(spark):
    got = run(spark, {"a": wave([])}, [(1, "a", 1, 3.0, 3.04, 0.0, 1.0), (2, "a", 1, 0.0, 0.0, 5000.0, 1.0), (3, "b", 1, 3.0, 3.0, 0.0, 1.0)], keys=[(1, 3.05)])
    r = got[1]
    assert (r.source, r.zone_start, r.score, r.snap) == (None, None, None, "none") and abs(r.splice_s - 3.01) < 0.011
    assert got[2].source is None and 3 not in got  # a middle before the signal has nothing to search; a signal without samples has no row


def test_keyframes_are_taken_only_inside_the_zone(spark):
    steps = [(1, "a", 1, 3.1, 3.3, 0.0, 0.0), (2, "a", 2, 3.1, 3.3, 0.0, 0.0), (3, "a", 3, 3.1, 3.3, 0.0, 0.0), (4, "a", 4, 3.3, 3.5, 200.0, 0.0)]
    keys = [(1, 3.25), (1, 3.6), (2, 3.4), (3, 3.9), (4, 3.31)]
    got = run(spark, {"a": wave([(300, 330)])}, steps, keys=keys)
    assert {b: (r.snap, r.key_s) for b, r in got.items()} == {1: ("accepted", 3.25), 2: ("rejected", 3.4), 3: ("none", None), 4: ("accepted", 3.31)}
    assert abs(got[1].splice_s - 3.25) < 1e-12 and abs(got[4].splice_s - 3.11) < 1e-12 and abs(got[2].splice_s - got[2].crossed_s) < 1e-12


def test_speech_gaps_are_preferred_where_they_are_quiet(spark):
    steps = [(1, "a", 1, 3.1, 3.3, 0.0, 0.0)]
    quiet = {"a": wave([(300, 330), (350, 380)])}
    both = run(spark, quiet, steps, gaps=[("a", 3.6, 3.9), ("a", 0.5, 0.7)])[1]
    assert (both.source, round(both.zone_start, 9), round(both.zone_end, 9), both.over_speech) == ("combined", 3.6, 3.8, False)
    apart = run(spark, quiet, steps, gaps=[("a", 2.5, 2.7)])[1]
    assert (apart.source, apart.zone_start, apart.over_speech) == ("rms", 3.0, True)
    loud = run(spark, {"a": wave([])}, steps, gaps=[("a", 2.5, 2.7), ("a", 3.0, 3.05)])[1]
    assert (loud.source, loud.zone_start, round(loud.mean_db)) == ("vad", 2.5, -6)  # the other gap is too short


def test_jumps_near_a_zone_count_against_it(spark):
    got = run(spark, {"a": wave([(300, 320), (324, 344)])}, [(1, "a", 1, 3.22, 3.22, 0.0, 0.0)])
    assert got[1].near_jump and got[1].source == "rms"
    still = run(spark, {"a": [0] * 600}, [(1, "a", 1, 3.0, 3.0, 0.0, 0.0)])[1]
    assert not still.near_jump and (still.zone_start, still.zone_end, still.mean_db, still.crossed_s) == (2.0, 4.0, -96.0, 3.0)  # every zero is a crossing, so the middle itself


@pytest.mark.parametrize("rows", (0, 1))
def test_empty_inputs(spark, rows):
    assert len(run(spark, {"a": wave([])[: 600 * rows]}, [(1, "a", 1, 1.0, 1.0, 0.0, 0.0)], gaps=[], keys=[])) == rows


def test_keyframes_meet_only_steps_of_their_track_and_time(spark):
    samples = spark.createDataFrame([("a", i, v) for i, v in enumerate(wave([(300, 330)]))], "signal string, sample_idx long, v long")
    steps = spark.createDataFrame([(b, "a", b, 3.1, 3.3, 0.0, 0.0) for b in range(40)], "boundary long, signal string, track long, ref_start_s double, ref_end_s double, before_ms double, after_ms double")
    keys = spark.createDataFrame([(b, 3.25 + k) for b in range(40) for k in range(-2, 3)], "track long, key_s double")
    found = refine(steps, samples, SEARCH, None, keys)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "track" in plan and not [x for x in plan.splitlines() if "Join" in x and " = " not in x]  # each join has a key
    assert {(r.boundary, r.snap, r.key_s) for r in found.collect()} == {(b, "accepted", 3.25) for b in range(40)}
