"""Table functions: frames over chunk borders, and scorers called by name."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.tables import chunked, register, scorers_function, spectrogram
from tidemark.operators import signals


def samples(spark, **waves):
    return spark.createDataFrame([(s, i, float(v)) for s, x in waves.items() for i, v in enumerate(x)], "signal string, sample_idx long, value double").repartition(4)


def matrix(found, signal, bands):
    """(bands, frames) of a signal."""
    rows = found.where(F.col("signal") == signal).collect()
    out = np.full((bands, max((r.frame for r in rows), default=-1) + 1), np.nan)
    for r in rows:
        assert np.isnan(out[r.band, r.frame])  # no frame comes twice
        out[r.band, r.frame] = r.power
    return out


WAVE = np.random.default_rng(1).normal(size=300)


@pytest.mark.parametrize("frame, hop, size, span", ((32, 8, 300, 64), (32, 8, 7, 3), (32, 8, 1, 5), (32, 8, 40, 1), (16, 23, 10, 2), (16, 16, 16, 1)))
def test_frames_reach_over_chunks_and_spans(spark, frame, hop, size, span):
    found = spectrogram(samples(spark, a=WAVE, b=WAVE[:frame], c=WAVE[:5], d=WAVE[: frame + 1]), frame, hop, size=size, span=span).cache()
    for name, wave in (("a", WAVE), ("b", WAVE[:frame]), ("c", WAVE[:5]), ("d", WAVE[: frame + 1])):
        wanted = signals.spectrogram(wave, frame, hop)
        got = matrix(found, name, frame // 2 + 1)
        assert got.shape == wanted.shape and np.allclose(got, wanted, atol=1e-12)


def test_powers_and_mel_bands(spark):
    found = spectrogram(samples(spark, a=WAVE), 32, 8, 2.0, 6, 8000.0, size=50, span=2)
    assert np.allclose(matrix(found, "a", 6), signals.mel_spectrogram(WAVE, 8000.0, 32, 8, 6))


def test_spans_hold_what_their_frames_need_and_no_more(spark):
    rows = chunked(samples(spark, a=WAVE), 32, 10, 5).groupBy("span").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).collect()
    assert {(r.span, r.a, r.b) for r in rows} == {(s, 5 * s, min(5 * s + 8, 29)) for s in range(6)}  # 31 more samples lie in four more chunks


def test_called_from_sql(spark):
    assert register(spark) == ["score_pairs", "spectrogram"]
    names = {r.function.split(".")[-1] for r in spark.sql("SHOW USER FUNCTIONS").collect()}
    assert {"score_pairs", "spectrogram"} <= names
    rows = chunked(samples(spark, a=WAVE), 32, 10, 5)
    got = spark.sql("SELECT signal, frame, powers FROM spectrogram(TABLE(SELECT * FROM {rows}) PARTITION BY (signal, span) ORDER BY (chunk), 32, 8, 1.0D, 0, 8000.0D)", rows=rows).collect()
    assert np.allclose(np.array([r.powers for r in sorted(got, key=lambda r: r.frame)]).T, signals.spectrogram(WAVE, 32, 8))
    with pytest.raises(AnalysisException, match="lacks span"):
        spark.sql("SELECT * FROM spectrogram(TABLE(SELECT signal, chunk, first, total, last_start, x FROM {rows}), 32, 8, 1.0D, 0, 8000.0D)", rows=rows)


def pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=700)
    rows = [(f"t{k}", k, base[:512].tolist(), base[k * 7 : k * 7 + 512].tolist(), "other") for k in range(4)]
    return spark.createDataFrame(rows, "target string, window long, ref array<double>, tgt array<double>, more string")


@pytest.mark.parametrize("name, besides", (("standard", ["refined"]), ("phase", ["prominence"]), ("coherent", ["prominence"]), ("whitened", ["prominence"]), ("onset", ["frames"]), ("mel", ["frames"])))
def test_scorers_by_name(spark, name, besides):
    register(spark)
    more = {"onset": ", frame => 64, hop => 16", "mel": ", frame => 64, hop => 16, mels => 8"}.get(name, "")
    settings = {"onset": {"frame": 64, "hop": 16}, "mel": {"frame": 64, "hop": 16, "mels": 8}}.get(name, {})
    got = spark.sql(f"SELECT * FROM score_pairs('{name}', TABLE(SELECT * FROM {{rows}}), 16000.0D{more})", rows=pairs(spark))
    assert got.columns == ["target", "window", "lag", "confidence", *besides]
    plain = {r.target: (r.lag, r.confidence) for r in signals.score_pairs(pairs(spark), name, **settings).collect()}
    assert {r.target: (r.lag, r.confidence) for r in got.collect()} == plain
    if name == "standard":
        assert {r.target: r.lag for r in got.collect()} == {f"t{k}": 7.0 * k for k in range(4)}


def test_wrong_calls_say_what_is_wrong(spark):
    register(spark)
    for call, message in (("'nope', TABLE(SELECT * FROM {rows})", "there are coherent, mel, onset, phase, standard, whitened"), ("'phase', TABLE(SELECT target, window, ref FROM {rows})", "lacks tgt")):
        with pytest.raises(AnalysisException, match=message):
            spark.sql(f"SELECT * FROM score_pairs({call}, 16000.0D)", rows=pairs(spark))


def test_a_scorer_of_the_user(spark):
    def largest(a, b, rate):
        return float(np.argmax(a) - np.argmax(b)), 100.0, f"{rate:g} Hz"

    function = scorers_function({**signals.DETAILED, "largest": ({"note": "string"}, largest)})
    got = function(F.lit("largest"), pairs(spark).asTable(), F.lit(8.0)).collect()
    assert {(r.target, r.confidence, r.note) for r in got} == {(f"t{k}", 100.0, "8 Hz") for k in range(4)}
    assert function(F.lit("largest"), pairs(spark).limit(0).asTable(), F.lit(8.0)).count() == 0
