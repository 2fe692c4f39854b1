"""Spectra of signals as tables and the scorers of window pairs called by name from SQL (F10 to F19, F52, U01, U02); the oracles take every transform apart into sums of sines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.tables import onset_envelope, register, spectrogram
from tidemark.operators.signals import REFERENCE, score_pairs, window_pairs
from tidemark.plans.fixtures import oracle, pcm, r6
from tidemark.plans.registry import query

#: Frames of the queries, short enough for SQL to transform: samples, hop, mel bands, rate; and windows of pairs with their hop.
FRAME, HOP, MELS, RATE = 64, 16, 8, 16_000.0
WINDOW, STEP = 512, 256
_SETTINGS = {"onset": {"frame": FRAME, "hop": HOP}, "mel": {"frame": FRAME, "hop": HOP, "mels": MELS}}

_HANN = f"(0.5 - 0.5 * cos(2 * pi() * j / {FRAME}))"
_CORNER = "700 * (power(10, 2595 * log10(1 + 8000 / 700.0::DOUBLE) * {i} / 9.0::DOUBLE / 2595) - 1)"
_MEL = f""", edge AS (SELECT m, {_CORNER.format(i="m")} AS l, {_CORNER.format(i="(m + 1)")} AS c, {_CORNER.format(i="(m + 2)")} AS r FROM range({MELS}) t(m)),
mel AS (SELECT m, k, CASE WHEN k * 250 <= c THEN greatest((k * 250 - l) / (c - l), 0) ELSE greatest((r - k * 250) / (r - c), 0) END AS weight FROM edge, range(33) t(k))"""
_BANDS = f""", b AS MATERIALIZED (SELECT f.signal, f.frame, k, sqrt(power(sum(p.value * {_HANN} * cos(2 * pi() * k * j / {FRAME})), 2) + power(sum(p.value * {_HANN} * sin(2 * pi() * k * j / {FRAME})), 2)) AS size
  FROM (SELECT signal, unnest(range(0, (max(sample_idx) + 1 - {FRAME}) // {HOP} + 1)) AS frame FROM pcm GROUP BY 1) f, range({FRAME}) u(j), pcm p, range(33) t(k) WHERE p.signal = f.signal AND p.sample_idx = f.frame * {HOP} + j GROUP BY 1, 2, 3)"""


@query("spectrogram", oracle("pcm", body=_BANDS + " SELECT signal, frame, k::INT AS band, round(size, 6) + 0.0 AS power FROM b"))
def q_spectrogram(spark: SparkSession, sf: str) -> DataFrame:
    """F52 over all signals, in chunks that frames reach across."""
    return spectrogram(pcm(spark, sf), FRAME, HOP, size=100, span=4).withColumn("power", r6(F.col("power")))


@query("spectrogram_mel", oracle("pcm", body=_BANDS + _MEL + " SELECT signal, frame, m::INT AS band, round(sum(weight * size * size), 6) + 0.0 AS power FROM b JOIN mel USING (k) GROUP BY 1, 2, 3"))
def q_mel(spark: SparkSession, sf: str) -> DataFrame:
    """F52 in mel bands."""
    return spectrogram(pcm(spark, sf), FRAME, HOP, 2.0, MELS, RATE, size=100, span=4).withColumn("power", r6(F.col("power")))


@query("onset_envelope", oracle("pcm", body=_BANDS + " SELECT signal, frame, round(avg(greatest(size - was, 0)), 6) + 0.0 AS rise FROM (SELECT *, lag(size) OVER (PARTITION BY signal, k ORDER BY frame) AS was FROM b) WHERE was IS NOT NULL GROUP BY 1, 2"))
def q_onset(spark: SparkSession, sf: str) -> DataFrame:
    """What F13 correlates, for whole signals."""
    return onset_envelope(spectrogram(pcm(spark, sf), FRAME, HOP, size=100, span=4)).withColumn("rise", r6(F.col("rise")))


# Windows of 512 samples fill transforms of 1024; their band from 300 to 6000 Hz is bins 20 to 384. Sequences of 28 rises or 29 levels fill transforms of 64.
_PAIRS = f""", w AS MATERIALIZED (SELECT signal, win, sample_idx - win * {STEP} AS i, value AS v FROM (SELECT *, unnest(range(greatest(floor((sample_idx - {WINDOW}) / {STEP}.0)::BIGINT + 1, 0), sample_idx // {STEP} + 1)) AS win FROM pcm) QUALIFY count(*) OVER (PARTITION BY signal, win) = {WINDOW}),
d AS MATERIALIZED (SELECT signal, win, k, sum(v * cos(2 * pi() * k * i / 1024)) AS re, -sum(v * sin(2 * pi() * k * i / 1024)) AS im FROM w, range(20, 385) t(k) GROUP BY ALL),
x AS MATERIALIZED (SELECT b.signal AS target, win, k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, sqrt(a.re * a.re + a.im * a.im) AS m, sqrt(b.re * b.re + b.im * b.im) AS l FROM d a JOIN d b USING (win, k) WHERE a.signal = 'click' AND b.signal <> 'click'),
y AS (SELECT target, win, t, sum((re * cos(2 * pi() * k * t / 1024) - im * sin(2 * pi() * k * t / 1024)) / (m * l + 1e-9)) / 512 AS phase, sum((re * cos(2 * pi() * k * t / 1024) - im * sin(2 * pi() * k * t / 1024)) / (sqrt(m * m * l * l) + 1e-9)) / 512 AS coherent,
  sum((re * cos(2 * pi() * k * t / 1024) - im * sin(2 * pi() * k * t / 1024)) / ((m + 1e-9) * (l + 1e-9))) / 512 AS whitened FROM x, range(1024) u(t) GROUP BY ALL),
z AS MATERIALIZED (SELECT target, win, t, method, abs(c) AS s, abs(round(c, 9)) AS r FROM y UNPIVOT (c FOR method IN (phase, coherent, whitened))),
top AS (SELECT method, target, win, arg_max(t, (s, -t)) AS peak, arg_max(t, (r, -t)) AS steady, max(s) AS s1, list_sort(list(s))[513] AS mid, list_sort(list(s))[922] AS high FROM z GROUP BY 1, 2, 3),
st AS (SELECT method, target, win, any_value(steady) AS t, any_value(s1) AS s1, any_value(mid) AS mid, count(*) FILTER (t < peak - 100 OR t > peak + 100) AS n, avg(s) FILTER (t < peak - 100 OR t > peak + 100) AS mean, stddev_pop(s) FILTER (t < peak - 100 OR t > peak + 100) AS sd,
  max(s) FILTER (t < peak - 10 OR t > peak + 10) AS s2, count(*) FILTER (s < high) AS quiet, stddev_pop(s) FILTER (s < high) AS spread FROM z JOIN top USING (method, target, win) GROUP BY 1, 2, 3),
weighted AS (SELECT method, target, win, CASE WHEN t <= 512 THEN t ELSE t - 1024 END AS lag, CASE WHEN n < 10 OR sd < 1e-12 THEN 0 ELSE greatest(least(((s1 - mean) / sd - 10) * 10, 100), 0) END AS confidence,
  greatest(least((s1 / (mid + 1e-9) * 5 + s1 / (CASE WHEN s2 > 0 THEN s2 ELSE mid END + 1e-9) * 8 + s1 / (CASE WHEN quiet > 10 THEN spread ELSE 1e-9 END + 1e-9) * 1.5) / 3, 100), 0) AS prominence FROM st),
fr AS MATERIALIZED (SELECT signal, win, f, k, sqrt(power(sum(v * {_HANN} * cos(2 * pi() * k * j / {FRAME})), 2) + power(sum(v * {_HANN} * sin(2 * pi() * k * j / {FRAME})), 2)) AS size
  FROM (SELECT signal, win, f, i - f * {HOP} AS j, v FROM w, range(29) t(f) WHERE i >= f * {HOP} AND i < f * {HOP} + {FRAME}), range(33) t(k) GROUP BY ALL){_MEL},
db AS (SELECT signal, win, f, m, 10 * log10(greatest(sum(weight * size * size), 1e-10)) AS db FROM fr JOIN mel USING (k) GROUP BY ALL),
feat AS (SELECT 'onset' AS method, signal, win, f - 1 AS i, avg(greatest(size - was, 0)) AS v FROM (SELECT *, lag(size) OVER (PARTITION BY signal, win, k ORDER BY f) AS was FROM fr) WHERE f > 0 GROUP BY ALL
  UNION ALL SELECT 'mel', signal, win, f, avg(below) FROM (SELECT *, db - max(db) OVER (PARTITION BY signal, win) AS below FROM db) GROUP BY ALL),
fs AS MATERIALIZED (SELECT method, signal, win, i, (v - avg(v) OVER p) / (stddev_pop(v) OVER p + 1e-9) AS v FROM feat WINDOW p AS (PARTITION BY method, signal, win)),
fd AS MATERIALIZED (SELECT method, signal, win, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM fs, range(33) t(k) GROUP BY ALL),
fx AS MATERIALIZED (SELECT method, b.signal AS target, win, k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, sqrt(a.re * a.re + a.im * a.im) * sqrt(b.re * b.re + b.im * b.im) AS m FROM fd a JOIN fd b USING (method, win, k) WHERE a.signal = 'click' AND b.signal <> 'click'),
fc AS MATERIALIZED (SELECT method, target, win, j, abs(round(sum(CASE k WHEN 0 THEN re WHEN 32 THEN re * cos(pi() * j) ELSE 2 * (re * cos(2 * pi() * k * j / 64) - im * sin(2 * pi() * k * j / 64)) END / (m + 1e-9)) / 64, 9)) AS s FROM fx, range(-14, 15) u(j) GROUP BY ALL),
ft AS (SELECT method, target, win, arg_max(j, (s, -j)) AS peak, max(s) AS s1, list_sort(list(s))[15] AS mid FROM fc GROUP BY 1, 2, 3),
feature AS (SELECT method, target, win, any_value(peak) * {HOP} AS lag, greatest(least((any_value(s1) / (any_value(mid) + 1e-9) * 5 + any_value(s1) / (max(s) FILTER (abs(j - peak) > 1) + 1e-9) * 8) / 2, 100), 0) AS confidence FROM fc JOIN ft USING (method, target, win) GROUP BY 1, 2, 3)"""
_METHODS = oracle("pcm", body=_PAIRS + """ SELECT method, target, win AS "window", lag::DOUBLE AS lag, round(confidence, 6) + 0.0 AS confidence FROM weighted
UNION ALL SELECT method, target, win, lag::DOUBLE, round(confidence, 6) + 0.0 FROM feature""")


@query("pair_methods", _METHODS)
def q_methods(spark: SparkSession, sf: str) -> DataFrame:
    """F10 to F14 side by side over the same windows."""
    pairs = window_pairs(pcm(spark, sf), REFERENCE, WINDOW, STEP)
    out = None
    for name in ("phase", "coherent", "whitened", "onset", "mel"):
        found = score_pairs(pairs, name, **_SETTINGS.get(name, {})).select(F.lit(name).alias("method"), "target", "window", "lag", r6(F.col("confidence")).alias("confidence"))
        out = found if out is None else out.unionByName(found)
    return out


_SCORED = oracle("pcm", body=_PAIRS + f""", n AS MATERIALIZED (SELECT signal, win, i, (v - avg(v) OVER p) / (stddev_pop(v) OVER p + 1e-9) AS v FROM w WINDOW p AS (PARTITION BY signal, win)),
e AS (SELECT signal, win, sum(v * v) AS e FROM n GROUP BY 1, 2),
c AS MATERIALIZED (SELECT b.signal AS target, win, a.i - b.i AS lag, (a.i - b.i + 1024) % 1024 AS t, abs(sum(a.v * b.v)) AS s, abs(round(sum(a.v * b.v), 9)) AS r FROM n a JOIN n b USING (win) WHERE a.signal = 'click' AND b.signal <> 'click' GROUP BY 1, 2, 3, 4),
g AS (SELECT target, win, arg_max(lag, (r, -t)) AS lag, arg_max(t, (r, -t)) AS t, max(r) AS r, max(s) AS s FROM c GROUP BY 1, 2),
h AS (SELECT g.*, coalesce((SELECT r FROM c WHERE c.target = g.target AND c.win = g.win AND c.t = g.t - 1), 0) AS before, coalesce((SELECT r FROM c WHERE c.target = g.target AND c.win = g.win AND c.t = g.t + 1), 0) AS after FROM g),
standard AS (SELECT target, h.win, lag, s / (sqrt(x.e * y.e) + 1e-9) * 100 AS confidence, lag + CASE WHEN t > 0 AND t < 1023 AND abs(before - 2 * r + after) > 1e-12 AND abs(0.5 * (before - after) / (before - 2 * r + after)) < 1 THEN 0.5 * (before - after) / (before - 2 * r + after) ELSE 0 END AS refined
  FROM h JOIN e x ON x.signal = 'click' AND x.win = h.win JOIN e y ON y.signal = target AND y.win = h.win)
SELECT method, target, win AS "window", lag::DOUBLE AS lag, round(confidence, 6) + 0.0 AS confidence, round(prominence, 6) + 0.0 AS prominence, NULL::DOUBLE AS refined, NULL::BIGINT AS frames FROM weighted
UNION ALL SELECT method, target, win, lag::DOUBLE, round(confidence, 6) + 0.0, NULL, NULL, CASE method WHEN 'mel' THEN 29 ELSE 28 END FROM feature
UNION ALL SELECT 'standard', target, win, lag::DOUBLE, round(least(confidence, 100), 6) + 0.0, NULL, round(refined, 6) + 0.0, NULL FROM standard""")


@query("scored_pairs", _SCORED)
def q_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every scorer of the reference by name from SQL, each with what it gives besides lag and confidence."""
    register(spark)
    pairs = window_pairs(pcm(spark, sf), REFERENCE, WINDOW, STEP)
    out = None
    for name in ("coherent", "mel", "onset", "phase", "standard", "whitened"):
        settings = "".join(f", {k} => {v}" for k, v in _SETTINGS.get(name, {}).items())
        found = spark.sql(f"SELECT '{name}' AS method, * FROM score_pairs('{name}', TABLE(SELECT * FROM {{pairs}}), 16000.0D{settings})", pairs=pairs)
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out.withColumns({c: r6(F.col(c)) for c in ("confidence", "prominence", "refined")})
