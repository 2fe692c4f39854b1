"""Sampled signals: levels, runs, crossings, zones and the scoring of window pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.fixtures import oracle, pcm, r6
from tidemark.plans.registry import query
from tidemark.session import ship

BLOCK = 16
#: Blocks in a span inside which runs are found first.
SPAN = 4096


def rms_db(mean_square: Column, floor: float = -120.0) -> Column:
    """level in dB of a mean square; floor where it is silent."""
    rms = F.sqrt(mean_square)
    return F.when(rms < 1e-12, floor).otherwise(20 * F.log10(rms))


def rms_db_int(mean_square: Column, floor: float = -96.0) -> Column:
    """the level of 32-bit samples against full scale."""
    return F.greatest(rms_db(mean_square / (2147483648.0 * 2147483648.0), floor), F.lit(floor))


def levels(samples: DataFrame, size: int = BLOCK) -> DataFrame:
    """Level of each whole block of samples: (signal, block, db, n). A block of zeros is at minus infinity, below any other."""
    return samples.groupBy("signal", F.floor(F.col("sample_idx") / size).alias("block")).agg(F.avg(F.col("value") * F.col("value")).alias("square"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size).select("signal", "block", F.when(F.col("square") > 0, 20 * F.log10(F.sqrt("square"))).otherwise(F.lit(float("-inf"))).alias("db"), "n")


def hopping(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """Every sample with each window of size samples that holds it, starting every hop samples: (signal, window, sample_idx, value)."""
    last = F.floor(F.col("sample_idx") / hop)
    first = F.greatest(F.floor((F.col("sample_idx") - size) / hop) + 1, F.lit(0))
    return samples.select("signal", "sample_idx", "value", F.explode(F.sequence(first, last)).alias("window"))


def runs(blocks: DataFrame, flag: Column, least: int = 1, span: int = SPAN) -> DataFrame:
    """Maximal runs of flagged blocks of at least a length: (signal, first, last, length, mean_db).

    Runs are found inside spans of blocks first. Only those that reach a span's edge are
    then joined with their neighbours in one order for each signal: two of a span at most.
    """
    inside = Window.partitionBy("signal", "__span").orderBy("block")
    flagged = blocks.where(flag).withColumn("__span", F.floor(F.col("block") / span))
    own = flagged.withColumn("__g", F.col("block") - F.row_number().over(inside)).groupBy("signal", "__span", "__g").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.count(F.lit(1)).alias("length"), F.sum("db").alias("__db"))
    edge = (F.col("first") == F.col("__span") * span) | (F.col("last") == (F.col("__span") + 1) * span - 1)
    order = Window.partitionBy("signal").orderBy("first")
    new = F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("long")
    joined = own.where(edge).withColumn("__new", new).withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("signal", "__g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"), F.sum("__db").alias("__db"))
    whole = own.where(~edge).select("signal", "first", "last", "length", "__db").unionByName(joined.drop("__g"))
    return whole.where(F.col("length") >= least).select("signal", "first", "last", "length", (F.col("__db") / F.col("length")).alias("mean_db"))


def transients(blocks: DataFrame, jump_db: float) -> DataFrame:
    """Blocks whose level jumps over the one before; neighbours meet by number, so a long signal needs no task of its own."""
    before = blocks.select("signal", (F.col("block") + 1).alias("block"), F.col("db").alias("was"))
    return blocks.join(before, ["signal", "block"]).withColumn("jump", F.col("db") - F.col("was")).where(F.col("jump") >= jump_db).drop("was")


def crossings(samples: DataFrame, level: float) -> DataFrame:
    """Samples after which the value crosses a level: (signal, sample_idx)."""
    above = F.col("value") >= level
    after = samples.select("signal", (F.col("sample_idx") - 1).alias("sample_idx"), above.alias("b"))
    return samples.select("signal", "sample_idx", above.alias("a")).join(after, ["signal", "sample_idx"]).where("a <> b").select("signal", "sample_idx")


def nearest_crossing(targets: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """targets(signal, target) with the nearest crossing within radius, the earlier of two, else themselves. Crossings are met by their own and neighbouring bins of radius samples."""
    binned = targets.select("signal", "target", F.explode(F.array(*[F.floor(F.col("target") / radius) + d for d in (-1, 0, 1)])).alias("bin"))
    near = binned.join(found.withColumn("bin", F.floor(F.col("sample_idx") / radius)), ["signal", "bin"]).where(F.abs(F.col("sample_idx") - F.col("target")) <= radius)
    best = near.groupBy("signal", "target").agg(F.min_by("sample_idx", F.struct(F.abs(F.col("sample_idx") - F.col("target")), "sample_idx")).alias("hit"))
    return targets.join(best, ["signal", "target"], "left").select("signal", "target", F.coalesce("hit", "target").alias("snapped"))


def intersect_zones(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """Intersections of zones(pair, start, end) of two lists, ends exclusive. Zones are met by the bins of width that they touch, and a pair counts in the bin where its intersection starts."""
    def binned(z: DataFrame, name: str) -> DataFrame:
        return z.select("pair", F.col("start").alias(f"s{name}"), F.col("end").alias(f"e{name}"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"))

    start, end = F.greatest("s1", "s2"), F.least("e1", "e2")
    joined = binned(a, "1").join(binned(b, "2"), ["pair", "bin"]).where((start < end) & (F.floor(start / width) == F.col("bin")))
    return joined.select("pair", start.alias("start"), end.alias("end"))


def zone_score(centre_s: Column, target_s: Column, mean_db: Column, duration_s: Column, jumps: Column, search_s: float = 5.0, threshold_db: float = -40.0, depth_weight: float = 10.0, length_weight: float = 2.0) -> Column:
    """Nearness inside the search window, depth below the threshold in tens of dB, length up to a second, less three for each transient."""
    near = F.greatest((search_s - F.abs(centre_s - target_s)) / search_s, F.lit(0.0)) * 5
    deep = F.greatest((F.lit(threshold_db) - mean_db) / 10, F.lit(0.0)) * depth_weight
    return near + deep + F.least(duration_s, F.lit(1.0)) * length_weight - 3.0 * jumps


def best_zone(zones: DataFrame, key: str, **settings: float) -> DataFrame:
    """Of each key's zones(source, start_s, end_s, mean_db, target_s, jumps) the one with the highest score, the first of equals, from the preferred source that has any: combined, then rms, then vad."""
    score = zone_score((F.col("start_s") + F.col("end_s")) / 2, F.col("target_s"), F.col("mean_db"), F.col("end_s") - F.col("start_s"), F.col("jumps"), **settings)
    preference = F.when(F.col("source") == "combined", 0).when(F.col("source") == "rms", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(preference, F.desc(F.round(score, 6)), "start_s"))
    return zones.withColumn("score", score).withColumn("__k", rank).where("__k = 1").drop("__k")


def jumps_near(zones: DataFrame, jumps: DataFrame, key: str, margin_s: float = 0.05, width_s: float = 1.0) -> DataFrame:
    """zones(start_s, end_s) with the number of jumps(time_s) of their key inside them or within a margin. Both are met by bins of time."""
    lo, hi = F.col("start_s") - margin_s, F.col("end_s") + margin_s
    asked = zones.select(key, "source", "start_s", "end_s", F.explode(F.sequence(F.floor(lo / width_s), F.floor(hi / width_s))).alias("bin"))
    met = asked.join(jumps.select(key, "time_s", F.floor(F.col("time_s") / width_s).alias("bin")), [key, "bin"]).where(F.col("time_s").between(lo, hi))
    counted = met.groupBy(key, "source", "start_s").agg(F.count(F.lit(1)).alias("jumps"))
    return zones.join(counted, [key, "source", "start_s"], "left").fillna(0, ["jumps"])


# Scorers of window pairs (U01, U02): each gives (lag in samples, confidence from 0 to 100) of a reference and a target at a sample rate, and what it gives besides is named where it is registered.
Scorer = Callable[..., tuple[float, float]]
SCORERS: dict[str, Scorer] = {}
#: By name: the names and types of the values besides, and the scorer that gives them too.
DETAILED: dict[str, tuple[dict[str, str], Callable[..., tuple]]] = {}
#: The band that weighted scorers look at, samples beside a peak that are no sidelobe, and the frames of spectra.
BAND_HZ, GUARD, FRAME, HOP, MELS = (300.0, 6000.0), 100, 2048, 512, 64


def scorer(name: str, **besides: str) -> Callable[[Callable[..., tuple]], Scorer]:
    """Register a scorer by name, with the names and types of the values that it gives after lag and confidence."""

    def add(function: Callable[..., tuple]) -> Scorer:
        @wraps(function)
        def score(*windows, **settings) -> tuple[float, float]:
            return function(*windows, **settings)[:2]

        DETAILED[name] = (besides, function)
        SCORERS[name] = score
        return score

    return add


def list_scorers() -> list[str]:
    """Names of the registered scorers, in order."""
    return sorted(SCORERS)


def _spectra(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    n = 1 << (len(a) + len(b) - 2).bit_length()
    return np.fft.rfft(a, n), np.fft.rfft(b, n), n


def _standardised(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / (x.std() + 1e-9)


def signed_lag(correlation: np.ndarray, refine: bool = False) -> float:
    """the lag of the largest value by size of a circular correlation, places beyond the half as negative lags; refined by the parabola through its neighbours if that moves it by less than one."""
    n, size = len(correlation), np.abs(correlation)
    peak = int(np.argmax(size))
    shift = 0.0
    if refine and 0 < peak < n - 1:
        left, top, right = size[peak - 1 : peak + 2]
        bend = left - 2 * top + right
        if abs(bend) > 1e-12 and abs(0.5 * (left - right) / bend) < 1:
            shift = float(0.5 * (left - right) / bend)
    return (peak if peak <= n // 2 else peak - n) + shift


def energy_confidence(correlation: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """F16: the peak against both windows' energy."""
    return float(np.clip(np.abs(correlation).max() / (np.sqrt((a * a).sum() * (b * b).sum()) + 1e-9) * 100, 0, 100))


def sidelobe_confidence(correlation: np.ndarray, guard: int = GUARD) -> float:
    """how far the peak stands above the rest in deviations: up to 10 is 0, from 20 on 100; 0 if fewer than ten values or no spread are left."""
    size = np.abs(correlation)
    peak = int(np.argmax(size))
    rest = np.concatenate([size[: max(peak - guard, 0)], size[peak + guard + 1 :]])
    if len(rest) < 10 or rest.std() < 1e-12:
        return 0.0
    return float(np.clip(((size[peak] - rest.mean()) / rest.std() - 10) * 10, 0, 100))


def feature_peak(correlation: np.ndarray, reach: int) -> tuple[int, float]:
    """the lag of the largest value by size within reach, and how it stands against the lower median and the next best outside one percent around it."""
    size = np.abs(np.concatenate([correlation[len(correlation) - reach :], correlation[: reach + 1]]))
    peak, n = int(np.argmax(size)), len(size)
    median, near = np.sort(size)[(n - 1) // 2], max(n // 100, 1)
    others = np.concatenate([size[: max(peak - near, 0)], size[peak + near + 1 :]])
    second = others.max() if len(others) else median
    confidence = (size[peak] / (median + 1e-9) * 5 + size[peak] / (second + 1e-9) * 8) / 2
    return peak - reach, float(np.clip(confidence, 0, 100))


def peak_confidence(correlation: np.ndarray, peak: int) -> float:
    """a peak against the upper median, the next best outside one percent around it, and the spread of the values under the 90th percentile."""
    size = np.abs(correlation)
    order, n = np.sort(size), len(size)
    median, near = order[n // 2], max(n // 100, 1)
    others = np.concatenate([size[: max(peak - near, 0)], size[peak + near + 1 :]])
    second = others.max() if len(others) and others.max() > 0 else median
    quiet = size[size < order[min(int(n * 0.9), n - 1)]]
    spread = quiet.std() if len(quiet) > 10 else 1e-9
    total = size[peak] / (median + 1e-9) * 5 + size[peak] / (second + 1e-9) * 8 + size[peak] / (spread + 1e-9) * 1.5
    return float(np.clip(total / 3, 0, 100))


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The circular correlation of two windows; at lag k the sum of a[i + k] * b[i]."""
    x, y, n = _spectra(a, b)
    return np.fft.irfft(x * y.conj(), n)


@scorer("standard", refined="double")
def standard(a: np.ndarray, b: np.ndarray, rate: float) -> tuple[float, float, float]:
    """Cross-correlation of the standardised windows; besides, the lag refined by the parabola."""
    a, b = _standardised(a), _standardised(b)
    correlation = correlate(a, b)
    steady = np.round(correlation, 9)
    return signed_lag(steady), energy_confidence(correlation, a, b), signed_lag(steady, True)


def _in_band(n: int, rate: float) -> np.ndarray:
    frequencies = np.fft.rfftfreq(n, 1 / rate)
    return (frequencies >= BAND_HZ[0]) & (frequencies <= BAND_HZ[1])


def _weighted(a: np.ndarray, b: np.ndarray, rate: float, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[float, float, float]:
    """F17; besides, the prominence of the peak."""
    x, y, n = _spectra(a, b)
    correlation = np.fft.irfft(np.where(_in_band(n, rate), weigh(x, y), 0), n)
    return signed_lag(np.round(correlation, 9)), sidelobe_confidence(correlation), peak_confidence(correlation, int(np.argmax(np.abs(correlation))))


@scorer("phase", prominence="double")
def phase(a: np.ndarray, b: np.ndarray, rate: float) -> tuple[float, float, float]:
    """correlation of phases in the band."""
    return _weighted(a, b, rate, lambda x, y: x * y.conj() / (np.abs(x * y.conj()) + 1e-9))


@scorer("coherent", prominence="double")
def coherent(a: np.ndarray, b: np.ndarray, rate: float) -> tuple[float, float, float]:
    """the cross-spectrum in the band by the root of both powers."""
    return _weighted(a, b, rate, lambda x, y: x * y.conj() / (np.sqrt(np.abs(x) ** 2 * np.abs(y) ** 2) + 1e-9))


@scorer("whitened", prominence="double")
def whitened(a: np.ndarray, b: np.ndarray, rate: float) -> tuple[float, float, float]:
    """both spectra whitened in the band first."""
    return _weighted(a, b, rate, lambda x, y: x / (np.abs(x) + 1e-9) * (y / (np.abs(y) + 1e-9)).conj())


def spectrogram(x: np.ndarray, frame: int = FRAME, hop: int = HOP, power: float = 1.0) -> np.ndarray:
    """sizes to a power of the spectra (frequencies, frames) of Hann-windowed frames, every hop samples."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    if len(x) < frame:
        x = np.pad(x, (0, frame - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    return np.abs(np.fft.rfft(frames * window, axis=1)).T ** power


def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """triangles (mels, frequencies) evenly spaced in mel = 2595 log10(1 + hz / 700) up to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    corners = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    hz = rate * np.arange(frame // 2 + 1) / frame
    left, centre, right = corners[:-2, None], corners[1:-1, None], corners[2:, None]
    return np.where(hz <= centre, np.clip((hz - left) / (centre - left), 0, None), np.clip((right - hz) / (right - centre), 0, None))


def mel_spectrogram(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, mels: int = MELS, power: float = 2.0) -> np.ndarray:
    """a spectrogram in mel bands."""
    return mel_filters(rate, frame, mels) @ spectrogram(x, frame, hop, power)


def onset_envelope(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Mean rise over frequencies from each frame to the next."""
    return np.maximum(np.diff(spectrogram(x, frame, hop), axis=1), 0).mean(axis=0)


def mel_level(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, mels: int = MELS) -> np.ndarray:
    """Mean over mel bands of each frame's level in dB below the loudest."""
    db = 10 * np.log10(np.maximum(mel_spectrogram(x, rate, frame, hop, mels), 1e-10))
    return (db - db.max()).mean(axis=0)


def _feature_lag(a: np.ndarray, b: np.ndarray, hop: int) -> tuple[float, float, int]:
    """The lag in samples of two sequences of a value for each hop, by phases; besides, how many values they have."""
    x, y, n = _spectra(_standardised(a), _standardised(b))
    cross = x * y.conj()
    lag, confidence = feature_peak(np.round(np.fft.irfft(cross / (np.abs(cross) + 1e-9), n), 9), min(len(a), len(b)) // 2)
    return float(lag * hop), confidence, min(len(a), len(b))


@scorer("onset", frames="long")
def onset(a: np.ndarray, b: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP) -> tuple[float, float, int]:
    """correlation of rises in the spectrum."""
    return _feature_lag(onset_envelope(a, frame, hop), onset_envelope(b, frame, hop), hop)


@scorer("mel", frames="long")
def mel(a: np.ndarray, b: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, mels: int = MELS) -> tuple[float, float, int]:
    """correlation of mel levels."""
    return _feature_lag(mel_level(a, rate, frame, hop, mels), mel_level(b, rate, frame, hop, mels), hop)


def score_pairs(pairs: DataFrame, name: str = "standard", rate: float = 16_000.0, **settings: int) -> DataFrame:
    """(target, window, lag, confidence) of pairs(target, window, ref array, tgt array) by a registered scorer, in Arrow batches."""
    ship(pairs.sparkSession)
    score = SCORERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [score(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rate, **settings) for a, b in zip(batch["ref"], batch["tgt"])]
            yield pd.DataFrame({"target": batch["target"], "window": batch["window"], "lag": [float(f[0]) for f in found], "confidence": [f[1] for f in found]})

    return pairs.select("target", "window", "ref", "tgt").mapInPandas(run, "target string, window long, lag double, confidence double")


def window_pairs(samples: DataFrame, reference: str, size: int, hop: int) -> DataFrame:
    """Whole windows of a reference signal beside those of every other: (target, window, centre, ref, tgt), centre in samples."""
    rows = hopping(samples, size, hop)
    arrays = rows.groupBy("signal", "window").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s")).where(F.size("s") == size)
    values = arrays.select("signal", "window", F.transform("s", lambda x: x["value"]).alias("v"))
    a = values.where(F.col("signal") == reference).select("window", F.col("v").alias("ref"))
    b = values.where(F.col("signal") != reference).select(F.col("signal").alias("target"), "window", F.col("v").alias("tgt"))
    return b.join(a, "window").select("target", "window", (F.col("window") * hop + F.lit(size / 2)).alias("centre"), "ref", "tgt")


_LEVELS = ", lv AS (SELECT signal, sample_idx // 16 AS block, 20 * log10(sqrt(avg(value * value))) AS db FROM pcm GROUP BY 1, 2 HAVING count(*) = 16)"
_RUNS = _LEVELS + """, q AS (SELECT signal, block, db, block - row_number() OVER (PARTITION BY signal ORDER BY block) AS g FROM lv WHERE db < -15),
rn AS (SELECT signal, min(block) AS first, max(block) AS last, count(*) AS length, avg(db) AS mean_db FROM q GROUP BY signal, g HAVING count(*) >= 2)"""


@query("signal_levels", oracle("pcm", body=_LEVELS + " SELECT signal, block, round(db, 6) + 0.0 AS db FROM lv"))
def q_levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels(pcm(spark, sf)).select("signal", "block", r6(F.col("db")).alias("db"))


@query("signal_levels_int", oracle("pcm", body=" SELECT signal, sample_idx // 16 AS block, round(greatest(20 * log10(sqrt(avg(power(trunc(value * 2147483647), 2)) / power(2147483648.0, 2))), -96), 6) + 0.0 AS db FROM pcm GROUP BY 1, 2"))
def q_levels_int(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("value") * 2147483647).cast("long").cast("double")
    return pcm(spark, sf).groupBy("signal", F.floor(F.col("sample_idx") / BLOCK).alias("block")).agg(r6(rms_db_int(F.avg(x * x))).alias("db"))


@query("signal_diagnostics", oracle("pcm", body=" SELECT signal, round(min(value), 6) AS least, round(max(value), 6) AS most, round(stddev_pop(value), 6) AS std FROM pcm GROUP BY 1"))
def q_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """A42."""
    return pcm(spark, sf).groupBy("signal").agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("signal_hopping", oracle("pcm", body=""", w AS (SELECT signal, value, unnest(range(greatest(floor((sample_idx - 32) / 8.0)::BIGINT + 1, 0), sample_idx // 8 + 1)) AS "window" FROM pcm)
SELECT signal, "window", count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM w GROUP BY 1, 2"""))
def q_hopping(spark: SparkSession, sf: str) -> DataFrame:
    return hopping(pcm(spark, sf), 32, 8).groupBy("signal", "window").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query("signal_quiet_runs", oracle("pcm", body=_RUNS + " SELECT signal, first, last, length, round(mean_db, 6) + 0.0 AS mean_db FROM rn"))
def q_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs(levels(pcm(spark, sf)), F.col("db") < -15, 2).withColumn("mean_db", r6(F.col("mean_db")))


@query("signal_transients", oracle("pcm", body=_LEVELS + ", j AS (SELECT signal, block, db - lag(db) OVER (PARTITION BY signal ORDER BY block) AS jump FROM lv) SELECT signal, block, round(jump, 6) + 0.0 AS jump FROM j WHERE jump >= 3"))
def q_transients(spark: SparkSession, sf: str) -> DataFrame:
    return transients(levels(pcm(spark, sf)), 3.0).select("signal", "block", r6(F.col("jump")).alias("jump"))


@query("signal_crossings", oracle("pcm", body=""", c AS (SELECT signal, sample_idx FROM (SELECT signal, sample_idx, value >= 0.1 AS a, lead(value >= 0.1) OVER (PARTITION BY signal ORDER BY sample_idx) AS b FROM pcm) WHERE a <> b),
b AS (SELECT p.signal, p.sample_idx AS target, arg_min(c.sample_idx, (abs(c.sample_idx - p.sample_idx), c.sample_idx)) AS hit FROM pcm p LEFT JOIN c ON c.signal = p.signal AND c.sample_idx BETWEEN p.sample_idx - 5 AND p.sample_idx + 5 GROUP BY 1, 2)
SELECT signal, target, coalesce(hit, target) AS snapped FROM b"""))
def q_crossings(spark: SparkSession, sf: str) -> DataFrame:
    samples = pcm(spark, sf)
    return nearest_crossing(samples.select("signal", F.col("sample_idx").alias("target")), crossings(samples, 0.1), 5)


REFERENCE = "click"


@query("zone_intersections", oracle("pcm", body=_RUNS + """ SELECT b.signal AS target, greatest(a.first, b.first) AS start, least(a.last, b.last) + 1 AS "end" FROM rn a JOIN rn b ON a.signal = 'click' AND b.signal <> 'click' AND greatest(a.first, b.first) < least(a.last, b.last) + 1"""))
def q_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's quiet runs with those of every other signal."""
    found = runs(levels(pcm(spark, sf)), F.col("db") < -15, 2).select("signal", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
    others = found.where(F.col("signal") != REFERENCE)
    own = others.select(F.col("signal").alias("pair")).distinct().crossJoin(found.where(F.col("signal") == REFERENCE).select("start", "end"))  # once for each target
    return intersect_zones(own, others.withColumnRenamed("signal", "pair")).withColumnRenamed("pair", "target")


_BLOCK_S = 0.05
_ZONES = _RUNS + """, z AS (SELECT signal, 'rms' AS source, first * 0.05 AS start_s, (last + 1) * 0.05 AS end_s, mean_db, CASE WHEN signal = 'view' THEN 2.0 ELSE 3.0 END AS target_s FROM rn WHERE signal <> 'error'
  UNION ALL SELECT signal, 'vad', (first - 0.5) * 0.05, (last + 0.5) * 0.05, mean_db, 2.5 FROM rn WHERE signal IN ('error', 'view')
  UNION ALL SELECT signal, 'combined', first * 0.05, (last + 0.5) * 0.05, mean_db, 2.5 FROM rn WHERE signal = 'signup'),
j AS (SELECT signal, block * 0.05 AS time_s FROM (SELECT signal, block, db - lag(db) OVER (PARTITION BY signal ORDER BY block) AS jump FROM lv) WHERE jump >= 3),
s AS (SELECT *, (SELECT count(*) FROM j WHERE j.signal = z.signal AND time_s BETWEEN start_s - 0.05 AND end_s + 0.05) AS jumps FROM z),
t AS (SELECT *, greatest((5 - abs((start_s + end_s) / 2 - target_s)) / 5, 0) * 5 + greatest((-16 - mean_db) / 10, 0) * 10 + least(end_s - start_s, 1) * 2 - 3 * jumps AS score FROM s)"""


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    blocks = levels(pcm(spark, sf))
    found = runs(blocks, F.col("db") < -15, 2)
    signal, first, last = F.col("signal"), F.col("first"), F.col("last")

    def zone(rows: DataFrame, source: str, start: Column, end: Column, target: Column) -> DataFrame:
        return rows.select("signal", F.lit(source).alias("source"), (start * _BLOCK_S).alias("start_s"), (end * _BLOCK_S).alias("end_s"), "mean_db", target.alias("target_s"))

    zones = zone(found.where(signal != "error"), "rms", first, last + 1, F.when(signal == "view", 2.0).otherwise(3.0))
    zones = zones.unionByName(zone(found.where(signal.isin("error", "view")), "vad", first - 0.5, last + 0.5, F.lit(2.5)))
    zones = zones.unionByName(zone(found.where(signal == "signup"), "combined", first, last + 0.5, F.lit(2.5)))
    jumps = transients(blocks, 3.0).select("signal", (F.col("block") * _BLOCK_S).alias("time_s"))
    return jumps_near(zones, jumps, "signal")


@query("zone_choice", oracle("pcm", body=_ZONES + """ SELECT signal, source, round(start_s, 6) + 0.0 AS start_s, round(end_s, 6) + 0.0 AS end_s, jumps, round(score, 6) + 0.0 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY CASE source WHEN 'combined' THEN 0 WHEN 'rms' THEN 1 ELSE 2 END, round(score, 6) DESC, start_s) AS k FROM t) WHERE k = 1"""))
def q_choice(spark: SparkSession, sf: str) -> DataFrame:
    best = best_zone(_zones(spark, sf), "signal", threshold_db=-16.0)
    return best.select("signal", "source", *[r6(F.col(c)).alias(c) for c in ("start_s", "end_s")], "jumps", r6(F.col("score")).alias("score"))


@query("voice_gaps", oracle("pcm", body=_LEVELS + """, q AS (SELECT signal, block, db, block - row_number() OVER (PARTITION BY signal ORDER BY block) AS g FROM lv WHERE NOT (db >= -15 AND block % 3 <> 0))
SELECT signal, min(block) AS first, max(block) AS last, count(*) AS length FROM q GROUP BY signal, g HAVING count(*) >= 2"""))
def q_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between voiced frames; here a frame is voiced if it is loud and not every third."""
    voiced = levels(pcm(spark, sf)).withColumn("voiced", (F.col("db") >= -15) & (F.col("block") % 3 != 0))
    return runs(voiced, ~F.col("voiced"), 2).select("signal", "first", "last", "length")


@query("silence_gate", oracle("pcm", body=_LEVELS + ", g AS (SELECT b.signal AS target, least(a.db, b.db) >= -14 AS kept FROM lv a JOIN lv b USING (block) WHERE a.signal = 'click' AND b.signal <> 'click') SELECT target, count(*) AS windows, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS silent FROM g GROUP BY 1"))
def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of each target in which both signals are loud enough, and how many were dropped."""
    blocks = levels(pcm(spark, sf))
    a = blocks.where(F.col("signal") == REFERENCE).select("block", F.col("db").alias("a"))
    b = blocks.where(F.col("signal") != REFERENCE).select("block", F.col("signal").alias("target"), F.col("db").alias("b"))
    kept = F.least("a", "b") >= -14
    return b.join(a, "block").groupBy("target").agg(F.count(F.lit(1)).alias("windows"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("silent"))


@query("pair_standard", oracle("pcm", body=""", w AS (SELECT signal, sample_idx, value, unnest(range(greatest(floor((sample_idx - 64) / 32.0)::BIGINT + 1, 0), sample_idx // 32 + 1)) AS win FROM pcm),
m AS (SELECT signal, win, sample_idx - win * 32 AS i, (value - avg(value) OVER p) / (stddev_pop(value) OVER p + 1e-9) AS v, count(*) OVER p AS n FROM w WINDOW p AS (PARTITION BY signal, win)),
x AS (SELECT b.signal AS target, a.win, a.i - b.i AS lag, abs(sum(a.v * b.v)) AS s FROM m a JOIN m b ON a.win = b.win AND a.signal = 'click' AND b.signal <> 'click' AND a.n = 64 AND b.n = 64 GROUP BY 1, 2, 3),
e AS (SELECT signal, win, sum(v * v) AS e FROM m WHERE n = 64 GROUP BY 1, 2)
SELECT x.target, x.win AS "window", x.win * 32 + 32.0::DOUBLE AS centre, arg_max(lag, s)::DOUBLE AS lag, round(greatest(least(max(s) / (sqrt(any_value(a.e) * any_value(b.e)) + 1e-9) * 100, 100), 0), 4) + 0.0 AS confidence
FROM x JOIN e a ON a.signal = 'click' AND a.win = x.win JOIN e b ON b.signal = x.target AND b.win = x.win GROUP BY 1, 2"""))
def q_standard(spark: SparkSession, sf: str) -> DataFrame:
    """Every other signal against the reference."""
    pairs = window_pairs(pcm(spark, sf), REFERENCE, 64, 32)
    found = score_pairs(pairs).withColumn("confidence", F.round("confidence", 4) + F.lit(0.0))
    return found.withColumn("centre", F.col("window") * 32 + F.lit(32.0))
