"""Filters of sampled signals (F20, U23): a windowed-sinc low-pass, and recursive filters whose state is carried over blocks by a prefix scan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.fixtures import oracle, pcm, r6
from tidemark.plans.registry import query
from tidemark.session import ship

#: Samples in a block, and blocks whose maps one task composes at a time.
BLOCK, FAN = 4096, 256


def low_pass_taps(rate: float, cutoff: float, taps: int = 101) -> list[float]:
    """A windowed-sinc filter: Hamming window, unit gain at 0 Hz, an odd number of taps. A cutoff of half the rate or more counts as one Hz less than that."""
    n = taps | 1
    at = np.arange(n) - n // 2
    cutoff = min(cutoff, rate / 2 - 1)
    ideal = 2 * cutoff / rate * np.sinc(2 * cutoff / rate * at)
    weighed = ideal * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)))
    return (weighed / weighed.sum()).tolist()


def convolved(samples: DataFrame, taps: list[float]) -> DataFrame:
    """Each sample as the sum of itself and those before it by a filter's taps. A sample is sent once for each tap that it counts under, so no task needs a whole signal."""
    sent = samples.select("signal", "value", F.posexplode(F.array(*map(F.lit, taps))).alias("k", "tap"), "sample_idx").select("signal", (F.col("sample_idx") + F.col("k")).alias("sample_idx"), (F.col("value") * F.col("tap")).alias("part"))
    summed = sent.groupBy("signal", "sample_idx").agg(F.sum("part").alias("filtered"))
    return samples.join(summed, ["signal", "sample_idx"])


def band_pass_section(rate: float, low: float, high: float) -> tuple[list[float], list[float]] | None:
    """(b, a) of the two-pole section around the middle of a band, b for samples and a, less its leading 1, for results; None where the band isn't inside (0, rate / 2)."""
    if not 0 < low < high < rate / 2:
        return None
    middle, width = math.pi * (low + high) / rate, 2 * math.pi * (high - low) / rate
    alpha = math.sin(width / 2) / math.sqrt(2)
    return [alpha / (1 + alpha), 0.0, -alpha / (1 + alpha)], [-2 * math.cos(middle) / (1 + alpha), (1 - alpha) / (1 + alpha)]


class Recurrence:
    """y[i] = sum b[k] x[i - k] - sum a[k] y[i - k] as a state of as many numbers as the filter has poles.

    n samples move the state by an affine map. Its linear part is a power of one matrix,
    so n and the vector that is added, the state that they leave behind when they start
    from rest, say all of it, and maps one after the other make a map again.
    """

    def __init__(self, b: list[float], a: list[float]):
        self.b, self.a, self.order = np.array(b), np.array(a), len(a)
        if len(b) != len(a) + 1:
            raise ValueError("b must have one coefficient more than a")
        self.step = np.eye(self.order, k=1)
        self.step[:, 0] -= self.a

    def after(self, n: int, state: np.ndarray, added: np.ndarray) -> np.ndarray:
        """The state after n samples that leave added behind from rest."""
        return np.linalg.matrix_power(self.step, n) @ state + added

    def run(self, rows: list[np.ndarray], states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(results, states left behind) of rows of samples, side by side, each from its own state."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order])
        x = np.zeros((len(rows), lengths[0] if len(rows) else 0))
        for at, i in enumerate(order):
            x[at, : len(rows[i])] = rows[i]
        y, z = np.zeros_like(x), states[order].astype(float)
        for t in range(x.shape[1]):
            k = int((lengths > t).sum()) if lengths[-1] <= t else len(rows)
            now = self.b[0] * x[:k, t] + z[:k, 0]
            y[:k, t] = now
            z[:k, :-1] = z[:k, 1:]
            z[:k, -1] = 0
            z[:k] += np.outer(x[:k, t], self.b[1:]) - np.outer(now, self.a)
        back = np.argsort(order)
        return [y[at, : len(rows[i])] for i, at in enumerate(back)], z[back]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.float64()))


def _blocks(samples: DataFrame, size: int) -> DataFrame:
    """(signal, block, first, x): samples in order as arrays of at most size; null samples count as 0."""
    rows = samples.groupBy("signal", F.floor(F.col("sample_idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("sample_idx", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")))).alias("s"))
    return rows.select("signal", "block", F.transform("s", lambda s: s["sample_idx"]).alias("at"), F.transform("s", lambda s: s["v"]).alias("x"))


def _maps(blocks: DataFrame, filter_: Recurrence) -> DataFrame:
    """(signal, block, n, added): each block's map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x, dtype=float) for x in batch.column("x").to_pylist()]
            added = filter_.run(rows, np.zeros((len(rows), filter_.order)))[1]
            yield pa.RecordBatch.from_arrays([batch.column("signal"), batch.column("block"), pa.array([len(x) for x in rows], pa.int64()), _lists(added)], names=["signal", "block", "n", "added"])

    return blocks.select("signal", "block", "x").mapInArrow(run, "signal string, block long, n long, added array<double>")


def entering(maps: DataFrame, filter_: Recurrence, last: int, fan: int = FAN) -> DataFrame:
    """(signal, block, state): the state in which each block is entered, the first at rest. last is the highest block number.

    A prefix scan in levels: the maps of fan neighbouring blocks are composed into one,
    these again, until a signal has at most fan; then each level hands the states down.
    A task holds fan maps, and the levels grow with the logarithm of the blocks.
    """
    group = F.floor(F.col("block") / fan)
    groups = maps.groupBy("signal", group.alias("group")).agg(F.sort_array(F.collect_list(F.struct("block", "n", "added"))).alias("maps"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [], []
            for maps_ in batch.column("maps").to_pylist():
                state = np.zeros(filter_.order)
                for m in maps_:
                    state = filter_.after(m["n"], state, np.array(m["added"]))
                counts.append(sum(m["n"] for m in maps_))
                sums.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("signal"), batch.column("group"), pa.array(counts, pa.int64()), _lists(np.array(sums).reshape(-1, filter_.order))], names=["signal", "block", "n", "added"])

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, blocks, states = [], [], []
            for i, (maps_, state) in enumerate(zip(batch.column("maps").to_pylist(), batch.column("state").to_pylist())):
                state = np.array(state)
                for m in maps_:
                    own.append(i)
                    blocks.append(m["block"])
                    states.append(state)
                    state = filter_.after(m["n"], state, np.array(m["added"]))
            yield pa.RecordBatch.from_arrays([batch.column("signal").take(pa.array(own, pa.int64())), pa.array(blocks, pa.int64()), _lists(np.array(states).reshape(-1, filter_.order))], names=["signal", "block", "state"])

    if last < fan:
        known = groups.withColumn("state", F.array(*[F.lit(0.0)] * filter_.order))
    else:
        upper = entering(groups.mapInArrow(compose, "signal string, block long, n long, added array<double>"), filter_, last // fan, fan)
        known = groups.join(upper.withColumnRenamed("block", "group"), ["signal", "group"])
    return known.mapInArrow(hand_down, "signal string, block long, state array<double>")


def recursive(samples: DataFrame, b: list[float], a: list[float], size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """samples(signal, sample_idx, value) with filtered, the recursive filter's results; a signal's first sample meets a filter at rest.

    Blocks of size samples become maps of the state, a prefix scan gives the state in
    which each is entered, and then all blocks run side by side. Samples follow each
    other by sample_idx; numbers that are missing are passed over, null values count as
    0. An empty table gives none.
    """
    ship(samples.sparkSession)
    filter_ = Recurrence(b, a)
    last = samples.agg(F.max(F.floor(F.col("sample_idx") / size))).first()[0]
    blocks = _blocks(samples, size)
    states = entering(_maps(blocks, filter_), filter_, last or 0, fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x, dtype=float) for x in batch.column("x").to_pylist()]
            results = filter_.run(rows, np.array(batch.column("state").to_pylist(), dtype=float).reshape(-1, filter_.order))[0]
            own = pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows]))
            yield pa.RecordBatch.from_arrays([batch.column("signal").take(own), batch.column("at").flatten(), pa.array(np.concatenate([*results, np.zeros(0)]))], names=["signal", "sample_idx", "filtered"])

    found = blocks.join(states, ["signal", "block"]).select("signal", "at", "x", "state").mapInArrow(run, "signal string, sample_idx long, filtered double")
    return samples.join(found, ["signal", "sample_idx"])


def filtered(samples: DataFrame, kind: str, rate: float, cutoff: float = 3400.0, taps: int = 101, low: float = 300.0, high: float = 3400.0, **blocks: int) -> DataFrame:
    """Samples with filtered: as they are (none), through the low-pass or through the band-pass filter. A cutoff of 0 or less, and a band that isn't inside (0, rate / 2), leave samples as they are."""
    if kind not in ("none", "low_pass", "band_pass"):
        raise ValueError(f"filter {kind} is not supported")
    section = band_pass_section(rate, low, high)
    if kind == "low_pass" and cutoff > 0:
        return convolved(samples, low_pass_taps(rate, cutoff, taps))
    if kind == "band_pass" and section:
        return recursive(samples, *section, **blocks)
    return samples.withColumn("filtered", F.col("value"))


_TAPS = low_pass_taps(16_000.0, 3400.0, 9)


@query("signal_filtered", oracle("pcm", body=f", t AS (SELECT unnest({_TAPS}) AS tap, unnest(range(0, {len(_TAPS)})) AS k) SELECT p.signal, p.sample_idx, round(sum(q.value * tap), 6) + 0.0 AS filtered FROM pcm p, t, pcm q WHERE q.signal = p.signal AND q.sample_idx = p.sample_idx - k GROUP BY 1, 2"))
def q_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The low-pass filter."""
    return filtered(pcm(spark, sf), "low_pass", 16_000.0, 3400.0, 9).select("signal", "sample_idx", r6(F.col("filtered")).alias("filtered"))


# The recurrence as it is written down, sample by sample, from the cosine and sine of the band's middle and half width.
_RECURSION = oracle("pcm", body=""", c AS (SELECT sin(pi() * 3100 / 16000) / sqrt(2) AS alpha, cos(pi() * 3700 / 16000) AS turn),
wave AS MATERIALIZED (SELECT signal, sample_idx, value AS x, coalesce(lag(value, 2) OVER (PARTITION BY signal ORDER BY sample_idx), 0) AS x2 FROM pcm),
run AS (SELECT signal, -1::BIGINT AS sample_idx, 0.0::DOUBLE AS y, 0.0::DOUBLE AS y1 FROM pcm GROUP BY 1
  UNION ALL SELECT w.signal, w.sample_idx, (alpha * (w.x - w.x2) + 2 * turn * r.y - (1 - alpha) * r.y1) / (1 + alpha), r.y FROM run r JOIN wave w ON w.signal = r.signal AND w.sample_idx = r.sample_idx + 1, c)
SELECT signal, sample_idx, round(y, 6) + 0.0 AS filtered FROM run WHERE sample_idx >= 0""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("signal_band_pass", _RECURSION)
def q_band_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The band-pass filter over every sample, its state carried over blocks of 64 samples."""
    return filtered(pcm(spark, sf), "band_pass", 16_000.0, low=300.0, high=3400.0, size=64).select("signal", "sample_idx", r6(F.col("filtered")).alias("filtered"))
