"""Table functions that SQL can call once register() has made them known: spectrogram and score_pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructType

from tidemark.operators.signals import DETAILED, FRAME, HOP, mel_filters
from tidemark.session import ship

_TYPES = {"double": DoubleType(), "long": LongType(), "string": StringType()}


def _columns(table: AnalyzeArgument, function: str, *wanted: str) -> StructType:
    """The schema of a table argument; an error that names what it lacks."""
    if not table.isTable:
        raise ValueError(f"{function} takes a table")
    lacking = [c for c in wanted if c not in table.dataType.names]
    if lacking:
        raise ValueError(f"{function} needs the columns {', '.join(wanted)}; the table lacks {', '.join(lacking)}")
    return table.dataType


def _constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class Spectrogram:
    """F52 over TABLE(chunks) PARTITION BY signal, span ORDER BY chunk: a row for each whole frame that starts inside a span.

    chunks(signal, span, chunk, first, total, last_start, x): first is the number of x[0] in
    its signal, total the signal's samples, last_start the first sample that starts no more
    frames of the span. Samples that a frame needs beyond a chunk are carried over to the
    next, so a task holds a chunk and a frame. A signal shorter than a frame is filled up
    with zeros.
    """

    def __init__(self):
        self.held, self.at, self.start, self.row = np.zeros(0), None, None, None

    @staticmethod
    def analyze(chunks: AnalyzeArgument, frame: AnalyzeArgument, hop: AnalyzeArgument, power: AnalyzeArgument, mels: AnalyzeArgument, rate: AnalyzeArgument) -> AnalyzeResult:
        schema = _columns(chunks, "spectrogram", "signal", "span", "chunk", "first", "total", "last_start", "x")
        for name, argument in (("frame", frame), ("hop", hop)):
            if int(_constant(argument, name)) < 1:
                raise ValueError(f"{name} must be at least 1")
        return AnalyzeResult(StructType().add("signal", schema["signal"].dataType).add("frame", LongType()).add("powers", ArrayType(DoubleType())))

    def eval(self, chunks: Row, frame: int, hop: int, power: float, mels: int, rate: float) -> Iterator[tuple]:
        if self.row is None:
            self.frame, self.hop, self.power = frame, hop, float(power)
            self.window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
            self.filters = mel_filters(float(rate), frame, mels) if mels else None
            self.start = -(-chunks["first"] // hop) * hop  # the first frame that starts at or after the span's first sample
            self.at = chunks["first"]
        self.row = chunks
        self.held = np.concatenate([self.held, np.asarray(chunks["x"], dtype=float)])
        yield from self._frames()

    def _frames(self) -> Iterator[tuple]:
        while self.start < self.row["last_start"] and self.start + self.frame <= self.at + len(self.held):
            yield self._one(self.held[self.start - self.at : self.start - self.at + self.frame])
            self.start += self.hop
        drop = min(max(self.start - self.at, 0), len(self.held))
        self.held, self.at = self.held[drop:], self.at + drop

    def _one(self, x: np.ndarray) -> tuple:
        spectrum = np.abs(np.fft.rfft(x * self.window)) ** self.power
        if self.filters is not None:
            spectrum = self.filters @ spectrum
        return self.row["signal"], self.start // self.hop, spectrum.tolist()

    def terminate(self) -> Iterator[tuple]:
        if self.row is not None and self.row["total"] < self.frame and self.start == 0:
            yield self._one(np.pad(self.held, (0, self.frame - len(self.held))))


def chunked(samples: DataFrame, frame: int, size: int = 4096, span: int = 64) -> DataFrame:
    """The chunks that spectrogram() takes of samples(signal, sample_idx from 0 without gaps, value): size samples each, span of them to a partition, and behind each span those chunks again that its last frames reach into."""
    totals = samples.groupBy("signal").agg((F.max("sample_idx") + 1).alias("total"))
    pieces = samples.groupBy("signal", F.floor(F.col("sample_idx") / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("sample_idx", F.col("value").cast("double").alias("v")))).alias("s"))
    reach = -(-(frame - 1) // size)
    spans = F.sequence(F.floor(F.greatest(F.col("chunk") - reach, F.lit(0)) / span), F.floor(F.col("chunk") / span))
    rows = pieces.join(totals, "signal").withColumn("span", F.explode(spans))
    x = F.transform("s", lambda s: F.coalesce(s["v"], F.lit(0.0)))
    return rows.select("signal", "span", "chunk", F.col("s")[0]["sample_idx"].alias("first"), "total", ((F.col("span") + 1) * span * size).alias("last_start"), x.alias("x"))


def spectrogram(samples: DataFrame, frame: int = FRAME, hop: int = HOP, power: float = 1.0, mels: int = 0, rate: float = 16_000.0, size: int = 4096, span: int = 64) -> DataFrame:
    """(signal, frame, band, power) of every whole Hann-windowed frame: sizes of the spectrum to a power, summed in mels bands if there are any. Null values count as 0."""
    ship(samples.sparkSession)
    rows = chunked(samples, frame, size, span).asTable().partitionBy("signal", "span").orderBy("chunk")
    found = udtf(Spectrogram)(rows, *map(F.lit, (frame, hop, power, mels, rate)))
    return found.select("signal", "frame", F.posexplode("powers").alias("band", "power"))


def onset_envelope(bands: DataFrame) -> DataFrame:
    """(signal, frame, rise) of a spectrogram: the mean over bands of how much each rose since the frame before. Frames meet by number."""
    before = bands.select("signal", (F.col("frame") + 1).alias("frame"), "band", F.col("power").alias("was"))
    return bands.join(before, ["signal", "frame", "band"]).groupBy("signal", "frame").agg(F.avg(F.greatest(F.col("power") - F.col("was"), F.lit(0.0))).alias("rise"))


def scorers_function(scorers: dict[str, tuple[dict[str, str], object]] | None = None):
    """The table function score_pairs(name, TABLE(pairs), rate, settings...) over the scorers registered by now.

    pairs(target, window, ref, tgt) may have other columns, which are left out. The
    result has target, window, lag and confidence, and the columns that the scorer gives
    besides; an unknown name is an error of analysis that lists the known ones. Scorers
    are sent along, so those that a user registered need not be importable elsewhere.
    """
    known = dict(scorers or DETAILED)
    types = _TYPES

    class ScorePairs:
        @staticmethod
        def analyze(scorer: AnalyzeArgument, pairs: AnalyzeArgument, rate: AnalyzeArgument = None, **settings: AnalyzeArgument) -> AnalyzeResult:
            name = _constant(scorer, "the scorer's name")
            if name not in known:
                raise ValueError(f"no scorer {name}; there are {', '.join(sorted(known))}")
            given = _columns(pairs, "score_pairs", "target", "window", "ref", "tgt")
            schema = StructType().add("target", given["target"].dataType).add("window", given["window"].dataType).add("lag", DoubleType()).add("confidence", DoubleType())
            for column, kind in known[name][0].items():
                schema = schema.add(column, types[kind])
            return AnalyzeResult(schema)

        def eval(self, scorer: str, pairs: Row, rate: float = 16_000.0, **settings: int) -> Iterator[tuple]:
            lag, *rest = known[scorer][1](np.asarray(pairs["ref"], dtype=float), np.asarray(pairs["tgt"], dtype=float), float(rate), **settings)
            plain = [r.item() if isinstance(r, np.generic) else r for r in rest]
            yield (pairs["target"], pairs["window"], float(lag), *plain)

    return udtf(ScorePairs)


def register(spark: SparkSession) -> list[str]:
    """Make spectrogram and score_pairs, with all scorers registered by now, known to a session's SQL; their names."""
    ship(spark)
    spark.udtf.register("spectrogram", udtf(Spectrogram))
    spark.udtf.register("score_pairs", scorers_function())
    return [name for name in ("score_pairs", "spectrogram") if spark.catalog.functionExists(name)]
