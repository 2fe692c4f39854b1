"""An extension beyond batches: delays of a stream of scored windows, counted in hopping windows of time as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delay_counts(stream: DataFrame, length: str = "10 minutes", hop: str = "2 minutes", late: str = "5 minutes") -> DataFrame:
    """(start, end, source_key, delay_ms, n, raw_ms) of accepted windows(ts, source_key, delay_ms, raw_delay_ms, accepted) by hopping windows of time.

    Rows that come later than the watermark are dropped by the engine, as their
    window is done. The most common delay of a window is the batch step over these
    counts.
    """
    own = stream.where("accepted").withWatermark("ts", late)
    window = F.window("ts", length, hop)
    counted = own.groupBy(window.alias("w"), "source_key", "delay_ms").agg(F.count(F.lit(1)).alias("n"), F.avg("raw_delay_ms").alias("raw_ms"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source_key", "delay_ms", "n", "raw_ms")


def window_modes(counts: DataFrame) -> DataFrame:
    """The most common delay of each source in each window of time; of equals the smallest."""
    best = F.max_by(F.struct("delay_ms", "n", "raw_ms"), F.struct("n", -F.col("delay_ms")))
    return counts.groupBy("start", "end", "source_key").agg(best.alias("b")).select("start", "end", "source_key", "b.delay_ms", "b.n", "b.raw_ms")
