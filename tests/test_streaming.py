"""The streaming extension gives what the same counts over a whole table do."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tidemark.plans.fixtures import windows
from tidemark.session import table
from tidemark.streaming.windows import delay_counts, window_modes


def test_counts_of_a_stream_are_those_of_the_table(spark, tiny):
    rows = windows(spark, tiny).withColumn("ts", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("start_s"))))
    folder, checkpoints = (tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    rows.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    query = delay_counts(stream, "1 day", "6 hours", "1 hour").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counted").select("start", "source_key", "delay_ms", "n").collect()}
    expected = {tuple(r) for r in delay_counts(rows, "1 day", "6 hours", "1 hour").select("start", "source_key", "delay_ms", "n").collect()}
    assert got == expected and got
    modes = window_modes(spark.table("counted"))
    assert modes.count() == spark.table("counted").select("start", "source_key").distinct().count()
    assert table(spark, tiny, "events").count() == rows.count()
