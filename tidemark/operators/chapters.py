"""Chapters: times in nanoseconds, order and ends, and snapping to keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.fixtures import chapters, keyframes, oracle
from tidemark.plans.registry import query

SECOND = 1_000_000_000


def format_ns(ns: Column) -> Column:
    """HH:MM:SS.nnnnnnnnn; negative times count as 0."""
    t = F.greatest(ns, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d.%09d", F.floor(t / (3600 * SECOND)), F.floor(t / (60 * SECOND)) % 60, F.floor(t / SECOND) % 60, t % SECOND)


def parse_ns(text: Column) -> Column:
    """the inverse; digits after the dot are padded or cut to nine."""
    part = F.split(text, "[:.]")
    fraction = F.substring(F.rpad(F.coalesce(F.get(part, F.lit(3)), F.lit("0")), 9, "0"), 1, 9)
    return (F.get(part, F.lit(0)).cast("long") * 3600 + F.get(part, F.lit(1)).cast("long") * 60 + F.get(part, F.lit(2)).cast("long")) * SECOND + fraction.cast("long")


def format_delta(ns: Column) -> Column:
    """a signed difference in ns below a microsecond, µs below a millisecond, ms above."""
    size = F.abs(ns)
    return F.when(size < 1000, F.format_string("%+dns", ns)).when(size < 1_000_000, F.format_string("%+.3fµs", ns / 1000.0)).otherwise(F.format_string("%+.3fms", ns / 1_000_000.0))


def first_of_start(rows: DataFrame) -> DataFrame:
    """One chapter for each start of a track, the first by id."""
    order = Window.partitionBy("track", "start_ns").orderBy("id")
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def seamless(rows: DataFrame) -> DataFrame:
    """Each chapter ends where the next one starts; the last lasts a second."""
    order = Window.partitionBy("track").orderBy("start_ns", "id")
    return rows.withColumn("end_ns", F.coalesce(F.lead("start_ns").over(order), F.col("start_ns") + SECOND))


def renamed(rows: DataFrame) -> DataFrame:
    """Chapter 01, Chapter 02, ... by start."""
    return rows.withColumn("name", F.format_string("Chapter %02d", F.row_number().over(Window.partitionBy("track").orderBy("start_ns", "id"))))


def shifted(rows: DataFrame, ms: int) -> DataFrame:
    """Starts moved by whole milliseconds."""
    return rows.withColumn("start_ns", F.col("start_ns") + F.lit(ms) * 1_000_000)


def snapped(rows: DataFrame, keys: DataFrame, threshold_ns: int) -> DataFrame:
    """Starts with the nearest keyframe's time where it is within the threshold; of equally near ones the earlier.

    Two ordered windows over both tables find the keyframe before and the one after.
    """
    both = rows.select("track", "id", F.col("start_ns").alias("t"), F.lit(None).cast("long").alias("k"), F.lit(1).alias("is_row")).unionByName(keys.select("track", F.lit(None).cast("long").alias("id"), F.col("key_ns").alias("t"), F.col("key_ns").alias("k"), F.lit(0).alias("is_row")))
    up = Window.partitionBy("track").orderBy("t", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("track").orderBy(F.desc("t"), "is_row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("before", F.last("k", ignorenulls=True).over(up)).withColumn("after", F.last("k", ignorenulls=True).over(down)).where("is_row = 1")
    near = F.when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    return found.select("track", "id", F.col("t").alias("start_ns"), near.alias("near_ns")).withColumn("snapped_ns", F.when(F.abs(F.col("near_ns") - F.col("start_ns")) <= threshold_ns, F.col("near_ns")).otherwise(F.col("start_ns")))


_FIRST = ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, start_ns ORDER BY id) AS k FROM chapters) WHERE k = 1)"


@query("chapter_times", oracle("chapters", body=""" SELECT track, id, start_ns, printf('%02d:%02d:%02d.%09d', s // 3600000000000, s // 60000000000 % 60, s // 1000000000 % 60, s % 1000000000) AS text, s AS parsed
FROM (SELECT *, greatest(start_ns + id * 1234567 - 40000000000000000, 0) AS s FROM chapters)"""))
def q_times(spark: SparkSession, sf: str) -> DataFrame:
    moved = chapters(spark, sf).withColumn("s", F.col("start_ns") + F.col("id") * 1_234_567 - 40_000_000_000_000_000)
    text = moved.withColumn("text", format_ns(F.col("s")))
    return text.select("track", "id", "start_ns", "text", parse_ns(F.col("text")).alias("parsed"))


@query("chapter_deltas", oracle("chapters", body=""" SELECT track, id, CASE WHEN abs(d) < 1000 THEN printf('%+dns', d) WHEN abs(d) < 1000000 THEN printf('%+.3fµs', d / 1000.0) ELSE printf('%+.3fms', d / 1000000.0) END AS delta
FROM (SELECT *, CASE id % 3 WHEN 0 THEN id % 1500 - 700 WHEN 1 THEN (id % 1000 - 500) * 1024 ELSE (id - 9000) * 4096000 END AS d FROM chapters)"""))
def q_deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = F.when(F.col("id") % 3 == 0, F.col("id") % 1500 - 700).when(F.col("id") % 3 == 1, (F.col("id") % 1000 - 500) * 1024).otherwise((F.col("id") - 9000) * 4_096_000)
    return chapters(spark, sf).select("track", "id", format_delta(d).alias("delta"))


@query("chapter_list", oracle("chapters", body=_FIRST + """ SELECT track, id, start_ns + 250000000 AS start_ns, coalesce(lead(start_ns) OVER w, start_ns + 1000000000) + 250000000 AS end_ns, printf('Chapter %02d', row_number() OVER w) AS name FROM f WINDOW w AS (PARTITION BY track ORDER BY start_ns, id)"""))
def q_list(spark: SparkSession, sf: str) -> DataFrame:
    return renamed(seamless(shifted(first_of_start(chapters(spark, sf)), 250))).select("track", "id", "start_ns", "end_ns", "name")


@query("chapter_snap", oracle("chapters", "keyframes", body=""", c AS (SELECT track, id, start_ns, max(key_ns) FILTER (key_ns <= start_ns) AS b, min(key_ns) FILTER (key_ns >= start_ns) AS a FROM chapters LEFT JOIN keyframes USING (track) GROUP BY ALL),
n AS (SELECT *, CASE WHEN a IS NULL OR start_ns - b <= a - start_ns THEN b ELSE a END AS near_ns FROM c)
SELECT track, id, start_ns, near_ns, CASE WHEN abs(near_ns - start_ns) <= 259200000000000 THEN near_ns ELSE start_ns END AS snapped_ns FROM n"""))
def q_snap(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(chapters(spark, sf), keyframes(spark, sf), 3 * 86_400 * SECOND)


@query("chapter_audit", oracle("chapters", body=_FIRST + " SELECT track, count(*) AS n_chapters, count(*) FILTER (start_ns - 100000000000000000 < 0) AS n_negative FROM f GROUP BY 1"))
def q_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: chapters of each track, and those that a shift would put before 0."""
    return first_of_start(chapters(spark, sf)).groupBy("track").agg(F.count(F.lit(1)).alias("n_chapters"), F.count_if(F.col("start_ns") - 100_000_000_000_000_000 < 0).alias("n_negative"))
