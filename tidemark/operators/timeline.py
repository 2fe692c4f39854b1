"""Edit lists and the events they move: as-of and overlap joins, segments and their gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.fixtures import edl, oracle, r6, subs
from tidemark.plans.registry import query


def to_target(t: Column, delay_ms: Column) -> Column:
    """Seconds on the target's timeline."""
    return t - delay_ms / 1000.0


def to_reference(t: Column, delay_ms: Column) -> Column:
    """Seconds on the reference's timeline."""
    return t + delay_ms / 1000.0


def as_of(events: DataFrame, segments: DataFrame, key: str, time: str, start: str, value: str, strict: bool = False) -> DataFrame:
    """Events with the value of the last segment of their key that starts at or before their time (strict: before it), 0 before the first.

    Both sides are laid out in one ordered window, so a key's rows are sorted once
    and never multiplied. Segments come before events of the same time, or strictly after; of segments
    of the same time the one with the largest value counts.
    """
    left = events.withColumns({"__t": F.col(time).cast("double"), "__v": F.lit(None).cast("double"), "__event": F.lit(1)})
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != key]
    right = segments.select(F.col(key), *empty, F.col(start).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__event"))
    order = Window.partitionBy(key).orderBy("__t", F.col("__event") * (-1 if strict else 1), "__v").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("offset", F.coalesce(F.last("__v", ignorenulls=True).over(order), F.lit(0.0)))
    return found.where("__event = 1").drop("__t", "__v", "__event")


def numbered(segments: DataFrame, key: str, start: str) -> DataFrame:
    """Segments with k from 1 and end_s, the next one's start; the last one's is unbounded."""
    order = Window.partitionBy(key).orderBy(start, "delay_ms")
    return segments.withColumns({"k": F.row_number().over(order), "end_s": F.coalesce(F.lead(start).over(order), F.lit(float("inf")))})


def majority_offset(events: DataFrame, segments: DataFrame, key: str, event: str, begin: str, end: str) -> DataFrame:
    """(key, event, offset, overlap_s): the offset under which most of an event lies; time before the first segment has offset 0. Ties go to the smallest offset.

    Two as-of steps give the numbers of the first and last segment that an event
    touches, so it is joined to these alone.
    """
    bounded = numbered(segments, key, "start_s").select(key, F.col("k"), "start_s", "end_s", F.col("delay_ms").alias("offset"))
    before = segments.groupBy(key).agg(F.min("start_s").alias("end_s")).select(key, F.lit(0).alias("k"), F.lit(float("-inf")).alias("start_s"), "end_s", F.lit(0).alias("offset"))
    placed = as_of(events, bounded, key, begin, "start_s", "k").withColumnRenamed("offset", "__first")
    placed = as_of(placed, bounded, key, end, "start_s", "k").withColumnRenamed("offset", "__last")
    touched = placed.withColumn("k", F.explode(F.sequence(F.col("__first").cast("int"), F.col("__last").cast("int"))))
    both = touched.join(bounded.unionByName(before), [key, "k"]).where((F.col(begin) < F.col("end_s")) & (F.col(end) > F.col("start_s")))
    parts = both.groupBy(key, event, "offset").agg(F.sum(F.least(F.col(end), F.col("end_s")) - F.greatest(F.col(begin), F.col("start_s"))).alias("overlap_s"))
    best = F.max_by(F.struct("offset", "overlap_s"), F.struct(F.round("overlap_s", 6), -F.col("offset")))
    return parts.groupBy(key, event).agg(best.alias("b")).select(key, event, "b.offset", "b.overlap_s")


def spanning(events: DataFrame, segments: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Events that a segment's start lies strictly inside of; each key's first segment is left out. The last start before an event's end is one as-of step away, so nothing is multiplied."""
    later = numbered(segments, key, "start_s").where("k > 1").select(key, "start_s", F.col("start_s").alias("at"), F.col("k").alias("nth"))
    at = as_of(events, later, key, end, "start_s", "at", strict=True).withColumnRenamed("offset", "__at")
    met = as_of(at, later, key, end, "start_s", "nth", strict=True)  # 0: no segment starts before the end
    return met.where((F.col("offset") > 0) & (F.col("__at") > F.col(begin))).drop("offset", "__at")


def build_edl(splices: DataFrame) -> DataFrame:
    """An anchor row at 0 with the first delay, and the splices after it, numbered in order."""
    first = splices.groupBy("source_key").agg(F.min_by("delay_ms", F.struct("start_s", "delay_ms")).alias("delay_ms")).select("source_key", F.lit(0.0).alias("start_s"), "delay_ms")
    both = first.unionByName(splices.select("source_key", "start_s", "delay_ms"))
    return both.withColumn("segment", F.row_number().over(Window.partitionBy("source_key").orderBy("start_s", "delay_ms")))


def cut_list(segments: DataFrame, insert_over: int = 10) -> DataFrame:
    """What assembling a corrected track does before each segment: insert silence, trim the head, or nothing."""
    order = Window.partitionBy("source_key").orderBy("segment")
    gap = F.col("delay_ms") - F.coalesce(F.lag("delay_ms").over(order), F.col("delay_ms"))
    rows = segments.select("source_key", "segment", "start_s", F.lead("start_s").over(order).alias("end_s"), gap.alias("gap_ms"))
    return rows.withColumn("action", F.when(F.col("gap_ms") > insert_over, "insert").when(F.col("gap_ms") < 0, "trim").otherwise("keep"))


#: The fixture's events in seconds on the scale of the edit lists.
SCALE = 100.0


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return subs(spark, sf).select(F.col("track_id").alias("source_key"), "idx", (F.col("start_ms") * SCALE).alias("t0"), (F.col("end_ms") * SCALE).alias("t1"), "is_comment")


_E = ", ev AS (SELECT track_id AS source_key, idx, start_ms * 100.0::DOUBLE AS t0, end_ms * 100.0::DOUBLE AS t1, is_comment FROM subs)"
_VIEWS = ("windows", "edl", "subs")


@query("edl_offset_as_of", oracle(*_VIEWS, body=_E + """, d AS (SELECT source_key, start_s, max(delay_ms) AS delay_ms FROM edl GROUP BY 1, 2)
SELECT ev.source_key, idx, coalesce(delay_ms, 0)::DOUBLE AS "offset" FROM ev ASOF LEFT JOIN d ON ev.source_key = d.source_key AND ev.t0 >= d.start_s"""))
def q_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return as_of(_events(spark, sf), edl(spark, sf), "source_key", "t0", "start_s", "delay_ms").select("source_key", "idx", "offset")


@query("edl_offset_midpoint", oracle(*_VIEWS, body=_E + """, d AS (SELECT source_key, start_s, max(delay_ms) AS delay_ms FROM edl GROUP BY 1, 2)
SELECT ev.source_key, idx, coalesce(delay_ms, 0)::DOUBLE AS "offset" FROM ev ASOF LEFT JOIN d ON ev.source_key = d.source_key AND (ev.t0 + ev.t1) / 2 >= d.start_s"""))
def q_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    middle = _events(spark, sf).withColumn("tm", (F.col("t0") + F.col("t1")) / 2)
    return as_of(middle, edl(spark, sf), "source_key", "tm", "start_s", "delay_ms").select("source_key", "idx", "offset")


@query("edl_offset_majority", oracle(*_VIEWS, body=_E + """, s AS (SELECT source_key, start_s, coalesce(lead(start_s) OVER (PARTITION BY source_key ORDER BY start_s, delay_ms), 1e300) AS end_s, delay_ms FROM edl
  UNION ALL SELECT source_key, -1e300, min(start_s), 0 FROM edl GROUP BY 1),
p AS (SELECT ev.source_key, idx, delay_ms, sum(least(t1, end_s) - greatest(t0, start_s)) AS o FROM ev JOIN s ON ev.source_key = s.source_key AND t0 < end_s AND t1 > start_s GROUP BY ALL)
SELECT source_key, idx, delay_ms AS "offset", round(o, 4) + 0.0 AS overlap_s FROM (SELECT *, row_number() OVER (PARTITION BY source_key, idx ORDER BY round(o, 6) DESC, delay_ms) AS k FROM p) WHERE k = 1"""))
def q_majority(spark: SparkSession, sf: str) -> DataFrame:
    return majority_offset(_events(spark, sf), edl(spark, sf), "source_key", "idx", "t0", "t1").withColumn("overlap_s", F.round("overlap_s", 4) + F.lit(0.0))


@query("edl_spanning_events", oracle(*_VIEWS, body=_E + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY start_s, delay_ms) AS k FROM edl) WHERE k > 1)
SELECT source_key, idx FROM ev WHERE EXISTS (SELECT 1 FROM l WHERE l.source_key = ev.source_key AND start_s > t0 AND start_s < t1)"""))
def q_spanning(spark: SparkSession, sf: str) -> DataFrame:
    return spanning(_events(spark, sf), edl(spark, sf), "source_key", "t0", "t1").select("source_key", "idx")


@query("edl_applied", oracle(*_VIEWS, body=_E + """, d AS (SELECT source_key, start_s, max(delay_ms) AS delay_ms FROM edl GROUP BY 1, 2)
SELECT ev.source_key, idx, round(t0 + CASE WHEN is_comment THEN 0 ELSE coalesce(delay_ms, 0) END, 4) + 0.0 AS new_start, round(t1 + CASE WHEN is_comment THEN 0 ELSE coalesce(delay_ms, 0) END, 4) + 0.0 AS new_end
FROM ev ASOF LEFT JOIN d ON ev.source_key = d.source_key AND ev.t0 >= d.start_s"""))
def q_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The edit list applied to events; comments stay where they are."""
    moved = as_of(_events(spark, sf), edl(spark, sf), "source_key", "t0", "start_s", "delay_ms")
    by = F.when(F.col("is_comment"), 0.0).otherwise(F.col("offset"))
    return moved.select("source_key", "idx", (F.round(F.col("t0") + by, 4) + F.lit(0.0)).alias("new_start"), (F.round(F.col("t1") + by, 4) + F.lit(0.0)).alias("new_end"))


_BUILD = """, b AS (SELECT source_key, 0.0::DOUBLE AS start_s, arg_min(delay_ms, (start_s, delay_ms)) AS delay_ms FROM edl GROUP BY 1 UNION ALL SELECT source_key, start_s, delay_ms FROM edl),
g AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY start_s, delay_ms) AS segment FROM b)"""


@query("edl_segments", oracle("windows", "edl", body=_BUILD + " SELECT source_key, segment, round(start_s, 6) + 0.0 AS start_s, delay_ms, round(start_s - delay_ms / 1000.0, 6) + 0.0 AS on_target, round(start_s + delay_ms / 1000.0, 6) + 0.0 AS on_reference FROM g"))
def q_segments(spark: SparkSession, sf: str) -> DataFrame:
    built = build_edl(edl(spark, sf))
    return built.select("source_key", F.col("segment").cast("long").alias("segment"), r6(F.col("start_s")).alias("start_s"), "delay_ms", r6(to_target(F.col("start_s"), F.col("delay_ms"))).alias("on_target"), r6(to_reference(F.col("start_s"), F.col("delay_ms"))).alias("on_reference"))


@query("edl_cut_list", oracle("windows", "edl", body=_BUILD + """, c AS (SELECT source_key, segment, start_s, lead(start_s) OVER w AS end_s, delay_ms - coalesce(lag(delay_ms) OVER w, delay_ms) AS gap_ms FROM g WINDOW w AS (PARTITION BY source_key ORDER BY segment))
SELECT source_key, segment, round(start_s, 6) + 0.0 AS start_s, round(end_s, 6) + 0.0 AS end_s, gap_ms, CASE WHEN gap_ms > 10 THEN 'insert' WHEN gap_ms < 0 THEN 'trim' ELSE 'keep' END AS action FROM c"""))
def q_cuts(spark: SparkSession, sf: str) -> DataFrame:
    found = cut_list(build_edl(edl(spark, sf)))
    return found.withColumns({"segment": F.col("segment").cast("long"), "start_s": r6(F.col("start_s")), "end_s": r6(F.col("end_s"))})
