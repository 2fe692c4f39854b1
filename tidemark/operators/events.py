"""Timed text events: clocks, rounding to frames, filters, styles and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.fixtures import oracle, r6, subs
from tidemark.plans.registry import query

FRAME = 1001.0 / 24.0  # ms of a frame at 24000/1001 frames a second
EPSILON = 1e-6


def _clock(unit: Column, per_second: int, pattern: str) -> Column:
    return F.format_string(pattern, F.floor(unit / (3600 * per_second)), F.floor(unit / (60 * per_second)) % 60, F.floor(unit / per_second) % 60, unit % per_second)


def format_centis(ms: Column, rounding: str = "floor") -> Column:
    """H:MM:SS.cc by floor, round or ceil; negative times count as 0."""
    scaled = F.greatest(ms, F.lit(0.0)) / 10
    unit = {"floor": F.floor(scaled), "round": F.round(scaled), "ceil": F.ceil(scaled)}[rounding].cast("long")
    return _clock(unit, 100, "%d:%02d:%02d.%02d")


def parse_centis(text: Column) -> Column:
    """ms of H:MM:SS.cc; the digits after the dot count as hundredths however many there are; null if it is no time."""
    part = F.split(text, "[:.]")
    number = [F.get(part, F.lit(i)).try_cast("long") for i in range(4)]
    return ((number[0] * 3600 + number[1] * 60 + number[2]) * 1000 + number[3] * 10).cast("double")


def format_millis(ms: Column, rounding: str = "round") -> Column:
    """HH:MM:SS,mmm."""
    clipped = F.greatest(ms, F.lit(0.0))
    unit = {"floor": F.floor(clipped), "round": F.round(clipped), "ceil": F.ceil(clipped)}[rounding].cast("long")
    return _clock(unit, 1000, "%02d:%02d:%02d,%03d")


def format_short(seconds: Column) -> Column:
    """M:SS, from an hour on H:MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def frame_floor(ms: Column) -> Column:
    """the frame that is on at a time."""
    return F.floor((ms + EPSILON) / FRAME)


def frame_middle(ms: Column) -> Column:
    """the frame whose middle is nearest."""
    return F.round(ms / FRAME - 0.5).cast("long")


def frame_start_centis(frame: Column) -> Column:
    """a frame's start, up to the next centisecond."""
    return F.ceil(frame * FRAME / 10) * 10


def surgical(ms: Column) -> Column:
    """the centisecond on a time's own frame: down, else up, else the frame's start."""
    down, up = F.floor(ms / 10) * 10, F.ceil(ms / 10) * 10
    own = frame_floor(ms)
    return F.when(frame_floor(down) == own, down).when(frame_floor(up) == own, up).otherwise(frame_start_centis(own)).cast("long")


def on_frame_up(ms: Column) -> Column:
    """Whether the next centisecond up is on a time's own frame."""
    return frame_floor(F.ceil(ms / 10) * 10) == frame_floor(ms)


def surgical_event(start: Column, end: Column) -> dict[str, Column]:
    """both ends of an event on their own frames. Where the start was moved and the end wasn't, the end goes up as well if it stays on its frame and the event so keeps the length that cutting both would give."""
    floor_start, floor_end, up = F.floor(start / 10) * 10, F.floor(end / 10) * 10, (F.ceil(end / 10) * 10).cast("long")
    own_start, own_end = surgical(start), surgical(end)
    coordinated = (own_start != floor_start) & (own_end == floor_end) & on_frame_up(end) & (up - own_start == floor_end - floor_start)
    new_end = F.when(coordinated, up).otherwise(own_end)
    return {"start_cs": own_start, "end_cs": new_end, "start_moved": own_start != floor_start, "end_moved": coordinated | (own_end != floor_end), "coordinated": coordinated, "kept_length": new_end - own_start == floor_end - floor_start}


def rounded_centis(ms: Column, mode: str) -> Column:
    """A time to centiseconds by floor, round or ceil, in ms."""
    return ({"floor": F.floor, "round": F.round, "ceil": F.ceil}[mode](ms / 10) * 10).cast("long")


def minimal_fix(ms: Column, mode: str) -> Column:
    """the ms to add to a rounded time to come back to its own frame: to the frame's first centisecond, else to its last, else to its start."""
    own, rounded = frame_floor(ms), rounded_centis(ms, mode)
    first, last = (F.ceil(own * FRAME / 10) * 10).cast("long"), (F.floor(((own + 1) * FRAME - 0.1) / 10) * 10).cast("long")
    return F.when(frame_floor(rounded) == own, F.lit(0)).when(frame_floor(first) == own, first - rounded).when(frame_floor(last) == own, last - rounded).otherwise((own * FRAME).cast("long") - rounded).cast("long")


def fps_fraction(fps: Column) -> Column:
    """F32: a rate as (num, den): the broadcast rates as multiples of 1000/1001, others in thousandths."""
    near = lambda rate, reach: F.abs(fps - rate) < reach
    num = F.when(near(23.976, 0.001), 24000).when(near(29.97, 0.01), 30000).when(near(59.94, 0.01), 60000).otherwise((fps * 1000).cast("long"))
    den = F.when(near(23.976, 0.001) | near(29.97, 0.01) | near(59.94, 0.01), 1001).otherwise(1000)
    return F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))


def frame_time(frame: Column, rate: Column, method: str = "round") -> Column:
    """F32: whole ms at which a frame of a rate (num, den) starts."""
    exact = frame * 1000.0 / (rate["num"].cast("double") / rate["den"].cast("double"))
    return (F.floor(exact) if method == "floor" else F.round(exact)).cast("long")


def time_frame(ms: Column, rate: Column, method: str = "round") -> Column:
    """F32: the frame of a rate (num, den) at a time in whole ms."""
    exact = ms * (rate["num"].cast("double") / rate["den"].cast("double")) / 1000.0
    return (F.floor(exact) if method == "floor" else F.round(exact)).cast("long")


def issue(start_drift: Column, end_drift: Column) -> Column:
    """which end of an event falls on another frame, and whether on an earlier or a later one."""
    return F.when((start_drift != 0) & (end_drift != 0), "BOTH_DRIFT").when(start_drift < 0, "START_EARLY").when(start_drift > 0, "START_LATE").when(end_drift < 0, "END_EARLY").when(end_drift > 0, "END_LATE").otherwise("OK")


def frame_drift(rows: DataFrame, mode: str = "floor") -> DataFrame:
    """Events that aren't comments with what rounding does to them: their drifts in frames, the change of their length in ms, and what each way of rounding would do to their start."""
    start, end = F.col("start_ms"), F.col("end_ms")
    rounded = rows.where(~F.col("is_comment")).select("*", rounded_centis(start, mode).alias("start_cs"), rounded_centis(end, mode).alias("end_cs"))
    drifts = rounded.select("*", (frame_floor(F.col("start_cs")) - frame_floor(start)).alias("start_drift"), (frame_floor(F.col("end_cs")) - frame_floor(end)).alias("end_drift"), (F.col("end_cs") - F.col("start_cs") - (end - start).cast("long")).alias("length_change"))
    others = [(frame_floor(rounded_centis(start, m)) != frame_floor(start)).alias(f"{m}_off") for m in ("floor", "round", "ceil")]
    return drifts.select("*", *others, issue(F.col("start_drift"), F.col("end_drift")).alias("issue"), minimal_fix(start, mode).alias("start_fix"), minimal_fix(end, mode).alias("end_fix"))


def frame_audit(drifts: DataFrame) -> DataFrame:
    """The counters of each track, its pass rate and the first five events with an issue."""
    change, bad = F.abs("length_change"), F.col("issue") != "OK"
    counted = [F.count_if(F.col(f"{e}_drift").isNotNull() & c(F.col(f"{e}_drift"))).alias(f"{e}_{n}") for e in ("start", "end") for n, c in (("ok", lambda d: d == 0), ("early", lambda d: d < 0), ("late", lambda d: d > 0))]
    return drifts.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), *counted, F.count_if(F.col("start_drift") == F.col("end_drift")).alias("span_ok"), F.count_if(F.col("start_drift") != F.col("end_drift")).alias("span_changed"),
        F.count_if(change == 0).alias("length_kept"), F.count_if(change.between(1, 10)).alias("length_10"), F.count_if(change.between(11, 20)).alias("length_20"), F.count_if(change > 20).alias("length_more"),
        *[F.count_if(f"{m}_off").alias(f"{m}_issues") for m in ("floor", "round", "ceil")],
        (F.count_if(~bad) * 100.0 / F.count(F.lit(1))).alias("pass_rate"), F.slice(F.sort_array(F.collect_list(F.when(bad, F.col("idx")))), 1, 5).alias("first_issues"),
    )


def strip_tags(text: Column) -> Column:
    """Text without override blocks; an unclosed one hides the rest."""
    return F.regexp_replace(text, r"\{[^}]*(\}|$)", "")


def reading_speed(text: Column, ms: Column) -> Column:
    """Characters that aren't white space a second; null without a duration."""
    return F.when(ms > 0, F.length(F.regexp_replace(strip_tags(text), r"\s", "")) / (ms / 1000.0))


def speed_class(cps: Column) -> Column:
    """P29."""
    return F.when(cps <= 15, "good").when(cps <= 25, "fast").otherwise("too fast")


def delayed(rows: DataFrame, ms: Column, snapped: bool = False) -> DataFrame:
    """Events that aren't comments moved by ms, with sync, what was done to them: the times before, the offset and whether it was snapped to frames."""
    sync = F.struct(F.col("start_ms").alias("was_start_ms"), F.col("end_ms").alias("was_end_ms"), ms.cast("double").alias("offset_ms"), F.lit(snapped).alias("snapped"))
    own = ~F.col("is_comment")
    moved = {"start_ms": F.when(own, F.col("start_ms") + ms).otherwise(F.col("start_ms")), "end_ms": F.when(own, F.col("end_ms") + ms).otherwise(F.col("end_ms")), "sync": F.when(own, sync)}
    return rows.withColumns(moved)


def shifted(rows: DataFrame, ms: Column) -> DataFrame:
    """P10: all events moved, none to before 0."""
    return rows.withColumns({c: F.greatest(F.col(c) + ms, F.lit(0.0)) for c in ("start_ms", "end_ms")})


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of events of a track with the same whole times and text the first."""
    order = Window.partitionBy("track_id", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), "text").orderBy("idx")
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def style_filter(rows: DataFrame, styles: list[str], include: bool, forced_in: list[int], forced_out: list[int]) -> DataFrame:
    """Events of the styles, or all others; rows forced in by number, and rows forced out, which wins."""
    own = F.col("style").isin(styles) if include else ~F.col("style").isin(styles)
    return rows.where((own | F.col("idx").isin(forced_in)) & ~F.col("idx").isin(forced_out))


def invalid(rows: DataFrame, styles: DataFrame) -> DataFrame:
    """(track_id, idx, problem): ends before starts, starts before 0, styles that aren't known; Default always is."""
    unknown = rows.where("style <> 'Default'").join(styles.select("style"), "style", "left_anti")
    parts = (rows.where("end_ms <= start_ms"), "end"), (rows.where("start_ms < 0"), "start"), (unknown, "style")
    found = [p.select("track_id", "idx", F.lit(name).alias("problem")) for p, name in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Ms at both ends of a track that checkpoints keep away from.
HEAD_MS, TAIL_MS = 120_000.0, 120_000.0


def checkpoints(rows: DataFrame) -> DataFrame:
    """Three events of each track by time: a sixth, a half and five sixths along the longest 40 percent, three at least, of its safe events; all where there are fewer.

    Safe are events that start outside the head and tail, or in a short track outside
    its first and last third. Where fewer than three are, the middle third of all by
    number is taken; where that is empty, the first, middle and last.
    """
    whole, order = Window.partitionBy("track_id"), Window.partitionBy("track_id").orderBy("idx")
    placed = rows.select("*", (F.row_number().over(order) - 1).alias("__pos"), F.count(F.lit(1)).over(whole).alias("__n"))
    placed = placed.select("*", F.max(F.when(F.col("__pos") == 0, F.col("start_ms"))).over(whole).alias("__from"), F.max(F.when(F.col("__pos") == F.col("__n") - 1, F.col("end_ms"))).over(whole).alias("__to"))
    length = F.col("__to") - F.col("__from")
    short = length < HEAD_MS + TAIL_MS
    lo = F.col("__from") + F.when(short, length / 3).otherwise(HEAD_MS)
    hi = F.col("__to") - F.when(short, length / 3).otherwise(TAIL_MS)
    safe = F.col("start_ms").between(lo, hi)
    third = (F.col("__pos") >= F.floor(F.col("__n") / 3)) & (F.col("__pos") < F.floor(F.col("__n") * 2 / 3))
    marked = placed.select("*", safe.alias("__safe"), third.alias("__third"), F.sum(safe.cast("int")).over(whole).alias("__n_safe"), F.sum(third.cast("int")).over(whole).alias("__n_third"))
    few = F.col("__n_safe") < 3
    last_resort = few & (F.col("__n_third") == 0)
    usable = marked.withColumn("__last_resort", last_resort).where(F.when(~few, F.col("__safe")).when(~last_resort, F.col("__third")).otherwise(F.col("__pos").isin(0) | (F.col("__pos") == F.floor(F.col("__n") / 2)) | (F.col("__pos") == F.col("__n") - 1)))
    long_first = whole.orderBy(F.desc(F.round(F.col("end_ms") - F.col("start_ms"), 6)), "idx")
    ranked = usable.select("*", F.count(F.lit(1)).over(whole).alias("__u"), F.row_number().over(long_first).alias("__r"))
    kept = ranked.where(F.col("__r") <= F.greatest(F.lit(3), F.floor(F.col("__u") * 40 / 100)))
    timed = kept.select("*", (F.row_number().over(whole.orderBy("start_ms", "idx")) - 1).alias("__k"), F.count(F.lit(1)).over(whole).alias("__m"))
    picked = (F.col("__m") < 3) | F.col("__last_resort") | (F.col("__k") == F.floor(F.col("__m") / 6)) | (F.col("__k") == F.floor(F.col("__m") / 2)) | (F.col("__k") == F.floor(F.col("__m") * 5 / 6))
    return timed.where(picked).select(*rows.columns)


_FR = "(1001.0::DOUBLE / 24.0::DOUBLE)"


@query("event_clocks", oracle("subs", body=""", c AS (SELECT track_id, idx, start_ms, floor(start_ms / 10)::BIGINT AS f, round(start_ms / 10)::BIGINT AS r, ceil(start_ms / 10)::BIGINT AS u, round(start_ms)::BIGINT AS m, floor(start_ms)::BIGINT AS s FROM subs)
SELECT track_id, idx, printf('%d:%02d:%02d.%02d', f // 360000, f // 6000 % 60, f // 100 % 60, f % 100) AS ass_floor, printf('%d:%02d:%02d.%02d', r // 360000, r // 6000 % 60, r // 100 % 60, r % 100) AS ass_round,
  printf('%d:%02d:%02d.%02d', u // 360000, u // 6000 % 60, u // 100 % 60, u % 100) AS ass_ceil, (f * 10)::DOUBLE AS ass_back, printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS srt,
  CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS short FROM c"""))
def q_clocks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("start_ms")
    return subs(spark, sf).select("track_id", "idx", format_centis(t).alias("ass_floor"), format_centis(t, "round").alias("ass_round"), format_centis(t, "ceil").alias("ass_ceil"), parse_centis(format_centis(t)).alias("ass_back"), format_millis(t).alias("srt"), format_short(t).alias("short"))


_FRAMES = f""", t AS (SELECT *, floor((start_ms + 1e-6) / {_FR})::BIGINT AS ff FROM subs),
s AS (SELECT *, CASE WHEN floor((floor(start_ms / 10) * 10 + 1e-6) / {_FR}) = ff THEN floor(start_ms / 10) * 10 WHEN floor((ceil(start_ms / 10) * 10 + 1e-6) / {_FR}) = ff THEN ceil(start_ms / 10) * 10 ELSE ceil(ff * {_FR} / 10) * 10 END::BIGINT AS surgical FROM t)"""


@query("event_frames", oracle("subs", body=_FRAMES + f" SELECT track_id, idx, ff AS frame_floor, round(start_ms / {_FR} - 0.5)::BIGINT AS frame_middle, (ceil(ff * {_FR} / 10) * 10)::BIGINT AS frame_start, surgical, floor((surgical + 1e-6) / {_FR})::BIGINT = ff AS on_frame FROM s"))
def q_frames(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("start_ms")
    own = subs(spark, sf).select("track_id", "idx", frame_floor(t).alias("frame_floor"), frame_middle(t).alias("frame_middle"), surgical(t).alias("surgical"))
    return own.select("*", frame_start_centis(F.col("frame_floor")).cast("long").alias("frame_start"), (frame_floor(F.col("surgical")) == F.col("frame_floor")).alias("on_frame"))


_DRIFT = f""", b AS (SELECT *, floor(start_ms / 10)::BIGINT * 10 AS sc, floor(end_ms / 10)::BIGINT * 10 AS ec, floor((start_ms + 1e-6) / {_FR})::BIGINT AS sf, floor((end_ms + 1e-6) / {_FR})::BIGINT AS ef FROM subs WHERE NOT is_comment),
d AS (SELECT *, floor((sc + 1e-6) / {_FR})::BIGINT - sf AS sd, floor((ec + 1e-6) / {_FR})::BIGINT - ef AS ed, ec - sc - trunc(end_ms - start_ms)::BIGINT AS ch,
  floor((round(start_ms / 10) * 10 + 1e-6) / {_FR})::BIGINT <> sf AS ro, floor((ceil(start_ms / 10) * 10 + 1e-6) / {_FR})::BIGINT <> sf AS co FROM b),
i AS (SELECT *, CASE WHEN sd <> 0 AND ed <> 0 THEN 'BOTH_DRIFT' WHEN sd < 0 THEN 'START_EARLY' WHEN sd > 0 THEN 'START_LATE' WHEN ed < 0 THEN 'END_EARLY' WHEN ed > 0 THEN 'END_LATE' ELSE 'OK' END AS issue,
  (ceil(sf * {_FR} / 10) * 10)::BIGINT AS s1, (floor(((sf + 1) * {_FR} - 0.1) / 10) * 10)::BIGINT AS s2 FROM d)"""


@query("event_frame_issues", oracle("subs", body=_DRIFT + f""" SELECT track_id, idx, sd AS start_drift, ed AS end_drift, ch AS length_change, issue,
  CASE WHEN sd = 0 THEN 0 WHEN floor((s1 + 1e-6) / {_FR})::BIGINT = sf THEN s1 - sc WHEN floor((s2 + 1e-6) / {_FR})::BIGINT = sf THEN s2 - sc ELSE trunc(sf * {_FR})::BIGINT - sc END::BIGINT AS start_fix FROM i WHERE issue <> 'OK'"""))
def q_frame_issues(spark: SparkSession, sf: str) -> DataFrame:
    """events that rounding takes off their frames, and the least fix of their start."""
    return frame_drift(subs(spark, sf)).where("issue <> 'OK'").select("track_id", "idx", "start_drift", "end_drift", "length_change", "issue", "start_fix")


@query("event_frame_audit", oracle("subs", body=_DRIFT + """ SELECT track_id, count(*) AS n, count(*) FILTER (sd = 0) AS start_ok, count(*) FILTER (sd < 0) AS start_early, count(*) FILTER (sd > 0) AS start_late, count(*) FILTER (ed = 0) AS end_ok, count(*) FILTER (ed < 0) AS end_early, count(*) FILTER (ed > 0) AS end_late,
  count(*) FILTER (sd = ed) AS span_ok, count(*) FILTER (sd <> ed) AS span_changed, count(*) FILTER (ch = 0) AS length_kept, count(*) FILTER (abs(ch) BETWEEN 1 AND 10) AS length_10, count(*) FILTER (abs(ch) BETWEEN 11 AND 20) AS length_20, count(*) FILTER (abs(ch) > 20) AS length_more,
  count(*) FILTER (sd <> 0) AS floor_issues, count(*) FILTER (ro) AS round_issues, count(*) FILTER (co) AS ceil_issues, round(count(*) FILTER (issue = 'OK') * 100.0 / count(*), 6) + 0.0 AS pass_rate,
  coalesce(array_to_string((list(idx ORDER BY idx) FILTER (issue <> 'OK'))[1:5], ','), '') AS first_issues FROM i GROUP BY 1"""))
def q_frame_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = frame_audit(frame_drift(subs(spark, sf)))
    return found.withColumns({"pass_rate": r6(F.col("pass_rate")), "first_issues": F.array_join(F.col("first_issues").cast("array<string>"), ",")})


_SURGICAL = f""", s0 AS (SELECT *, floor((start_ms + 1e-6) / {_FR}) AS sf, floor((end_ms + 1e-6) / {_FR}) AS ef, floor(start_ms / 10) * 10 AS sl, floor(end_ms / 10) * 10 AS el, ceil(start_ms / 10) * 10 AS su, ceil(end_ms / 10) * 10 AS eu FROM subs WHERE NOT is_comment),
s1 AS (SELECT *, CASE WHEN floor((sl + 1e-6) / {_FR}) = sf THEN sl WHEN floor((su + 1e-6) / {_FR}) = sf THEN su ELSE ceil(sf * {_FR} / 10) * 10 END AS sc, CASE WHEN floor((el + 1e-6) / {_FR}) = ef THEN el WHEN floor((eu + 1e-6) / {_FR}) = ef THEN eu ELSE ceil(ef * {_FR} / 10) * 10 END AS ec FROM s0),
s2 AS (SELECT *, sc <> sl AND ec = el AND floor((eu + 1e-6) / {_FR}) = ef AND eu - sc = el - sl AS co FROM s1), s3 AS (SELECT *, CASE WHEN co THEN eu ELSE ec END AS ne FROM s2)"""


@query("event_surgical", oracle("subs", body=_SURGICAL + " SELECT track_id, idx, sc::BIGINT AS start_cs, ne::BIGINT AS end_cs, co AS coordinated FROM s3"))
def q_surgical(spark: SparkSession, sf: str) -> DataFrame:
    made = surgical_event(F.col("start_ms"), F.col("end_ms"))
    return subs(spark, sf).where(~F.col("is_comment")).select("track_id", "idx", made["start_cs"].alias("start_cs"), made["end_cs"].alias("end_cs"), made["coordinated"].alias("coordinated"))


@query("event_rounding_stats", oracle("subs", body=_SURGICAL + """ SELECT track_id, count(*) AS n, 2 * count(*) AS points, count(*) FILTER (sc <> sl) AS starts, count(*) FILTER (co OR ec <> el) AS ends, count(*) FILTER (co) AS coordinated, count(*) FILTER (ne - sc = el - sl) AS kept, count(*) FILTER (ne - sc <> el - sl) AS changed,
  count(*) FILTER (sc <> sl) + count(*) FILTER (co OR ec <> el) AS different, count(*) FILTER (sc <> sl OR co OR ec <> el) AS events FROM s3 GROUP BY 1"""))
def q_rounding(spark: SparkSession, sf: str) -> DataFrame:
    """What surgical rounding does to each track's events, against cutting."""
    made = surgical_event(F.col("start_ms"), F.col("end_ms"))
    moved = subs(spark, sf).where(~F.col("is_comment")).select("track_id", *[c.alias(n) for n, c in made.items()])
    starts, ends = F.count_if("start_moved"), F.count_if("end_moved")
    return moved.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 2).alias("points"), starts.alias("starts"), ends.alias("ends"), F.count_if("coordinated").alias("coordinated"),
        F.count_if("kept_length").alias("kept"), F.count_if(~F.col("kept_length")).alias("changed"), (starts + ends).alias("different"), F.count_if(F.col("start_moved") | F.col("end_moved")).alias("events"),
    )


@query("event_rates", oracle("subs", body=""", r AS (SELECT *, [23.976, 25.0, 29.97, 59.94, 50.0, 12.345][idx % 6 + 1]::DOUBLE AS fps FROM subs),
f AS (SELECT *, CASE WHEN abs(fps - 23.976) < 0.001 THEN 24000 WHEN abs(fps - 29.97) < 0.01 THEN 30000 WHEN abs(fps - 59.94) < 0.01 THEN 60000 ELSE trunc(fps * 1000)::BIGINT END AS num, CASE WHEN abs(fps - 23.976) < 0.001 OR abs(fps - 29.97) < 0.01 OR abs(fps - 59.94) < 0.01 THEN 1001 ELSE 1000 END AS den FROM r)
SELECT track_id, idx, num::BIGINT AS num, den::BIGINT AS den, round(trunc(start_ms)::BIGINT * (num::DOUBLE / den) / 1000.0)::BIGINT AS frame, floor(trunc(start_ms)::BIGINT * (num::DOUBLE / den) / 1000.0)::BIGINT AS frame_down,
  round(round(trunc(start_ms)::BIGINT * (num::DOUBLE / den) / 1000.0) * 1000.0 / (num::DOUBLE / den))::BIGINT AS back_ms FROM f"""))
def q_rates(spark: SparkSession, sf: str) -> DataFrame:
    """F32: events on the frames of several rates, and back."""
    fps = F.element_at(F.array(*map(F.lit, (23.976, 25.0, 29.97, 59.94, 50.0, 12.345))), (F.col("idx") % 6 + 1).cast("int"))
    rated = subs(spark, sf).select("track_id", "idx", F.col("start_ms").cast("long").alias("ms"), fps_fraction(fps).alias("rate"))
    framed = rated.select("*", time_frame(F.col("ms"), F.col("rate")).alias("frame"), time_frame(F.col("ms"), F.col("rate"), "floor").alias("frame_down"))
    return framed.select("track_id", "idx", "rate.num", "rate.den", "frame", "frame_down", frame_time(F.col("frame"), F.col("rate")).alias("back_ms"))


@query("event_reading_speed", oracle("subs", body=r""", c AS (SELECT track_id, idx, CASE WHEN end_ms > start_ms THEN length(regexp_replace(text, '\s', '', 'g')) / ((end_ms - start_ms) / 1000.0) END AS cps FROM subs)
SELECT track_id, idx, round(cps, 6) + 0.0 AS cps, CASE WHEN cps <= 15 THEN 'good' WHEN cps <= 25 THEN 'fast' ELSE 'too fast' END AS class FROM c"""))
def q_speed(spark: SparkSession, sf: str) -> DataFrame:
    cps = reading_speed(F.col("text"), F.col("end_ms") - F.col("start_ms"))
    return subs(spark, sf).select("track_id", "idx", r6(cps).alias("cps"), speed_class(cps).alias("class"))


@query("event_delay", oracle("subs", body=" SELECT track_id, idx, round(start_ms + CASE WHEN is_comment THEN 0 ELSE -3000 END, 6) + 0.0 AS start_ms, round(end_ms + CASE WHEN is_comment THEN 0 ELSE -3000 END, 6) + 0.0 AS end_ms, CASE WHEN NOT is_comment THEN round(start_ms, 6) + 0.0 END AS was_start_ms, CASE WHEN NOT is_comment THEN -3000.0::DOUBLE END AS offset_ms FROM subs"))
def q_delay(spark: SparkSession, sf: str) -> DataFrame:
    """P09."""
    return delayed(subs(spark, sf), F.lit(-3000)).select("track_id", "idx", r6(F.col("start_ms")).alias("start_ms"), r6(F.col("end_ms")).alias("end_ms"), r6(F.col("sync.was_start_ms")).alias("was_start_ms"), F.col("sync.offset_ms").alias("offset_ms"))


@query("event_shift", oracle("subs", body=" SELECT track_id, idx, round(greatest(start_ms - 3000, 0), 6) + 0.0 AS start_ms, round(greatest(end_ms - 3000, 0), 6) + 0.0 AS end_ms FROM subs"))
def q_shift(spark: SparkSession, sf: str) -> DataFrame:
    """P10."""
    return shifted(subs(spark, sf), F.lit(-3000)).select("track_id", "idx", r6(F.col("start_ms")).alias("start_ms"), r6(F.col("end_ms")).alias("end_ms"))


@query("event_clamped", oracle("subs", body=" SELECT track_id, count(*) FILTER (NOT is_comment AND start_ms < 3000) AS clamped, count(*) FILTER (NOT is_comment AND end_ms <= 3000) AS lost FROM subs GROUP BY 1"))
def q_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Q16: events that a shift of three seconds clamps, and those it loses."""
    own = ~F.col("is_comment")
    return subs(spark, sf).groupBy("track_id").agg(F.count_if(own & (F.col("start_ms") < 3000)).alias("clamped"), F.count_if(own & (F.col("end_ms") <= 3000)).alias("lost"))


@query("event_dedup", oracle("subs", body=", u AS (SELECT * FROM subs UNION ALL SELECT track_id, idx + 1000, start_ms, end_ms, text, style, layer, is_comment FROM subs WHERE idx % 2 = 0) SELECT track_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY track_id, trunc(start_ms), trunc(end_ms), text ORDER BY idx) AS k FROM u) WHERE k = 1"))
def q_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = subs(spark, sf)
    doubled = rows.unionByName(rows.where("idx % 2 = 0").withColumn("idx", F.col("idx") + 1000))
    return first_of_each(doubled).select("track_id", "idx")


@query("event_order", oracle("subs", body=" SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, layer, idx) AS place FROM subs"))
def q_order(spark: SparkSession, sf: str) -> DataFrame:
    """T01."""
    order = Window.partitionBy("track_id").orderBy("start_ms", "layer", "idx")
    return subs(spark, sf).select("track_id", "idx", F.row_number().over(order).cast("long").alias("place"))


@query("event_style_filter", oracle("subs", body=" SELECT track_id, idx FROM subs WHERE (style IN ('user') OR idx IN (1, 3)) AND idx NOT IN (0)"))
def q_style_filter(spark: SparkSession, sf: str) -> DataFrame:
    return style_filter(subs(spark, sf), ["user"], True, [1, 3], [0]).select("track_id", "idx")


@query("event_problems", oracle("subs", body=", m AS (SELECT *, start_ms - 3000 AS s FROM subs) SELECT track_id, idx, 'end' AS problem FROM m WHERE end_ms - 9000 <= s UNION ALL SELECT track_id, idx, 'start' FROM m WHERE s < 0 UNION ALL SELECT track_id, idx, 'style' FROM m WHERE style NOT IN ('user', 'assistant', 'Default')"))
def q_problems(spark: SparkSession, sf: str) -> DataFrame:
    rows = subs(spark, sf).withColumns({"start_ms": F.col("start_ms") - 3000, "end_ms": F.col("end_ms") - 9000})
    known = spark.createDataFrame([("user",), ("assistant",)], "style string")
    return invalid(rows, known)


@query("event_style_counts", oracle("subs", body=" SELECT track_id, style, count(*) AS n, round(min(start_ms), 6) + 0.0 AS first_ms, round(max(end_ms), 6) + 0.0 AS last_ms FROM subs GROUP BY 1, 2"))
def q_style_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A24."""
    return subs(spark, sf).groupBy("track_id", "style").agg(F.count(F.lit(1)).alias("n"), r6(F.min("start_ms")).alias("first_ms"), r6(F.max("end_ms")).alias("last_ms"))


@query("event_checkpoints", oracle("subs", body=""", long AS (SELECT track_id, idx, start_ms * 25 AS start_ms, end_ms * 25 AS end_ms FROM subs),
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY track_id) AS n, first(start_ms) OVER w AS f, last(end_ms) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM long WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
q AS (SELECT *, start_ms BETWEEN f + CASE WHEN t - f < 240000 THEN (t - f) / 3 ELSE 120000 END AND t - CASE WHEN t - f < 240000 THEN (t - f) / 3 ELSE 120000 END AS safe, pos >= n // 3 AND pos < 2 * n // 3 AS third FROM p),
c AS (SELECT *, sum(safe::INT) OVER (PARTITION BY track_id) AS ns, sum(third::INT) OVER (PARTITION BY track_id) AS nt FROM q),
u AS (SELECT *, ns < 3 AND nt = 0 AS resort FROM c WHERE CASE WHEN ns >= 3 THEN safe WHEN nt > 0 THEN third ELSE pos IN (0, n // 2, n - 1) END),
r AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS un, row_number() OVER (PARTITION BY track_id ORDER BY round(end_ms - start_ms, 6) DESC, idx) AS r FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, idx) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS m FROM r WHERE r <= greatest(3, un * 40 // 100))
SELECT track_id, idx FROM k WHERE m < 3 OR resort OR k IN (m // 6, m // 2, 5 * m // 6)"""))
def q_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's times are stretched, so that some tracks are long enough for their head and tail."""
    rows = subs(spark, sf).withColumns({"start_ms": F.col("start_ms") * 25, "end_ms": F.col("end_ms") * 25})
    return checkpoints(rows).select("track_id", "idx")


@query("style_sets", oracle("subs", body=", w AS (SELECT unnest(['user', 'system', 'narrator']) AS style), h AS (SELECT DISTINCT track_id, style FROM subs), t AS (SELECT DISTINCT track_id FROM subs) SELECT track_id, w.style, h.style IS NOT NULL AS found FROM t CROSS JOIN w LEFT JOIN h USING (track_id, style)"))
def q_style_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the wanted styles a track has."""
    have = subs(spark, sf).select("track_id", "style").distinct().withColumn("found", F.lit(True))
    wanted = have.select("track_id").distinct().select("track_id", F.explode(F.array(*map(F.lit, ("user", "system", "narrator")))).alias("style"))
    return wanted.join(have, ["track_id", "style"], "left").select("track_id", "style", F.coalesce("found", F.lit(False)).alias("found"))


_STYLES = ", st AS (SELECT DISTINCT track_id, style, length(style) * 4.0 AS size, 'Arial' AS font FROM subs), pa AS (SELECT 'user' AS style, 31.5 AS p_size, NULL AS p_font UNION ALL SELECT 'system', NULL, 'Serif')"


def styles(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's styles: (track_id, style, size, font)."""
    return subs(spark, sf).select("track_id", "style").distinct().select("track_id", "style", (F.length("style") * 4.0).alias("size"), F.lit("Arial").alias("font"))


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Styles overlaid by patches(style, p_size, p_font), nulls leaving what is there."""
    return rows.join(patches, "style", "left").withColumns({"size": F.coalesce("p_size", "size"), "font": F.coalesce("p_font", "font")}).drop("p_size", "p_font")


def scaled(rows: DataFrame, factor: float) -> DataFrame:
    """Sizes multiplied; factors within 1e-6 of 1 change nothing, those outside 0.1 to 10 are refused."""
    if not 0.1 <= factor <= 10:
        raise ValueError("factor outside 0.1 to 10")
    return rows if abs(factor - 1) < 1e-6 else rows.withColumn("size", F.col("size") * factor)


@query("style_patches", oracle("subs", body=_STYLES + " SELECT track_id, style, round(coalesce(p_size, size) * 1.25, 6)::DOUBLE AS size, coalesce(p_font, font) AS font FROM st LEFT JOIN pa USING (style)"))
def q_patches(spark: SparkSession, sf: str) -> DataFrame:
    patches = spark.createDataFrame([("user", 31.5, None), ("system", None, "Serif")], "style string, p_size double, p_font string")
    return scaled(patched(styles(spark, sf), patches), 1.25).withColumn("size", r6(F.col("size")))


@query("style_signature", oracle("subs", body=_STYLES + " SELECT track_id, sha256(string_agg(style || ',' || font || ',' || printf('%.1f', size), '|' ORDER BY style || ',' || font || ',' || printf('%.1f', size))) AS signature FROM st GROUP BY 1"))
def q_signature(spark: SparkSession, sf: str) -> DataFrame:
    """F42."""
    line = F.concat_ws(",", "style", "font", F.format_string("%.1f", "size"))
    return styles(spark, sf).groupBy("track_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("signature"))
