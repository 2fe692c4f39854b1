"""Changes of subtitle documents: edit plans, style patches, rescaling, ways of synchronising, and the whole chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import hex_to_colour, scaled_tags
from tidemark.operators.events import delayed, format_centis, patched, scaled, shifted, style_filter, styles
from tidemark.operators.timeline import as_of
from tidemark.plans.fixtures import oracle, r6, subs
from tidemark.plans.registry import query
from tidemark.session import table


def dialogue(rows: DataFrame) -> DataFrame:
    """Events that aren't comments."""
    return rows.where(~F.col("is_comment"))


def without(rows: DataFrame, removed: DataFrame, on: list[str]) -> DataFrame:
    """Events without those that a table of styles or of numbers names."""
    return rows.join(removed.select(*on).distinct(), on, "left_anti")


@dataclass(frozen=True)
class EditPlan:
    """Tables of an edit plan, each of which may be missing: events and styles to delete (track_id, idx; track_id, style), styles to add (track_id, style, size, font), attributes to change (track_id, style, new_size, new_font), events to change (track_id, idx, new_text, new_style, new_start_ms, new_end_ms, new_group; nulls leave what is), events to insert behind a number (track_id, after_idx, start_ms, end_ms, text, style), and an offset for all in ms."""

    delete_events: DataFrame | None = None
    delete_styles: DataFrame | None = None
    add_styles: DataFrame | None = None
    edit_styles: DataFrame | None = None
    edit_events: DataFrame | None = None
    insert_events: DataFrame | None = None
    offset_ms: float = 0.0


def apply_plan(events: DataFrame, own_styles: DataFrame, plan: EditPlan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events and styles after the stages of a plan in their fixed order, and (track_id, stage, n) of what each changed.

    Deleting a style leaves its events. An inserted event lies between the one it
    follows and the next; events are numbered anew in the end.
    """
    changes = []

    def counted(stage: str, rows: DataFrame) -> None:
        changes.append(rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).select("track_id", F.lit(stage).alias("stage"), "n"))

    rows = events.withColumns({"order": F.col("idx").cast("double"), "group": F.lit(None).cast("string")})
    if plan.delete_events is not None:
        counted("delete events", rows.join(plan.delete_events, ["track_id", "idx"], "left_semi"))
        rows = without(rows, plan.delete_events, ["track_id", "idx"])
    if plan.delete_styles is not None:
        counted("delete styles", own_styles.join(plan.delete_styles, ["track_id", "style"], "left_semi"))
        own_styles = without(own_styles, plan.delete_styles, ["track_id", "style"])
    if plan.add_styles is not None:
        new = plan.add_styles.join(own_styles, ["track_id", "style"], "left_anti")
        counted("add styles", new)
        own_styles = own_styles.unionByName(new)
    if plan.edit_styles is not None:
        counted("edit styles", own_styles.join(plan.edit_styles, ["track_id", "style"], "left_semi"))
        own_styles = own_styles.join(plan.edit_styles, ["track_id", "style"], "left").withColumns({"size": F.coalesce("new_size", "size"), "font": F.coalesce("new_font", "font")}).drop("new_size", "new_font")
    if plan.edit_events is not None:
        counted("edit events", rows.join(plan.edit_events, ["track_id", "idx"], "left_semi"))
        fields = ("text", "style", "start_ms", "end_ms", "group")
        rows = rows.join(plan.edit_events, ["track_id", "idx"], "left").withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*[f"new_{f}" for f in fields])
    if plan.insert_events is not None:
        counted("insert events", plan.insert_events)
        new = plan.insert_events.select("track_id", F.lit(None).cast("long").alias("idx"), "start_ms", "end_ms", "text", "style", F.lit(0).alias("layer"), F.lit(False).alias("is_comment"), (F.col("after_idx") + 0.5).alias("order"), F.lit(None).cast("string").alias("group"))
        rows = rows.unionByName(new)
    if plan.offset_ms:
        counted("offset", rows)
        rows = shifted(rows, F.lit(float(plan.offset_ms)))
    order = Window.partitionBy("track_id").orderBy("order", "start_ms", "text")
    rows = rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).drop("order")
    total = changes[0] if changes else None
    for more in changes[1:]:
        total = total.unionByName(more)
    if total is None:
        total = events.select("track_id", F.lit("").alias("stage"), F.lit(0).cast("long").alias("n")).limit(0)
    return rows, own_styles, total


#: Other names of style attributes, and those that are colours or switches.
ALIASES = {
    "font": "fontname", "font_name": "fontname", "size": "fontsize", "font_size": "fontsize", "primarycolor": "primary_color", "secondarycolor": "secondary_color", "outlinecolor": "outline_color", "backcolor": "back_color",
    "color": "primary_color", "colour": "primary_color", "primary": "primary_color", "secondary": "secondary_color",
}
COLOURS, SWITCHES = ("primary_color", "secondary_color", "outline_color", "back_color"), ("bold", "italic", "underline", "strike_out")


def attribute_name(name: Column) -> Column:
    """An attribute's own name, whichever way it was written."""
    key = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), key), key)


def attribute_value(name: Column, value: Column) -> Column:
    """An attribute's value as a style line has it: colours of the # form turned, switches as -1 and 0, others as they are."""
    return F.when(name.isin(*COLOURS) & value.startswith("#"), hex_to_colour(value)).when(name.isin(*SWITCHES), F.when(F.lower(value) == "true", "-1").when(F.lower(value) == "false", "0").otherwise(value)).otherwise(value)


def merged_styles(own: DataFrame, template: DataFrame) -> DataFrame:
    """Styles (track_id, style, size, font) overlaid by a template's (style, size, font) of the same name; those that only the template has are added to every track."""
    tracks = own.select("track_id").distinct().crossJoin(template.select("style", F.col("size").alias("t_size"), F.col("font").alias("t_font")))  # a template is a stated list
    return own.join(tracks, ["track_id", "style"], "full_outer").select("track_id", "style", F.coalesce("t_size", "size").alias("size"), F.coalesce("t_font", "font").alias("font"))


@dataclass(frozen=True)
class Scale:
    """What fits a picture of one size into another: an even factor, the height's for letters, and the borders that are left."""

    even: float
    height: float
    border_x: float
    border_y: float

    @classmethod
    def between(cls, old: tuple[int, int], new: tuple[int, int]) -> Scale | None:
        """None if nothing is to be done: the sizes are the same, or the old one isn't known."""
        if 0 in old or old == new:
            return None
        x, y = new[0] / old[0], new[1] / old[1]
        even = min(x, y)
        return cls(even, y, (new[0] - int(old[0] * even + 0.5)) / 2, (new[1] - int(old[1] * even + 0.5)) / 2)


def rescaled_styles(rows: DataFrame, scale: Scale) -> DataFrame:
    """styles(size, outline, shadow, margin): sizes by the height and cut after adding a half, outlines and shadows by the height, margins evenly."""
    return rows.withColumns({"size": (F.col("size") * scale.height + 0.5).cast("long").cast("double"), "outline": F.col("outline") * scale.height, "shadow": F.col("shadow") * scale.height, "margin": (F.col("margin") * scale.even + 0.5).cast("int")})


def rescaled_events(rows: DataFrame, scale: Scale) -> DataFrame:
    """Events with their margins, unless 0, and the tags in their text scaled."""
    margin = F.when(F.col("margin") != 0, (F.col("margin") * scale.even + 0.5).cast("int")).otherwise(0)
    return rows.withColumns({"margin": margin, "text": F.when(F.col("text").contains("{"), scaled_tags(F.col("text"), scale.even, scale.height, (scale.border_x, scale.border_y))).otherwise(F.col("text"))})


#: Ways of synchronising by name: events, their delay column and whether raw values are wanted to events.
SyncMode = Callable[[DataFrame, Column, bool], DataFrame]
SYNC_MODES: dict[str, SyncMode] = {}


def sync_mode(name: str) -> Callable[[SyncMode], SyncMode]:
    """Register a way of synchronising."""

    def add(function: SyncMode) -> SyncMode:
        SYNC_MODES[name] = function
        return function

    return add


@sync_mode("time-based")
def time_based(rows: DataFrame, delay_ms: Column, raw: bool) -> DataFrame:
    """Events moved by the delay where raw values are wanted; otherwise left to the muxer."""
    return delayed(rows, delay_ms) if raw else rows.withColumn("sync", F.lit(None).cast("struct<was_start_ms: double, was_end_ms: double, offset_ms: double, snapped: boolean>"))


@sync_mode("video-verified")
def video_verified(rows: DataFrame, delay_ms: Column, raw: bool) -> DataFrame:
    """Events moved by a delay that was verified on frames."""
    return delayed(rows, delay_ms, snapped=True)


def synchronise(rows: DataFrame, mode: str, cached_ms: Column, subtitle_ms: Column, source_ms: Column, raw: bool = False) -> DataFrame:
    """Events by a way of synchronising: video-verified ones by the cached delay of their source, else, as all others, by the subtitles' own delay, else by the source's, else by none."""
    if mode not in SYNC_MODES:
        raise ValueError(f"sync mode {mode} is not known")
    total = F.coalesce(subtitle_ms, source_ms, F.lit(0.0))
    return SYNC_MODES[mode](rows, F.coalesce(cached_ms, total) if mode == "video-verified" else total, raw)


# video properties

OLD_CODECS = ("mpeg2video", "mpeg1video")


def content_type(codec: Column, interlaced: Column, vfr: Column, order: Column, mode: Column, scan: Column, scan_order: Column, dvd: Column) -> Column:
    """(type, confidence) of a video: other codecs by their flag; the old ones by what the media report tells of rate and scan (mode null: no report), else by the probe's flags, with little confidence."""
    old, told = codec.isin(*OLD_CODECS), mode.isNotNull()
    varies, pulled, lines = F.upper(mode) == "VFR", F.lower(scan_order).contains("pulldown"), F.lower(scan) == "interlaced"

    def answer(kind: str, confidence: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    return (
        F.when(~old & interlaced, answer("interlaced", "medium"))
        .when(~old, answer("progressive", "high"))
        .when(told & varies & pulled, answer("soft_telecine", F.when(vfr | (order == "progressive"), "high").otherwise("medium")))
        .when(told & varies, answer("soft_telecine", "medium"))
        .when(told & lines, answer("interlaced", F.when(interlaced, "high").otherwise("medium")))
        .when(told, answer("progressive", "medium"))
        .when(vfr, answer("soft_telecine", "low"))
        .when(interlaced & dvd, answer("interlaced", "low"))
        .when(interlaced, answer("interlaced", "low"))
        .otherwise(answer("unknown", "low"))
    )


def keeps_delay(codec: Column, kind: Column) -> Column:
    """Why a source's delay is kept without matching frames: MPEG-2, interlaced, or null if frames are matched."""
    return F.when(codec.isin(*OLD_CODECS), "MPEG-2").when(kind == "interlaced", "interlaced")


def pair_strategy(fps_a: Column, fps_b: Column, type_a: Column, type_b: Column) -> Column:
    """(strategy, fps_match, ratio, scale) of comparing two clips."""
    ratio = F.coalesce(F.try_divide(fps_a, fps_b), F.lit(1.0))
    match = F.coalesce(F.try_divide(F.abs(fps_a - fps_b) * 100, fps_b), F.lit(0.0)) < 0.1
    scaling = ((ratio > 1.04) & (ratio < 1.05)) | ((ratio > 0) & (1 / ratio > 0.95) & (1 / ratio < 0.96))
    crossing = ((F.abs(fps_a - 29.97) < 0.1) & (F.abs(fps_b - 23.976) < 0.1)) | ((F.abs(fps_b - 29.97) < 0.1) & (F.abs(fps_a - 23.976) < 0.1))
    start = F.when(scaling, "scale").otherwise("frame-based")
    alike, telecine = type_a == type_b, (type_a == "soft_telecine") | (type_b == "soft_telecine")
    strategy = (
        F.when(alike & type_a.isin("progressive", "interlaced"), F.when(match, "frame-based").otherwise(start))
        .when(~alike & ~scaling, F.when(crossing, "cross-fps").otherwise("timestamp-based"))
        .when(telecine, "timestamp-based")
        .otherwise(start)
    )
    return F.struct(strategy.alias("strategy"), match.alias("fps_match"), ratio.alias("ratio"), F.when(scaling, fps_b / fps_a).otherwise(1.0).alias("scale"))


_ST = ", st AS (SELECT DISTINCT track_id, style, length(style) * 4.0 AS size, 'Arial' AS font FROM subs)"
_PLAN = _ST + """, e0 AS (SELECT *, idx::DOUBLE AS ord FROM subs WHERE idx <> 1),
e1 AS (SELECT track_id, CASE WHEN idx = 2 THEN text || '!' ELSE text END AS text, CASE WHEN style = 'user' THEN 'Main' ELSE style END AS style, start_ms, CASE WHEN idx = 2 THEN 'late' END AS grp, ord FROM e0
  UNION ALL SELECT DISTINCT track_id, 'inserted', 'Main', 10.0, NULL, 0.5 FROM subs),
e2 AS (SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY ord, start_ms, text) - 1)::BIGINT AS idx, round(greatest(start_ms + 120, 0), 6) + 0.0 AS start_ms, text, style, grp FROM e1)"""


def _plan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = subs(spark, sf)
    none = F.lit(None)
    edit = (F.col("idx") == 2) | (F.col("style") == "user")
    plan = EditPlan(
        delete_events=rows.where("idx = 1").select("track_id", "idx"),
        delete_styles=rows.where("style = 'system'").select("track_id", "style").distinct(),
        add_styles=rows.select("track_id").distinct().select("track_id", F.lit("Main").alias("style"), F.lit(30.0).alias("size"), F.lit("Serif").alias("font")),
        edit_styles=rows.select("track_id").distinct().select("track_id", F.lit("user").alias("style"), F.lit(31.5).alias("new_size"), none.cast("string").alias("new_font")),
        edit_events=rows.where("idx <> 1").where(edit).select("track_id", "idx", F.when(F.col("idx") == 2, F.concat("text", F.lit("!"))).alias("new_text"), F.when(F.col("style") == "user", "Main").alias("new_style"), none.cast("double").alias("new_start_ms"), none.cast("double").alias("new_end_ms"), F.when(F.col("idx") == 2, "late").alias("new_group")),
        insert_events=rows.select("track_id").distinct().select("track_id", F.lit(0).alias("after_idx"), F.lit(10.0).alias("start_ms"), F.lit(20.0).alias("end_ms"), F.lit("inserted").alias("text"), F.lit("Main").alias("style")),
        offset_ms=120.0,
    )
    return apply_plan(rows, styles(spark, sf), plan)


@query("edit_plan", oracle("subs", body=_PLAN + " SELECT track_id, idx, start_ms, md5(text) AS text_md5, style, grp FROM e2"))
def q_plan(spark: SparkSession, sf: str) -> DataFrame:
    """All stages over every track."""
    return _plan(spark, sf)[0].select("track_id", "idx", r6(F.col("start_ms")).alias("start_ms"), F.md5("text").alias("text_md5"), "style", F.col("group").alias("grp"))


@query("edit_plan_styles", oracle("subs", body=_ST + " SELECT track_id, style, CASE WHEN style = 'user' THEN 31.5 ELSE size END::DOUBLE AS size, font FROM st WHERE style <> 'system' UNION ALL SELECT DISTINCT track_id, 'Main', 30.0, 'Serif' FROM subs"))
def q_plan_styles(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)[1].select("track_id", "style", "size", "font")


@query("edit_plan_changes", oracle("subs", body=_ST + """, n AS (SELECT track_id, 'delete events' AS stage, count(*) AS n FROM subs WHERE idx = 1 GROUP BY 1 UNION ALL SELECT track_id, 'delete styles', count(*) FROM st WHERE style = 'system' GROUP BY 1 UNION ALL SELECT DISTINCT track_id, 'add styles', 1 FROM subs
  UNION ALL SELECT track_id, 'edit styles', count(*) FROM st WHERE style = 'user' GROUP BY 1 UNION ALL SELECT track_id, 'edit events', count(*) FROM subs WHERE idx <> 1 AND (idx = 2 OR style = 'user') GROUP BY 1 UNION ALL SELECT DISTINCT track_id, 'insert events', 1 FROM subs
  UNION ALL SELECT track_id, 'offset', count(*) FILTER (idx <> 1) + 1 FROM subs GROUP BY 1) SELECT track_id, sum(n)::BIGINT AS total, count(*) AS stages FROM n GROUP BY 1"""))
def q_plan_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the plan changes in each track, over all stages."""
    return _plan(spark, sf)[2].groupBy("track_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("stages"))


@query("event_removals", oracle("subs", body=" SELECT track_id, idx FROM subs WHERE NOT is_comment AND style <> 'assistant' AND NOT (idx % 3 = 1)"))
def q_removals(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogue without a style and without some events by number."""
    rows = subs(spark, sf)
    left = without(dialogue(rows), rows.where("style = 'assistant'"), ["track_id", "style"])
    return without(left, rows.where("idx % 3 = 1"), ["track_id", "idx"]).select("track_id", "idx")


@query("style_attributes", oracle("subs", body=""", a AS (SELECT track_id, idx, ['Font-Name', 'size', 'COLOR', 'Bold', 'italic', 'Spacing'][idx % 6 + 1] AS name, ['Arial', '20', '#80FF0102', 'TRUE', 'false', 'x'][idx % 6 + 1] AS value FROM subs)
SELECT track_id, idx, ['fontname', 'fontsize', 'primary_color', 'bold', 'italic', 'spacing'][idx % 6 + 1] AS name, ['Arial', '20', '&H7F0201FF', '-1', '0', 'x'][idx % 6 + 1] AS value FROM a"""))
def q_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """P36."""
    at = (F.col("idx") % 6 + 1).cast("int")
    name = attribute_name(F.element_at(F.array(*map(F.lit, ("Font-Name", "size", "COLOR", "Bold", "italic", "Spacing"))), at))
    value = F.element_at(F.array(*map(F.lit, ("Arial", "20", "#80FF0102", "TRUE", "false", "x"))), at)
    return subs(spark, sf).select("track_id", "idx", name.alias("name"), attribute_value(name, value).alias("value"))


@query("style_template", oracle("subs", body=_ST + ", te AS (SELECT unnest(['user', 'narrator']) AS style, unnest([28.0, 22.0]) AS t_size, unnest(['Serif', 'Mono']) AS t_font), x AS (SELECT DISTINCT track_id, te.* FROM subs, te) SELECT coalesce(st.track_id, x.track_id) AS track_id, coalesce(st.style, x.style) AS style, coalesce(t_size, size)::DOUBLE AS size, coalesce(t_font, font) AS font FROM st FULL JOIN x ON st.track_id = x.track_id AND st.style = x.style"))
def q_template(spark: SparkSession, sf: str) -> DataFrame:
    template = spark.createDataFrame([("user", 28.0, "Serif"), ("narrator", 22.0, "Mono")], "style string, size double, font string")
    return merged_styles(styles(spark, sf).withColumn("size", F.col("size").cast("double")), template)


@query("style_rescale", oracle("subs", body=_ST + " SELECT track_id, style, trunc(size * (800.0 / 480) + 0.5)::DOUBLE AS size, round(size / 8 * (800.0 / 480), 6)::DOUBLE AS outline, round(size / 16 * (800.0 / 480), 6)::DOUBLE AS shadow, trunc(length(style) * (800.0 / 480) + 0.5)::INT AS margin FROM st"))
def q_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """From 640 x 480 to 1280 x 800: even scale by the height, borders at the sides."""
    sized = styles(spark, sf).withColumns({"size": F.col("size").cast("double"), "outline": F.col("size") / 8, "shadow": F.col("size") / 16, "margin": F.length("style")})
    found = rescaled_styles(sized, Scale.between((640, 480), (1280, 800)))
    return found.select("track_id", "style", "size", r6(F.col("outline")).alias("outline"), r6(F.col("shadow")).alias("shadow"), "margin")


@query("event_rescale", oracle("subs", body=r" SELECT track_id, idx, CASE WHEN idx = 0 THEN 0 ELSE idx * 2 END::INT AS margin, '{\pos(' || idx * 2 || ',' || (idx * 2 + 60) || ')\fs' || idx * 3 || '}x' AS text FROM subs"))
def q_event_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """From 640 x 360 to 1280 x 1080 at twice, with three times as high letters; 840 lines used."""
    n = F.col("idx").cast("string")
    rows = subs(spark, sf).select("track_id", "idx", F.col("idx").cast("int").alias("margin"), F.concat(F.lit("{\\pos("), n, F.lit(","), n, F.lit(")\\fs"), n, F.lit("}x")).alias("text"))
    return rescaled_events(rows, Scale(2.0, 3.0, 0.0, 60.0)).select("track_id", "idx", "margin", "text")


@query("event_sync", oracle("subs", body=""", d AS (SELECT *, CASE WHEN track_id % 3 = 0 THEN 111.5 END AS cached, CASE WHEN track_id % 3 = 1 THEN 222.25 END AS own, CASE WHEN track_id % 4 > 0 THEN -50.0 END AS src FROM subs)
SELECT track_id, idx, round(start_ms + CASE WHEN is_comment THEN 0 ELSE coalesce(cached, own, src, 0) END, 6) + 0.0 AS verified_ms, round(start_ms + CASE WHEN is_comment THEN 0 ELSE coalesce(own, src, 0) END, 6) + 0.0 AS raw_ms, round(start_ms, 6) + 0.0 AS muxed_ms FROM d"""))
def q_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The same events by each way."""
    track = F.col("track_id")
    delays = (F.when(track % 3 == 0, 111.5), F.when(track % 3 == 1, 222.25), F.when(track % 4 > 0, -50.0))
    rows, out = subs(spark, sf), None
    for name, mode, raw in (("verified_ms", "video-verified", False), ("raw_ms", "time-based", True), ("muxed_ms", "time-based", False)):
        made = synchronise(rows, mode, *delays, raw=raw).select("track_id", "idx", r6(F.col("start_ms")).alias(name))
        out = made if out is None else out.join(made, ["track_id", "idx"])
    return out


@query("video_types", """WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'mpeg2video' WHEN 1 THEN 'h264' ELSE 'mpeg1video' END AS codec, p_partkey % 2 = 0 AS il, p_partkey % 5 = 0 AS vfr, CASE WHEN p_size % 2 = 0 THEN 'progressive' ELSE 'tt' END AS ord, CASE p_size % 4 WHEN 0 THEN 'VFR' WHEN 1 THEN 'cfr' WHEN 2 THEN 'vfr' END AS md, CASE WHEN p_size % 3 = 0 THEN 'Interlaced' ELSE 'Progressive' END AS sc, CASE WHEN p_size % 5 < 3 THEN '2:3 Pulldown' ELSE 'TFF' END AS so FROM part),
t AS (SELECT *, CASE WHEN codec = 'h264' THEN CASE WHEN il THEN 'interlaced/medium' ELSE 'progressive/high' END WHEN upper(md) = 'VFR' THEN CASE WHEN contains(so, 'Pulldown') AND (vfr OR ord = 'progressive') THEN 'soft_telecine/high' ELSE 'soft_telecine/medium' END
  WHEN md IS NOT NULL AND sc = 'Interlaced' THEN CASE WHEN il THEN 'interlaced/high' ELSE 'interlaced/medium' END WHEN md IS NOT NULL THEN 'progressive/medium' WHEN vfr THEN 'soft_telecine/low' WHEN il THEN 'interlaced/low' ELSE 'unknown/low' END AS kind FROM p)
SELECT id, kind, CASE WHEN codec <> 'h264' THEN 'MPEG-2' WHEN starts_with(kind, 'interlaced') THEN 'interlaced' END AS keeps FROM t""")
def q_types(spark: SparkSession, sf: str) -> DataFrame:
    """P31, W16."""
    key, size = F.col("p_partkey"), F.col("p_size")
    codec = F.when(key % 3 == 0, "mpeg2video").when(key % 3 == 1, "h264").otherwise("mpeg1video")
    kind = content_type(codec, key % 2 == 0, key % 5 == 0, F.when(size % 2 == 0, "progressive").otherwise("tt"), F.when(size % 4 == 0, "VFR").when(size % 4 == 1, "cfr").when(size % 4 == 2, "vfr"), F.when(size % 3 == 0, "Interlaced").otherwise("Progressive"), F.when(size % 5 < 3, "2:3 Pulldown").otherwise("TFF"), F.lit(True))
    return table(spark, sf, "part").select(key.alias("id"), codec.alias("codec"), kind.alias("k")).select("id", F.concat_ws("/", "k.type", "k.confidence").alias("kind"), keeps_delay(F.col("codec"), F.col("k.type")).alias("keeps"))


_FPS = "CASE p_partkey % 4 WHEN 0 THEN 23.976 WHEN 1 THEN 25.0 WHEN 2 THEN 29.97 ELSE 23.98 END"
_FPS_B = "CASE p_size % 3 WHEN 0 THEN 23.976 WHEN 1 THEN 25.0 ELSE 29.97 END"
_TYPE = "CASE p_partkey % 3 WHEN 0 THEN 'progressive' WHEN 1 THEN 'interlaced' ELSE 'soft_telecine' END"
_TYPE_B = "CASE p_size % 5 WHEN 0 THEN 'interlaced' WHEN 1 THEN 'soft_telecine' ELSE 'progressive' END"


@query("video_pairs", f"""WITH p AS (SELECT p_partkey AS id, ({_FPS})::DOUBLE AS fa, ({_FPS_B})::DOUBLE AS fb, {_TYPE} AS ta, {_TYPE_B} AS tb FROM part), r AS (SELECT *, fa / fb AS ratio, abs(fa - fb) / fb * 100 < 0.1 AS m FROM p), s AS (SELECT *, (ratio > 1.04 AND ratio < 1.05) OR (1 / ratio > 0.95 AND 1 / ratio < 0.96) AS sc FROM r)
SELECT id, CASE WHEN ta = tb AND ta <> 'soft_telecine' THEN CASE WHEN m OR NOT sc THEN 'frame-based' ELSE 'scale' END WHEN ta <> tb AND NOT sc THEN CASE WHEN (abs(fa - 29.97) < 0.1 AND abs(fb - 23.976) < 0.1) OR (abs(fb - 29.97) < 0.1 AND abs(fa - 23.976) < 0.1) THEN 'cross-fps' ELSE 'timestamp-based' END
  WHEN ta = 'soft_telecine' OR tb = 'soft_telecine' THEN 'timestamp-based' WHEN sc THEN 'scale' ELSE 'frame-based' END AS strategy, m AS fps_match, round(ratio, 6) AS ratio, round(CASE WHEN sc THEN fb / fa ELSE 1 END, 6) AS scale FROM s""")
def q_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """P30."""
    number = lambda e: F.expr(e).cast("double")
    made = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), pair_strategy(number(_FPS), number(_FPS_B), F.expr(_TYPE), F.expr(_TYPE_B)).alias("s"))
    return made.select("id", "s.strategy", "s.fps_match", F.round("s.ratio", 6).alias("ratio"), F.round("s.scale", 6).alias("scale"))


def process_track(events: DataFrame, segments: DataFrame, delay_ms: Column, keep: list[str], patches: DataFrame, factor: float, own_styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and styles after the whole chain: style filter, edit list, delay, then font patches and size."""
    left = style_filter(events, keep, True, [], [])
    moved = as_of(left, segments, "track_id", "start_ms", "from_ms", "offset_ms").withColumnRenamed("offset", "__by")
    by = F.when(F.col("is_comment"), 0.0).otherwise(F.col("__by"))
    moved = moved.withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by}).drop("__by")
    return delayed(moved, delay_ms), scaled(patched(own_styles, patches), factor)


@query("subtitle_chain", oracle("subs", body=""", f AS (SELECT *, CASE WHEN is_comment THEN 0 WHEN start_ms >= 6000 THEN 700.0 WHEN start_ms >= 2000 THEN -100.0 ELSE 0 END AS off FROM subs WHERE style IN ('user', 'assistant')),
g AS (SELECT track_id, idx, start_ms + off + CASE WHEN is_comment THEN 0 ELSE track_id % 5 * 10.5 END AS s FROM f), h AS (SELECT track_id, idx, floor(greatest(s, 0) / 10)::BIGINT AS c FROM g)
SELECT track_id, idx, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS start_text FROM h"""))
def q_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, edit list, delay, and the times as they are written."""
    rows = subs(spark, sf)
    segments = rows.select("track_id").distinct().select("track_id", F.explode(F.array(*[F.struct(F.lit(a).alias("from_ms"), F.lit(b).alias("offset_ms")) for a, b in ((2000.0, -100.0), (6000.0, 700.0))])).alias("s")).select("track_id", "s.*")
    patches = spark.createDataFrame([("user", 31.5, None)], "style string, p_size double, p_font string")
    made, _ = process_track(rows, segments, F.col("track_id") % 5 * 10.5, ["user", "assistant"], patches, 1.25, styles(spark, sf))
    return made.select("track_id", "idx", format_centis(F.col("start_ms")).alias("start_text"))
