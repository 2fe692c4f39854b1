"""Tracks of jobs: descriptions, selection, delays, order and the list of options for assembling a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.fixtures import final_tracks, job_delays, job_shift, oracle, tracks
from tidemark.plans.registry import query

REFERENCE = "Source 1"
#: Names of audio codecs by the start of their id, in order.
CODEC_NAMES = {"A_FLAC": "FLAC", "A_AAC": "AAC", "A_AC3": "AC3", "A_EAC3": "E-AC3", "A_DTS": "DTS", "A_TRUEHD": "TrueHD", "A_OPUS": "Opus", "A_VORBIS": "Vorbis", "A_PCM": "PCM", "A_MP3": "MP3"}
#: File extensions by what a codec id holds, in order, and for all others.
EXTENSIONS = {
    "video": ({"V_MPEGH/ISO/HEVC": "h265", "V_MPEG4/ISO/AVC": "h264", "V_MPEG": "mpg", "V_VP9": "vp9", "V_AV1": "av1"}, "bin"),
    "audio": ({"A_TRUEHD": "thd", "A_EAC3": "eac3", "A_AC3": "ac3", "A_DTS": "dts", "A_AAC": "aac", "A_FLAC": "flac", "A_OPUS": "opus", "A_VORBIS": "ogg", "A_PCM": "wav"}, "bin"),
    "subtitles": ({"S_TEXT/ASS": "ass", "S_TEXT/SSA": "ssa", "S_TEXT/UTF8": "srt", "S_HDMV/PGS": "sup", "S_VOBSUB": "sub"}, "sub"),
}


def cases(choices: list[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in choices:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def codec_name(codec: Column) -> Column:
    """A codec's name: of the same id, else of the first that its id starts with, else the id without A_."""
    exact = [(codec == k, F.lit(v)) for k, v in CODEC_NAMES.items()]
    return cases(exact + [(codec.startswith(k), F.lit(v)) for k, v in CODEC_NAMES.items()], F.replace(codec, F.lit("A_"), F.lit("")))


def channel_name(channels: Column) -> Column:
    """The usual name of a number of channels."""
    return cases([(channels == n, F.lit(t)) for n, t in ((1, "Mono"), (2, "2.0"), (6, "5.1"), (8, "7.1"))], F.concat(channels.cast("string"), F.lit("ch")))


def track_details(index: Column, lang: Column, codec: Column, channels: Column, name: Column) -> Column:
    """A line about an audio track."""
    return F.concat_ws(", ", F.concat(F.lit("Track "), index.cast("string"), F.lit(": "), lang), F.concat_ws(" ", codec_name(codec), channel_name(channels)), F.when(name != "", F.concat(F.lit("'"), name, F.lit("'"))))


def track_description(kind: Column, codec: Column, lang: Column, name: Column, details: list[Column]) -> Column:
    """Codec, language and name, and behind a bar the details that aren't null."""
    listed = F.concat_ws(", ", *details)
    base = F.concat(F.when(kind == "audio", codec_name(codec)).otherwise(codec), F.lit(" ("), lang, F.lit(")"), F.when(name != "", F.concat(F.lit(" '"), name, F.lit("'"))).otherwise(""))
    return F.when(listed == "", base).otherwise(F.concat_ws(" | ", base, listed))


def extension(kind: Column, codec: Column) -> Column:
    """The extension of a file that holds a track."""
    upper = F.upper(codec)
    return cases([(kind == k, cases([(upper.contains(c), F.lit(e)) for c, e in known.items()], F.lit(other))) for k, (known, other) in EXTENSIONS.items()], F.lit("bin"))


def pcm_codec(bits: Column) -> Column:
    """The codec that holds samples of so many bits; 16 if unknown."""
    depth = F.coalesce(bits, F.lit(16))
    return F.when(depth >= 64, "pcm_f64le").when(depth >= 32, "pcm_s32le").when(depth >= 24, "pcm_s24le").otherwise("pcm_s16le")


def ordinals(rows: DataFrame) -> DataFrame:
    """Tracks with their number among those of their job and type, from 0."""
    return rows.withColumn("nth", (F.row_number().over(Window.partitionBy("job", "type").orderBy("pos")) - 1).cast("int"))


def extraction_plan(rows: DataFrame, wanted: Column) -> DataFrame:
    """The wanted tracks with their extension and, for audio, the number among all of the job's audio tracks, wanted or not."""
    return ordinals(rows).where(wanted).select("job", "pos", "type", F.when(F.col("type") == "audio", F.col("nth")).alias("audio_index"), extension(F.col("type"), F.col("codec")).alias("extension"))


def select_audio(rows: DataFrame, language: Column, explicit: Column) -> DataFrame:
    """Each job's audio track for analysis: the one of the explicit number, the first if there is no such number; without a number the first of the language, else the first."""
    audio = ordinals(rows).where("type = 'audio'").withColumns({"__lang": F.lower(F.trim(language)), "__at": explicit, "__n": F.count(F.lit(1)).over(Window.partitionBy("job"))})
    by_number, valid = F.col("__at").isNotNull(), F.col("__at").between(0, F.col("__n") - 1)
    same = by_number.isNotNull() & ~by_number & F.col("__lang").isNotNull() & (F.lower(F.trim("lang")) == F.col("__lang"))
    rank = F.when(by_number & valid & (F.col("nth") == F.col("__at")), 0).when(same, 1).otherwise(2)
    best = audio.withColumn("__rank", rank).withColumn("__k", F.row_number().over(Window.partitionBy("job").orderBy("__rank", "nth"))).where("__k = 1")
    reason = F.when(F.col("__rank") == 0, "explicit").when(F.col("__rank") == 1, "language").otherwise("first")
    return best.select("job", "id", "nth", reason.alias("selected_by"), track_details(F.col("nth"), F.col("lang"), F.col("codec"), F.col("channels"), F.col("name")).alias("details"))


def container_delays(rows: DataFrame) -> DataFrame:
    """Audio tracks with their container's delay against that of the first video track of their job and source (0 without one)."""
    video = rows.where("type = 'video'").groupBy("job", "source").agg(F.min_by("container_ms", "pos").alias("video_ms"))
    return rows.where("type = 'audio'").join(video, ["job", "source"], "left").withColumn("relative_ms", F.col("container_ms") - F.coalesce("video_ms", F.lit(0)))


def correlation_delay(audio: DataFrame, language: Column, explicit: Column, default_ms: Column) -> DataFrame:
    """Per job the relative delay of the reference's audio track of the explicit number or, without one, of the first of the language; the default where there is none."""
    own = audio.where(F.col("source") == REFERENCE).withColumn("nth", F.row_number().over(Window.partitionBy("job").orderBy("pos")) - 1)
    hit = F.when(explicit.isNotNull(), F.col("nth") == explicit).otherwise(F.lower(F.trim("lang")) == F.lower(F.trim(language)))
    found = own.where(hit).groupBy("job").agg(F.min_by("relative_ms", "nth").alias("own_ms"))
    jobs = audio.select("job").distinct()
    return jobs.join(found, "job", "left").select("job", F.coalesce("own_ms", default_ms).alias("delay_ms"))


def effective_delay(rows: DataFrame, delays: DataFrame, shift: Column) -> DataFrame:
    """Tracks with the delay they are assembled with.

    The reference's audio: its container's delay and the shift; its video: the shift;
    subtitles whose times were moved already: none. Others: their source's delay
    (external ones that of the source they follow), for subtitles the one of their
    own if there is any; 0 without one.
    """
    kind, source = F.col("type"), F.col("source")
    key = F.when(source == "External", F.coalesce("sync_to", F.lit(REFERENCE))).otherwise(source)
    # a job's sources are few, so its delays meet its tracks by job, as which these lie already
    listed = first_with_list(delays, F.struct("source", "delay_ms", "subtitle_ms"), "source").withColumnRenamed("list", "__delays")
    keyed = rows.withColumn("__key", key).join(listed, "job", "left").withColumn("__d", F.get(F.filter("__delays", lambda d: d["source"] == F.col("__key")), F.lit(0)))
    keyed = keyed.withColumns({"__delay": F.col("__d.delay_ms"), "__own": F.col("__d.subtitle_ms")})
    own = F.when((kind == "subtitles") & F.col("__own").isNotNull(), F.round("__own").cast("int")).otherwise(F.coalesce("__delay", F.lit(0)))
    value = (
        F.when((source == REFERENCE) & (kind == "audio"), F.col("container_ms") + shift)
        .when((source == REFERENCE) & (kind == "video"), shift)
        .when((kind == "subtitles") & (F.col("stepping_adjusted") | F.col("frame_adjusted")), 0)
        .otherwise(own)
    )
    return keyed.withColumn("delay_ms", value.cast("int")).drop("__key", "__delays", "__d", "__delay", "__own")


def first_with_list(rows: DataFrame, value: Column, order: str) -> DataFrame:
    """(job, list): the values of each job's rows. Rows are sorted by job and a job's values gathered as its rows pass; a hash aggregate would sort the lists as well, and hold them all."""
    ordered = Window.partitionBy("job").orderBy(order)
    listed = rows.select("job", F.row_number().over(ordered).alias("__nth"), F.collect_list(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("list"))
    return listed.where("__nth = 1").drop("__nth")


def final_order(rows: DataFrame) -> DataFrame:
    """Tracks with place, from 0: preserved audio and subtitles behind the last other track of their type, or at the end if there is none, audio first."""
    kept = F.when(~F.col("is_preserved"), F.col("pos"))
    whole = Window.partitionBy("job")  # one order of rows does for all of these
    last = F.when(F.col("type") == "audio", F.max(F.when(F.col("type") == "audio", kept)).over(whole)).otherwise(F.max(F.when(F.col("type") == "subtitles", kept)).over(whole))
    end = F.max(kept).over(whole)
    anchor = F.when(~F.col("is_preserved"), F.col("pos")).otherwise(F.coalesce(last, F.coalesce(end, F.lit(-1))))
    late = F.when(~F.col("is_preserved"), 0).when(last.isNotNull(), 1).when(F.col("type") == "audio", 2).otherwise(3)
    keyed = rows.where(~F.col("is_preserved") | F.col("type").isin("audio", "subtitles")).withColumns({"__anchor": anchor, "__late": late})
    place = F.row_number().over(Window.partitionBy("job").orderBy("__anchor", "__late", "pos")) - 1
    return keyed.withColumn("place", place.cast("int")).drop("__anchor", "__late")


def first_places(placed: DataFrame) -> DataFrame:
    """Per job the place of the first video track, of the first default audio and subtitle tracks and of the first forced subtitle track; -1 without one."""
    return placed.groupBy("job").agg(*[F.coalesce(least, F.lit(-1)).alias(name) for name, least in _firsts().items()])


def _firsts() -> dict[str, Column]:
    """The least place of each kind that first_places() tells, as aggregates."""
    kind, place = F.col("type"), F.col("place")
    wanted = {"video": kind == "video", "audio": (kind == "audio") & F.col("is_default"), "subtitles": (kind == "subtitles") & F.col("is_default"), "forced": (kind == "subtitles") & F.col("is_forced")}
    return {name: F.min(F.when(condition, place)) for name, condition in wanted.items()}


def option_list(rows: DataFrame, delays: DataFrame, shift: Column, compression: bool = True, dialog_norm: bool = True) -> DataFrame:
    """Per job the options for assembling its file, in order: each track's language, name, delay, flags and path, and the order of all."""
    placed = final_order(effective_delay(rows, delays, shift))  # delays first, as a join keeps no order within a job
    marked = placed.withColumns({name: F.coalesce(least.over(Window.partitionBy("job")), F.lit(-1)) for name, least in _firsts().items()})
    lit, kind, place = F.lit, F.col("type"), F.col("place")
    lang = cases([(F.col("custom_lang") != "", F.col("custom_lang")), (F.col("lang") != "", F.col("lang"))], "und")
    name = cases([(F.col("custom_name") != "", F.col("custom_name")), (F.col("apply_name") & (F.trim("name") != ""), F.col("name"))], None)
    default = (place == F.col("video")) | (place == F.col("audio")) | (place == F.col("subtitles"))
    upper = F.upper("codec")

    def option(flag: str, value: Column, wanted: Column | None = None) -> Column:
        pair = F.array(lit(flag), value)
        return pair if wanted is None else F.when(wanted, pair).otherwise(F.array().cast("array<string>"))

    tokens = F.concat(
        option("--language", F.concat(lit("0:"), lang)),
        option("--track-name", F.concat(lit("0:"), name), name.isNotNull()),
        option("--sync", F.concat(lit("0:"), F.format_string("%+d", "delay_ms"))),
        option("--default-track-flag", F.concat(lit("0:"), F.when(default, "yes").otherwise("no"))),
        option("--forced-display-flag", lit("0:yes"), (place == F.col("forced")) & (kind == "subtitles")),
        option("--compression", lit("0:none"), lit(compression)),
        option("--remove-dialog-normalization-gain", lit("0"), lit(dialog_norm) & (kind == "audio") & upper.contains("AC3")),
        F.array(lit("("), F.concat(lit("t"), F.col("pos").cast("string"), lit("."), extension(kind, F.col("codec"))), lit(")")),
    )
    whole = Window.partitionBy("job")  # in the order that places have left; no aggregate, as for first_with_list()
    listed = marked.select("job", "place", F.struct("place", tokens.alias("tokens")).alias("t")).withColumn("t", F.collect_list("t").over(whole)).where("place = 0").select("job", F.sort_array("t").alias("t"))
    order = F.array_join(F.transform("t", lambda x: F.concat(x["place"].cast("string"), lit(":0"))), ",")
    return listed.select("job", F.concat(F.flatten(F.transform("t", lambda x: x["tokens"])), F.array(lit("--track-order"), order)).alias("tokens"))


def single_flags(rows: DataFrame, flag: str, kind: str, force: bool = False) -> DataFrame:
    """Of a job's tracks of a type that have a flag only the first keeps it; with force the first track gets it where none has."""
    whole = Window.partitionBy("job", "type")
    first_flagged = F.min(F.when(F.col(flag), F.col("pos"))).over(whole)
    chosen = F.coalesce(first_flagged, F.min("pos").over(whole)) if force else first_flagged
    return rows.withColumn(flag, F.when(F.col("type") == kind, F.coalesce(F.col("pos") == chosen, F.lit(False))).otherwise(F.col(flag)))


def swap_corrected(rows: DataFrame) -> DataFrame:
    """Each corrected track as two: itself, made from the corrected file and named so, and the original behind it, preserved and without flags."""
    both = F.explode(F.when(F.col("is_corrected"), F.array(F.lit("corrected"), F.lit("original"))).otherwise(F.array(F.lit("track")))).alias("part")
    rows = rows.select("*", both)
    original, named = F.col("part") == "original", F.when(F.col("name") == "", F.col("codec")).otherwise(F.col("name"))
    label = F.when(F.col("part") == "corrected", F.concat(named, F.lit(" (Stepping Corrected)"))).when(original, F.concat(named, F.lit(" (Original)"))).otherwise(F.col("name"))
    return rows.withColumns({"name": label, "apply_name": F.col("apply_name") | (F.col("part") != "track"), "is_default": F.col("is_default") & ~original, "is_preserved": F.col("is_preserved") | original})


def realise(selection: DataFrame, probed: DataFrame) -> DataFrame:
    """Selected tracks (job, source, id, ...) with what probing found of them; ones that aren't there fall out, and missing settings take their defaults."""
    joined = selection.join(probed, ["job", "source", "id"])
    return joined.withColumns({"is_default": F.coalesce("is_default", F.lit(False)), "size_multiplier": F.coalesce("size_multiplier", F.lit(1.0)), "custom_lang": F.coalesce("custom_lang", F.lit(""))})


_V = ("tracks",)
_NAME = "CASE " + " ".join(f"WHEN codec = '{k}' THEN '{v}'" for k, v in CODEC_NAMES.items()) + " " + " ".join(f"WHEN starts_with(codec, '{k}') THEN '{v}'" for k, v in CODEC_NAMES.items()) + " ELSE replace(codec, 'A_', '') END"
_CHANNELS = "CASE channels WHEN 1 THEN 'Mono' WHEN 2 THEN '2.0' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE channels || 'ch' END"
_EXT = "CASE type " + " ".join(f"WHEN '{k}' THEN CASE " + " ".join(f"WHEN contains(upper(codec), '{c}') THEN '{e}'" for c, e in known.items()) + f" ELSE '{other}' END" for k, (known, other) in EXTENSIONS.items()) + " ELSE 'bin' END"
_DETAILS = f"'Track ' || nth || ': ' || lang || ', ' || {_NAME} || ' ' || {_CHANNELS} || CASE WHEN name <> '' THEN ', ''' || name || '''' ELSE '' END"


@query("track_names", oracle(*_V, body=f""" SELECT job, pos, {_NAME} AS codec_name, {_EXT} AS extension, CASE WHEN coalesce(bits::INT, 16) >= 24 THEN 'pcm_s24le' ELSE 'pcm_s16le' END AS pcm,
  CASE WHEN type = 'audio' THEN {_NAME} ELSE codec END || ' (' || lang || ')' || CASE WHEN name <> '' THEN ' ''' || name || '''' ELSE '' END || CASE WHEN type = 'audio' THEN ' | ' || rate || ' Hz' || coalesce(', ' || bits || '-bit', '') || ', ' || channels || ' ch' ELSE '' END AS description FROM tracks"""))
def q_names(spark: SparkSession, sf: str) -> DataFrame:
    """P22, P23, P24."""
    kind, codec = F.col("type"), F.col("codec")
    audio = [F.when(kind == "audio", x) for x in (F.concat("rate", F.lit(" Hz")), F.concat("bits", F.lit("-bit")), F.concat(F.col("channels").cast("string"), F.lit(" ch")))]
    return tracks(spark, sf).select("job", "pos", codec_name(codec).alias("codec_name"), extension(kind, codec).alias("extension"), pcm_codec(F.col("bits").cast("int")).alias("pcm"), track_description(kind, codec, F.col("lang"), F.col("name"), audio).alias("description"))


@query("track_extraction", oracle(*_V, body=f", o AS (SELECT *, (row_number() OVER (PARTITION BY job, type ORDER BY pos) - 1)::INT AS nth FROM tracks) SELECT job, pos, type, CASE WHEN type = 'audio' THEN nth END AS audio_index, {_EXT} AS extension FROM o WHERE id % 2 = 1"))
def q_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction_plan(tracks(spark, sf), F.col("id") % 2 == 1)


_SELECT = f""", o AS (SELECT *, (row_number() OVER (PARTITION BY job ORDER BY pos) - 1)::INT AS nth, count(*) OVER (PARTITION BY job) AS n, CASE WHEN job % 3 = 0 THEN 'JPN ' END AS want, CASE WHEN job % 3 = 1 THEN job % 4 - 1 END AS at_nth FROM tracks WHERE type = 'audio'),
r AS (SELECT *, CASE WHEN at_nth IS NOT NULL AND at_nth BETWEEN 0 AND n - 1 AND nth = at_nth THEN 0 WHEN at_nth IS NULL AND want IS NOT NULL AND lower(lang) = lower(trim(want)) THEN 1 ELSE 2 END AS rank FROM o)
SELECT job, id, nth, CASE rank WHEN 0 THEN 'explicit' WHEN 1 THEN 'language' ELSE 'first' END AS selected_by, {_DETAILS} AS details FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY rank, nth) AS k FROM r) WHERE k = 1"""


@query("track_selection", oracle(*_V, body=_SELECT))
def q_selection(spark: SparkSession, sf: str) -> DataFrame:
    """J15, P39."""
    job = F.col("job")
    return select_audio(tracks(spark, sf), F.when(job % 3 == 0, "JPN "), F.when(job % 3 == 1, job % 4 - 1))


_CONTAINER = ", v AS (SELECT job, source, arg_min(container_ms, pos) AS video_ms FROM tracks WHERE type = 'video' GROUP BY 1, 2), c AS (SELECT t.*, video_ms, container_ms - coalesce(video_ms, 0) AS relative_ms FROM tracks t LEFT JOIN v USING (job, source) WHERE type = 'audio')"


@query("track_container_delays", oracle(*_V, body=_CONTAINER + " SELECT job, pos, source, container_ms, video_ms, relative_ms FROM c"))
def q_container(spark: SparkSession, sf: str) -> DataFrame:
    return container_delays(tracks(spark, sf)).select("job", "pos", "source", "container_ms", "video_ms", "relative_ms")


@query("track_correlation_delay", oracle(*_V, body=_CONTAINER + """, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) - 1 AS nth, CASE WHEN job % 2 = 0 THEN job % 3 END AS at_nth FROM c WHERE source = 'Source 1'),
f AS (SELECT job, arg_min(relative_ms, nth) AS own FROM n WHERE CASE WHEN at_nth IS NOT NULL THEN nth = at_nth ELSE lang = 'eng' END GROUP BY 1)
SELECT job, coalesce(own, 7)::INT AS delay_ms FROM (SELECT DISTINCT job FROM c) LEFT JOIN f USING (job)"""))
def q_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return correlation_delay(container_delays(tracks(spark, sf)), F.lit("eng"), F.when(F.col("job") % 2 == 0, F.col("job") % 3), F.lit(7))


EFFECTIVE = """, e AS (SELECT t.*, CASE WHEN t.source = 'Source 1' AND type = 'audio' THEN container_ms + job % 3 * 50 WHEN t.source = 'Source 1' AND type = 'video' THEN job % 3 * 50 WHEN type = 'subtitles' AND (stepping_adjusted OR frame_adjusted) THEN 0
  WHEN type = 'subtitles' AND d.subtitle_ms IS NOT NULL THEN round(d.subtitle_ms) ELSE coalesce(d.delay_ms, 0) END::INT AS delay_ms FROM tracks t LEFT JOIN (SELECT job AS dj, source AS ds, delay_ms, subtitle_ms FROM jdelays) d ON dj = job AND ds = CASE t.source WHEN 'External' THEN coalesce(sync_to, 'Source 1') ELSE t.source END)"""


def effective(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's tracks with their effective delays."""
    return effective_delay(tracks(spark, sf), job_delays(spark, sf), job_shift(F.col("job")))


@query("track_effective_delay", oracle("tracks", "delays", body=EFFECTIVE + " SELECT job, pos, source, type, delay_ms FROM e"))
def q_effective(spark: SparkSession, sf: str) -> DataFrame:
    return effective(spark, sf).select("job", "pos", "source", "type", "delay_ms")


_PLACED = """, k AS (SELECT *, max(pos) FILTER (NOT is_preserved) OVER (PARTITION BY job, type) AS last, max(pos) FILTER (NOT is_preserved) OVER (PARTITION BY job) AS fin FROM {t} WHERE NOT is_preserved OR type IN ('audio', 'subtitles')),
pl AS (SELECT *, (row_number() OVER (PARTITION BY job ORDER BY CASE WHEN NOT is_preserved THEN pos ELSE coalesce(last, fin, -1) END, CASE WHEN NOT is_preserved THEN 0 WHEN last IS NOT NULL THEN 1 WHEN type = 'audio' THEN 2 ELSE 3 END, pos) - 1)::INT AS place FROM k),
fp AS (SELECT job, coalesce(min(place) FILTER (type = 'video'), -1) AS video, coalesce(min(place) FILTER (type = 'audio' AND is_default), -1) AS audio, coalesce(min(place) FILTER (type = 'subtitles' AND is_default), -1) AS subtitles, coalesce(min(place) FILTER (type = 'subtitles' AND is_forced), -1) AS forced FROM pl GROUP BY 1)"""


@query("track_order", oracle(*_V, body=_PLACED.format(t="tracks") + " SELECT job, pos, place FROM pl"))
def q_order(spark: SparkSession, sf: str) -> DataFrame:
    return final_order(tracks(spark, sf)).select("job", "pos", "place")


@query("track_first_places", oracle(*_V, body=_PLACED.format(t="tracks") + " SELECT * FROM fp"))
def q_places(spark: SparkSession, sf: str) -> DataFrame:
    return first_places(final_order(tracks(spark, sf)))


@query("track_options", oracle("tracks", "delays", body=EFFECTIVE + _PLACED.format(t="e") + f""", tk AS (SELECT job, place, '--language 0:' || CASE WHEN custom_lang <> '' THEN custom_lang WHEN lang <> '' THEN lang ELSE 'und' END || CASE WHEN custom_name <> '' THEN ' --track-name 0:' || custom_name WHEN apply_name AND trim(name) <> '' THEN ' --track-name 0:' || name ELSE '' END
  || ' --sync 0:' || printf('%+d', delay_ms) || ' --default-track-flag 0:' || CASE WHEN place IN (video, audio, subtitles) THEN 'yes' ELSE 'no' END || CASE WHEN place = forced AND type = 'subtitles' THEN ' --forced-display-flag 0:yes' ELSE '' END || ' --compression 0:none'
  || CASE WHEN type = 'audio' AND contains(upper(codec), 'AC3') THEN ' --remove-dialog-normalization-gain 0' ELSE '' END || ' ( t' || pos || '.' || {_EXT} || ' )' AS t FROM pl JOIN fp USING (job))
SELECT job, string_agg(t, ' ' ORDER BY place) || ' --track-order ' || string_agg(place || ':0', ',' ORDER BY place) AS tokens FROM tk GROUP BY 1"""))
def q_options(spark: SparkSession, sf: str) -> DataFrame:
    """K06, T10, T11, P12."""
    made = option_list(tracks(spark, sf), job_delays(spark, sf), job_shift(F.col("job")))
    return made.select("job", F.array_join("tokens", " ").alias("tokens"))


@query("track_flags", oracle(*_V, body=""", f AS (SELECT *, min(pos) FILTER (is_forced) OVER w AS ff, min(pos) FILTER (is_default) OVER w AS fd, min(pos) OVER w AS fp FROM tracks WINDOW w AS (PARTITION BY job, type))
SELECT job, pos, CASE WHEN type = 'audio' THEN pos = coalesce(fd, fp) ELSE is_default END AS is_default, CASE WHEN type = 'subtitles' THEN coalesce(pos = ff, false) ELSE is_forced END AS is_forced FROM f"""))
def q_flags(spark: SparkSession, sf: str) -> DataFrame:
    """N20."""
    return single_flags(single_flags(tracks(spark, sf), "is_forced", "subtitles"), "is_default", "audio", force=True).select("job", "pos", "is_default", "is_forced")


@query("track_corrected", oracle(*_V, body=""", p AS (SELECT *, CASE WHEN name = '' THEN codec ELSE name END AS n2, unnest(CASE WHEN is_corrected THEN ['corrected', 'original'] ELSE ['track'] END) AS part FROM tracks)
SELECT job, pos, part, CASE part WHEN 'corrected' THEN n2 || ' (Stepping Corrected)' WHEN 'original' THEN n2 || ' (Original)' ELSE name END AS name, apply_name OR part <> 'track' AS apply_name, is_default AND part <> 'original' AS is_default, is_preserved OR part = 'original' AS is_preserved FROM p"""))
def q_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return swap_corrected(tracks(spark, sf)).select("job", "pos", "part", "name", "apply_name", "is_default", "is_preserved")


@query("track_plan", oracle(*_V, body=""", s AS (SELECT job, source, id + job % 2 AS id, min(CASE WHEN pos % 2 = 0 THEN is_default::INT END) = 1 AS d, min(CASE WHEN pos % 3 = 0 THEN 1.5::DOUBLE END) AS m, min(CASE WHEN pos % 3 = 1 THEN custom_lang END) AS c FROM tracks GROUP BY 1, 2, 3)
SELECT s.job, s.source, s.id, p.pos, p.codec, coalesce(d, false) AS is_default, coalesce(m, 1.0) AS size_multiplier, coalesce(c, '') AS custom_lang FROM s JOIN tracks p ON p.job = s.job AND p.source = s.source AND p.id = s.id"""))
def q_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A selection that names some tracks which aren't there."""
    rows = tracks(spark, sf)
    chosen = rows.groupBy("job", "source", (F.col("id") + F.col("job") % 2).cast("int").alias("id")).agg(
        (F.min(F.when(F.col("pos") % 2 == 0, F.col("is_default").cast("int"))) == 1).alias("is_default"), F.min(F.when(F.col("pos") % 3 == 0, 1.5)).alias("size_multiplier"), F.min(F.when(F.col("pos") % 3 == 1, F.col("custom_lang"))).alias("custom_lang")
    )
    return realise(chosen, rows.select("job", "source", "id", "pos", "codec")).select("job", "source", "id", "pos", "codec", "is_default", "size_multiplier", "custom_lang")


@query("track_corrections_wanted", oracle(*_V, body=""", k AS (SELECT DISTINCT job, source FROM tracks WHERE type = 'audio'), s AS (SELECT DISTINCT job, source FROM tracks WHERE type = 'subtitles'), a AS (SELECT DISTINCT job, source FROM tracks)
SELECT a.job, a.source, CASE WHEN a.job % 5 = 0 THEN 'disabled' WHEN a.job % 7 = 0 THEN 'separated' WHEN k.job IS NOT NULL THEN 'correct' WHEN s.job IS NOT NULL THEN 'subtitles only' ELSE 'none' END AS routing FROM a LEFT JOIN k USING (job, source) LEFT JOIN s USING (job, source)"""))
def q_routing(spark: SparkSession, sf: str) -> DataFrame:
    """What is done about a stepped source: nothing where correction is off or the source was separated, all of it where it gives audio, its subtitles alone where it gives only those."""
    rows = tracks(spark, sf)
    return routing(rows.select("job", "source").distinct(), rows, F.col("job") % 5 != 0, F.col("job") % 7 == 0)


def routing(sources: DataFrame, rows: DataFrame, enabled: Column, separated: Column) -> DataFrame:
    """sources(job, source) with routing, by what tracks they give."""
    for kind in ("audio", "subtitles"):
        sources = sources.join(rows.where(F.col("type") == kind).select("job", "source", F.lit(True).alias(f"__{kind}")).distinct(), ["job", "source"], "left")
    route = F.when(~enabled, "disabled").when(separated, "separated").when(F.col("__audio"), "correct").when(F.col("__subtitles"), "subtitles only").otherwise("none")
    return sources.select("job", "source", route.alias("routing"))


@query("track_lookup", oracle(*_V, body=""", k AS (SELECT DISTINCT job, source || '_' || id AS key FROM tracks), p AS (SELECT job, key, string_split(key, '_')[1] AS source, string_split(key, '_')[2]::INT AS id FROM k)
SELECT p.job, key, min(pos) AS pos FROM p JOIN tracks t ON t.job = p.job AND t.source = p.source AND t.id = p.id AND type = 'audio' GROUP BY 1, 2"""))
def q_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The audio track that a key of source and number names; the number is what follows the last underscore."""
    rows = tracks(spark, sf)
    keys = rows.select("job", F.concat_ws("_", "source", F.col("id").cast("string")).alias("key")).distinct()
    split = keys.select("job", "key", F.regexp_extract("key", "^(.*)_([0-9]+)$", 1).alias("source"), F.regexp_extract("key", "^(.*)_([0-9]+)$", 2).cast("int").alias("id"))
    return split.join(rows.where("type = 'audio'").select("job", "source", "id", "pos"), ["job", "source", "id"]).groupBy("job", "key").agg(F.min("pos").alias("pos"))


@query("track_completeness", oracle("tracks", "final", body=""", p AS (SELECT job, count(*) AS planned FROM tracks GROUP BY 1), f AS (SELECT job, count(*) AS made FROM final GROUP BY 1), m AS (SELECT t.job, string_agg(t.pos::VARCHAR, ',' ORDER BY t.pos) AS missing FROM tracks t ANTI JOIN final f USING (job, pos) GROUP BY 1)
SELECT job, planned, coalesce(made, 0) AS made, coalesce(missing, '') AS missing FROM p LEFT JOIN f USING (job) LEFT JOIN m USING (job)"""))
def q_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Planned tracks against those that were made, and which are missing."""
    planned, made = tracks(spark, sf), final_tracks(spark, sf)
    missing = planned.join(made, ["job", "pos"], "left_anti").groupBy("job").agg(F.array_join(F.sort_array(F.collect_list("pos")).cast("array<string>"), ",").alias("missing"))
    counted = planned.groupBy("job").agg(F.count(F.lit(1)).alias("planned")).join(made.groupBy("job").agg(F.count(F.lit(1)).alias("made")), "job", "left").join(missing, "job", "left")
    return counted.fillna(0, ["made"]).fillna("", ["missing"])
