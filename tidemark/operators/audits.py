"""Audits: rules that hold what was planned against what came out, each giving its violations, and all of them in one order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.tracks import EFFECTIVE, effective
from tidemark.plans.fixtures import final_tracks, job_shift, oracle, tracks
from tidemark.plans.registry import query

#: Codecs of text subtitles, and of audio with objects.
ASS, SRT, OBJECT_AUDIO = ("S_TEXT/ASS", "S_TEXT/SSA"), ("S_TEXT/UTF8",), ("A_TRUEHD", "A_EAC3")


@dataclass(frozen=True)
class Check:
    """What is wrong with a row of beside(): whether it is, what was expected and made, and the row that is named, its place if none."""

    wrong: Column
    expected: Column
    actual: Column
    row: Column | None = None


#: Rules by name, in the order they run: the made tracks' columns that each needs, and its check.
Rule = tuple[tuple[str, ...], Callable[[], Check]]
RULES: dict[str, Rule] = {}


def rule(name: str, *fields: str) -> Callable[[Callable[[], Check]], Callable[[], Check]]:
    """Register a rule under a name, with the columns of made tracks that it looks at."""

    def add(function: Callable[[], Check]) -> Callable[[], Check]:
        RULES[name] = (fields, function)
        return function

    return add


def positions(planned: DataFrame, made: DataFrame, how: str = "inner") -> DataFrame:
    """Planned tracks beside those made at the same place of their job, as columns and made_ columns."""
    theirs = made.select("job", "pos", *[F.col(c).alias(f"made_{c}") for c in made.columns if c not in ("job", "pos")], F.lit(True).alias("was_made"))
    return planned.join(theirs, ["job", "pos"], how)


def beside(planned: DataFrame, made: DataFrame, fields: list[str]) -> DataFrame:
    """Planned tracks with all that was made of their job: (..., made, same, nth, peer, first, n, n_corrected).

    made are the job's tracks that came out, in order, with pos, type and the fields; same
    the one at the same place, peer the one of the same type and number among those, or
    null; first marks a job's first planned track, n and n_corrected count its planned
    ones. Both sides meet once, by job: a job's tracks are few.
    """
    whole = Window.partitionBy("job")
    so_far = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("type")
    # numbers of a type are counted in the order of places, so that one order of rows does for all
    nth = F.when(kind == "audio", F.count_if(kind == "audio").over(so_far)).when(kind == "subtitles", F.count_if(kind == "subtitles").over(so_far)) - 1
    ours = planned.withColumns({"nth": nth.cast("int"), "first": F.row_number().over(whole.orderBy("pos")) == 1, "n": F.count(F.lit(1)).over(whole), "n_corrected": F.count_if("is_corrected").over(whole)})
    theirs = made.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("pos", *dict.fromkeys(("type", *fields))))).alias("made"))
    both = ours.join(theirs, "job", "left")
    same = F.get(F.filter("made", lambda x: x["pos"] == F.col("pos")), F.lit(0))
    peer = F.get(F.filter("made", lambda x: x["type"] == F.col("type")), F.col("nth"))
    return both.withColumns({"same": same, "peer": peer})


def _differs(of: str, expected: Column, field: str, wanted: Column | None = None) -> Check:
    """Tracks that have one beside, whose expected and actual values differ, nulls included."""
    actual = F.col(f"{of}.{field}")
    wrong = F.col(of).isNotNull() & ~expected.eqNullSafe(actual)
    return Check(wrong if wanted is None else wrong & wanted, expected, actual)


@rule("default flag", "is_default")
def default_flags() -> Check:
    """Q02."""
    return _differs("same", F.col("is_default"), "is_default")


@rule("forced flag", "is_forced")
def forced_flags() -> Check:
    """Q02."""
    return _differs("same", F.col("is_forced"), "is_forced")


@rule("missing track")
def missing_tracks() -> Check:
    """Planned tracks without one at their place."""
    return Check(F.col("same").isNull(), F.col("type"), F.lit(None))


@rule("object audio", "codec")
def object_audio() -> Check:
    """Q05: planned audio with objects whose codec no track of the job has."""
    there = F.exists("made", lambda x: x["codec"] == F.col("codec"))
    return Check((F.col("type") == "audio") & F.col("codec").isin(*OBJECT_AUDIO) & ~F.coalesce(there, F.lit(False)), F.col("codec"), F.lit(None))


@rule("codec", "codec")
def codecs() -> Check:
    """Q06: codecs of audio and video, but for audio whose drift was corrected."""
    return _differs("same", F.col("codec"), "codec", (F.col("type") != "subtitles") & ~((F.col("type") == "audio") & F.col("is_corrected")))


@rule("channels", "channels")
def channels() -> Check:
    """Q07: the number of channels of the n-th audio track; a missing stream is a violation."""
    return Check((F.col("type") == "audio") & ~F.col("channels").eqNullSafe(F.col("peer.channels")), F.col("channels"), F.col("peer.channels"))


@rule("sample rate", "rate")
def sample_rates() -> Check:
    """Q08: rates of audio streams that are there, but for corrected ones."""
    return _differs("peer", F.col("rate"), "rate", (F.col("type") == "audio") & ~F.col("is_corrected"))


@rule("bit depth", "bits")
def bit_depths() -> Check:
    """Q08: depths where both sides tell one, but for corrected streams."""
    return _differs("peer", F.col("bits"), "bits", (F.col("type") == "audio") & ~F.col("is_corrected") & F.col("bits").isNotNull() & F.col("peer.bits").isNotNull())


@rule("drift correction")
def drift_corrections() -> Check:
    """Q09: jobs with corrected audio but fewer audio tracks than corrected ones."""
    streams = F.coalesce(F.size(F.filter("made", lambda x: x["type"] == "audio")), F.lit(0))
    streams = F.greatest(streams, F.lit(0))  # the size of null is -1 in some settings
    return Check(F.col("first") & (streams < F.col("n_corrected")), F.col("n_corrected"), streams, F.lit("job"))


@rule("subtitle format", "codec")
def subtitle_formats() -> Check:
    """Q13: the n-th subtitle track's codec: text after conversion or recognition, otherwise the planned one or a compatible one."""
    was, now = F.col("codec"), F.col("peer.codec")
    alike = (was == now) | (was.isin(*ASS) & now.isin(*ASS)) | (was.startswith("S_VOBSUB") & now.startswith("S_VOBSUB")) | (was.startswith("S_HDMV/PGS") & now.startswith("S_HDMV/PGS"))
    fine = F.when(F.col("convert_to_ass"), now.isin(*ASS)).when(F.col("perform_ocr"), now.isin(*ASS, *SRT)).otherwise(alike)
    return Check((F.col("type") == "subtitles") & F.col("peer").isNotNull() & ~fine, F.when(F.col("convert_to_ass"), ASS[0]).when(F.col("perform_ocr"), "text").otherwise(was), now)


@rule("track count")
def track_counts() -> Check:
    """Q18."""
    made = F.greatest(F.coalesce(F.size("made"), F.lit(0)), F.lit(0))
    return Check(F.col("first") & (F.col("n") != made), F.col("n"), made, F.lit("job"))


@rule("track order", "type")
def track_order() -> Check:
    """Q18: types by place."""
    return _differs("same", F.col("type"), "type")


@rule("language", "lang", "lang_ietf")
def languages() -> Check:
    """Q19: the own or the track's language, in either tag."""
    wanted = F.when(F.col("custom_lang") != "", F.col("custom_lang")).otherwise(F.col("lang"))
    return _differs("same", wanted, "lang", ~wanted.eqNullSafe(F.col("same.lang_ietf")))


@rule("track name", "name")
def track_names() -> Check:
    """Q20: the own name, else the track's where it is to be applied, else none."""
    wanted = F.when(F.col("custom_name") != "", F.col("custom_name")).when(F.col("apply_name"), F.col("name")).otherwise("")
    return _differs("same", wanted, "name")


def run_rules(planned: DataFrame, made: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Q01: the violations of all rules: (rule_no, rule, job, row, expected, actual). All rules look at the same rows, which are made once."""
    rules = rules or RULES
    found = []
    for number, (name, (_, check)) in enumerate(rules.items()):
        c = check()
        found.append(F.when(c.wrong, F.struct(F.lit(number).alias("rule_no"), F.lit(name).alias("rule"), (F.col("pos").cast("string") if c.row is None else c.row).alias("row"), c.expected.cast("string").alias("expected"), c.actual.cast("string").alias("actual"))))
    rows = beside(planned, made, [f for fields, _ in rules.values() for f in fields])
    each = rows.select("job", F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("v"))
    return each.select("v.rule_no", "v.rule", "job", "v.row", "v.expected", "v.actual")


# rules that need more than both sides' tracks


def audio_sync(planned: DataFrame, made: DataFrame) -> DataFrame:
    """Q12: tracks other than subtitles whose first time is over 1 ms off their effective delay."""
    off = positions(planned, made).where(F.col("type") != "subtitles").withColumn("actual_ms", F.round(F.col("made_first_ns") / 1e6).cast("int"))
    return off.where(F.abs(F.col("actual_ms") - F.col("delay_ms")) > 1).select("job", "pos", "type", "delay_ms", "actual_ms")


def global_shifts(planned: DataFrame, made: DataFrame, shift: Column) -> DataFrame:
    """Q11: reference video whose first time is over 1 ms off the global shift, where there is one."""
    off = positions(planned.where("source = 'Source 1' AND type = 'video'"), made).withColumns({"expected_ms": shift, "actual_ms": F.round(F.col("made_first_ns") / 1e6).cast("int")})
    return off.where((F.col("expected_ms") != 0) & (F.abs(F.col("actual_ms") - F.col("expected_ms")) > 1)).select("job", "pos", "expected_ms", "actual_ms")


#: Fields of a video stream's colours, and side data that must stay.
COLOURS, STAYS = ("color_transfer", "color_primaries", "color_space", "color_range"), ("Mastering display", "Content light level")


def video_metadata(source: DataFrame, made: DataFrame) -> DataFrame:
    """Q03: (job, field, expected, actual): size, colours that the source tells, and side data that was lost. Both sides: (job, width, height, colours, side_data array)."""
    both = source.join(made.select("job", *[F.col(c).alias(f"made_{c}") for c in made.columns if c != "job"]), "job")
    size = [F.concat_ws("x", F.col(f"{p}width").cast("string"), F.col(f"{p}height").cast("string")) for p in ("", "made_")]
    checks = [F.when((size[0] != size[1]) & (F.col("width") > 0), F.struct(F.lit("size").alias("field"), size[0].alias("expected"), size[1].alias("actual")))]
    for c in COLOURS:
        was, now = F.coalesce(F.col(c), F.lit("")), F.coalesce(F.col(f"made_{c}"), F.lit(""))
        checks.append(F.when((was != "") & (was != "unknown") & (was != now), F.struct(F.lit(c).alias("field"), was.alias("expected"), now.alias("actual"))))
    lost = F.filter("side_data", lambda x: (x.contains(STAYS[0]) | x.contains(STAYS[1])) & ~F.array_contains("made_side_data", x))
    lost = F.transform(lost, lambda x: F.struct(F.lit("side data").alias("field"), x.alias("expected"), F.lit("").alias("actual")))
    found = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), lost)
    return both.select("job", F.explode(found).alias("f")).select("job", "f.field", "f.expected", "f.actual")


def dynamic_range(planned: DataFrame, streams: DataFrame) -> DataFrame:
    """Q04: jobs with planned HEVC video whose made video streams have side data, but none of a dynamic range, and no HEVC track beside."""
    wanted = planned.where((F.col("type") == "video") & F.lower("codec").contains("hevc")).select("job").distinct()
    told = F.exists("side_data", lambda x: x.contains("DOVI") | x.contains("Dolby Vision"))
    return streams.where((F.size("side_data") > 0) & ~told & ~F.col("has_hevc")).join(wanted, "job", "left_semi").select("job", F.size("side_data").alias("n_side_data"))


def stepping_quality(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """Q10: corrected sources with their findings by severity, and whether their edit list is missing. findings(source_key, severity), segments(source_key)."""
    counted = findings.groupBy("source_key").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    lists = segments.groupBy("source_key").agg(F.count(F.lit(1)).alias("segments"))
    joined = counted.join(lists, "source_key", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    return joined.select("*", (F.col("segments") == 0).alias("no_edit_list"), (F.col("high") + F.col("medium") + (F.col("segments") == 0).cast("int")).alias("issues"))


def match_tier(confidence: Column) -> Column:
    """Q14: fine from 0.8, a warning from 0.5, an issue below."""
    return F.when(confidence >= 0.8, "ok").when(confidence >= 0.5, "warning").otherwise("issue")


def missing_attachments(planned: DataFrame, made: DataFrame) -> DataFrame:
    """Q21: planned attachments (job, path) whose file name no made one (job, file_name) has, in any case."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    return planned.select("job", name.alias("name")).join(made.select("job", F.lower("file_name").alias("name")), ["job", "name"], "left_anti")


_B = ("tracks", "final")
_PAIR = ", b AS (SELECT p.*, f.type AS ftype, f.codec AS fcodec, f.lang AS flang, f.lang_ietf AS fietf, f.name AS fname, f.is_default AS fdef, f.is_forced AS fforced FROM tracks p JOIN final f USING (job, pos))"
_AUDIO = """, ap AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS nth FROM tracks WHERE type = 'audio'), af AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS nth FROM final WHERE type = 'audio'),
aa AS (SELECT ap.*, af.channels AS fch, af.rate AS frate, af.bits AS fbits, af.job IS NOT NULL AS made FROM ap LEFT JOIN af USING (job, nth))"""
_SUBS = """, sp AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS nth FROM tracks WHERE type = 'subtitles'), sf AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS nth FROM final WHERE type = 'subtitles'),
ss AS (SELECT sp.*, sf.codec AS fcodec FROM sp JOIN sf USING (job, nth))"""
_WANT_LANG, _WANT_NAME = "CASE WHEN custom_lang <> '' THEN custom_lang ELSE lang END", "CASE WHEN custom_name <> '' THEN custom_name WHEN apply_name THEN name ELSE '' END"


def _violation(table: str, where: str, expected: str, actual: str, row: str = "pos::VARCHAR") -> str:
    return f"SELECT job, {row} AS row, ({expected})::VARCHAR AS expected, ({actual})::VARCHAR AS actual FROM {table} WHERE {where}"


_FINE = """CASE WHEN convert_to_ass THEN fcodec IN ('S_TEXT/ASS', 'S_TEXT/SSA') WHEN perform_ocr THEN fcodec IN ('S_TEXT/ASS', 'S_TEXT/SSA', 'S_TEXT/UTF8')
  ELSE codec = fcodec OR (codec IN ('S_TEXT/ASS', 'S_TEXT/SSA') AND fcodec IN ('S_TEXT/ASS', 'S_TEXT/SSA')) OR (starts_with(codec, 'S_VOBSUB') AND starts_with(fcodec, 'S_VOBSUB')) OR (starts_with(codec, 'S_HDMV/PGS') AND starts_with(fcodec, 'S_HDMV/PGS')) END"""
RULE_SQL = {
    "default flag": (_PAIR, _violation("b", "is_default <> fdef", "is_default", "fdef")),
    "forced flag": (_PAIR, _violation("b", "is_forced <> fforced", "is_forced", "fforced")),
    "missing track": ("", _violation("tracks t", "NOT EXISTS (SELECT 1 FROM final f WHERE f.job = t.job AND f.pos = t.pos)", "type", "NULL")),
    "object audio": ("", _violation("tracks t", "type = 'audio' AND codec IN ('A_TRUEHD', 'A_EAC3') AND NOT EXISTS (SELECT 1 FROM final f WHERE f.job = t.job AND f.codec = t.codec)", "codec", "NULL")),
    "codec": (_PAIR, _violation("b", "type <> 'subtitles' AND NOT (type = 'audio' AND is_corrected) AND codec <> fcodec", "codec", "fcodec")),
    "channels": (_AUDIO, _violation("aa", "channels IS DISTINCT FROM fch", "channels", "fch")),
    "sample rate": (_AUDIO, _violation("aa", "made AND NOT is_corrected AND rate <> frate", "rate", "frate")),
    "bit depth": (_AUDIO, _violation("aa", "made AND NOT is_corrected AND bits <> fbits", "bits", "fbits")),
    "drift correction": (", dc AS (SELECT job, count(*) FILTER (is_corrected) AS n FROM tracks GROUP BY 1), dm AS (SELECT job, count(*) AS m FROM final WHERE type = 'audio' GROUP BY 1), dd AS (SELECT job, n, coalesce(m, 0) AS m FROM dc LEFT JOIN dm USING (job) WHERE n > 0)", _violation("dd", "m < n", "n", "m", "'job'")),
    "subtitle format": (_SUBS, _violation("ss", f"NOT ({_FINE})", "CASE WHEN convert_to_ass THEN 'S_TEXT/ASS' WHEN perform_ocr THEN 'text' ELSE codec END", "fcodec")),
    "track count": (", tc AS (SELECT job, count(*) AS n, (SELECT count(*) FROM final f WHERE f.job = t.job) AS m FROM tracks t GROUP BY 1)", _violation("tc", "n <> m", "n", "m", "'job'")),
    "track order": (_PAIR, _violation("b", "type <> ftype", "type", "ftype")),
    "language": (_PAIR, _violation("b", f"{_WANT_LANG} <> flang AND {_WANT_LANG} <> fietf", _WANT_LANG, "flang")),
    "track name": (_PAIR, _violation("b", f"{_WANT_NAME} <> fname", _WANT_NAME, "fname")),
}


def _register(name: str) -> None:
    ctes, select = RULE_SQL[name]

    @query(f"audit_{name.replace(' ', '_')}", oracle(*_B, body=f"{ctes} {select}"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return run_rules(tracks(spark, sf), final_tracks(spark, sf), {name: RULES[name]}).select("job", "row", "expected", "actual")


for _name in RULES:
    _register(_name)


@query("audit_all", oracle(*_B, body="".join(dict.fromkeys(c for c, _ in RULE_SQL.values())) + ", v AS (" + " UNION ALL ".join(f"SELECT {i} AS rule_no, '{n}' AS rule, * FROM ({RULE_SQL[n][1]})" for i, n in enumerate(RULES)) + ") SELECT rule_no, rule, count(*) AS issues, count(DISTINCT job) AS jobs FROM v GROUP BY 1, 2"))
def q_all(spark: SparkSession, sf: str) -> DataFrame:
    """Q01: issues of every rule, in the order the rules run."""
    found = run_rules(tracks(spark, sf), final_tracks(spark, sf))
    return found.groupBy("rule_no", "rule").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("job").alias("jobs"))


def _timed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    planned = effective(spark, sf)
    times = planned.select("job", "pos", ((F.col("delay_ms") + F.when((F.col("job") + F.col("pos")) % 9 == 0, 5).otherwise(0)) * F.lit(1_000_000) + 400_000).cast("long").alias("first_ns"))
    return planned, final_tracks(spark, sf).join(times, ["job", "pos"])


_TIMED = EFFECTIVE + ", x AS (SELECT e.*, round(((delay_ms + CASE WHEN (job + pos) % 9 = 0 THEN 5 ELSE 0 END) * 1000000 + 400000) / 1e6)::INT AS actual_ms FROM e JOIN final f USING (job, pos))"


@query("audit_audio_sync", oracle("tracks", "final", "delays", body=_TIMED + " SELECT job, pos, type, delay_ms, actual_ms FROM x WHERE type <> 'subtitles' AND abs(actual_ms - delay_ms) > 1".replace("e.*", "e.*")))
def q_audio_sync(spark: SparkSession, sf: str) -> DataFrame:
    return audio_sync(*_timed(spark, sf))


@query("audit_global_shift", oracle("tracks", "final", "delays", body=_TIMED + " SELECT job, pos, (job % 3 * 50)::INT AS expected_ms, actual_ms FROM x WHERE source = 'Source 1' AND type = 'video' AND job % 3 <> 0 AND abs(actual_ms - job % 3 * 50) > 1"))
def q_global_shift(spark: SparkSession, sf: str) -> DataFrame:
    planned, made = _timed(spark, sf)
    return global_shifts(planned, made, job_shift(F.col("job")))


_STREAM = ("CAST(1280 + job % 3 * 320 AS INT) AS width", "CAST(720 + job % 2 * 360 AS INT) AS height", "CASE job % 4 WHEN 0 THEN 'bt709' WHEN 1 THEN 'smpte2084' WHEN 2 THEN 'unknown' ELSE '' END AS color_transfer", "CASE WHEN job % 5 < 3 THEN 'bt2020' ELSE 'bt709' END AS color_primaries", "CASE WHEN job % 3 = 0 THEN 'tv' END AS color_space", "'tv' AS color_range")
_MADE_STREAM = ("CAST(1280 + CASE WHEN job % 10 = 0 THEN 8 ELSE job % 3 * 320 END AS INT) AS width", "CAST(720 + job % 2 * 360 AS INT) AS height", "CASE WHEN job % 8 = 1 THEN 'bt709' ELSE CASE job % 4 WHEN 0 THEN 'bt709' WHEN 1 THEN 'smpte2084' WHEN 2 THEN 'bt709' ELSE '' END END AS color_transfer", "CASE WHEN job % 5 < 2 THEN 'bt2020' ELSE 'bt709' END AS color_primaries", "CASE WHEN job % 6 = 0 THEN 'tv' END AS color_space", "'tv' AS color_range")


def _streams(spark: SparkSession, sf: str, made: bool) -> DataFrame:
    jobs = tracks(spark, sf).select("job").distinct()
    side = F.array(F.lit("Mastering display metadata"), F.lit("Content light level metadata"), F.lit("Stereo 3D"))
    if made:
        side = F.when(F.col("job") % 6 == 0, F.array(F.lit("Mastering display metadata"))).when(F.col("job") % 6 == 1, F.array(F.lit("DOVI configuration record"), F.lit("Mastering display metadata"))).otherwise(side)
    return jobs.selectExpr("job", *(_MADE_STREAM if made else _STREAM)).withColumn("side_data", side)


_STREAMS = f""", jb AS (SELECT DISTINCT job FROM tracks), so AS (SELECT job, {", ".join(_STREAM)}, ['Mastering display metadata', 'Content light level metadata', 'Stereo 3D'] AS side FROM jb),
mo AS (SELECT job, {", ".join(_MADE_STREAM)}, CASE job % 6 WHEN 0 THEN ['Mastering display metadata'] WHEN 1 THEN ['DOVI configuration record', 'Mastering display metadata'] ELSE ['Mastering display metadata', 'Content light level metadata', 'Stereo 3D'] END AS side FROM jb)"""


@query("audit_video_metadata", oracle("tracks", body=_STREAMS + """, j AS (SELECT s.job, s.width AS w, s.height AS h, s.side AS sd, m.width AS mw, m.height AS mh, m.side AS msd, s.color_transfer AS c1, m.color_transfer AS m1, s.color_primaries AS c2, m.color_primaries AS m2, s.color_space AS c3, m.color_space AS m3 FROM so s JOIN mo m USING (job))
SELECT job, 'size' AS field, w || 'x' || h AS expected, mw || 'x' || mh AS actual FROM j WHERE w || 'x' || h <> mw || 'x' || mh UNION ALL SELECT job, 'color_transfer', c1, m1 FROM j WHERE c1 NOT IN ('', 'unknown') AND c1 <> m1
UNION ALL SELECT job, 'color_primaries', c2, m2 FROM j WHERE c2 <> m2 UNION ALL SELECT job, 'color_space', c3, coalesce(m3, '') FROM j WHERE c3 IS NOT NULL AND c3 IS DISTINCT FROM m3
UNION ALL SELECT job, 'side data', d, '' FROM (SELECT job, unnest(sd) AS d, msd FROM j) WHERE (contains(d, 'Mastering') OR contains(d, 'light level')) AND NOT list_contains(msd, d)"""))
def q_video(spark: SparkSession, sf: str) -> DataFrame:
    return video_metadata(_streams(spark, sf, False), _streams(spark, sf, True))


@query("audit_dynamic_range", oracle("tracks", "final", body=_STREAMS + """, hv AS (SELECT job, bool_or(contains(codec, 'HEVC')) AS hevc FROM final GROUP BY 1)
SELECT job, len(side)::INT AS n_side_data FROM mo LEFT JOIN hv USING (job) WHERE NOT coalesce(hevc, false) AND len(side) > 0 AND NOT list_contains(side, 'DOVI configuration record') AND job IN (SELECT job FROM tracks WHERE type = 'video' AND contains(lower(codec), 'hevc'))"""))
def q_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    hevc = final_tracks(spark, sf).groupBy("job").agg(F.bool_or(F.col("codec").contains("HEVC")).alias("has_hevc"))
    streams = _streams(spark, sf, True).join(hevc, "job", "left").withColumn("has_hevc", F.coalesce("has_hevc", F.lit(False)))
    return dynamic_range(tracks(spark, sf), streams)


@query("audit_match_confidence", oracle("tracks", body=", c AS (SELECT DISTINCT job, (job * 37 % 101) / 100.0::DOUBLE AS confidence FROM tracks) SELECT job, confidence, CASE WHEN confidence >= 0.8 THEN 'ok' WHEN confidence >= 0.5 THEN 'warning' ELSE 'issue' END AS tier FROM c"))
def q_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rated = tracks(spark, sf).select("job", (F.col("job") * 37 % 101 / F.lit(100.0)).alias("confidence")).distinct()
    return rated.withColumn("tier", match_tier(F.col("confidence")))


@query("audit_stepping", oracle("tracks", body=""", f AS (SELECT job AS source_key, CASE pos % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM tracks), c AS (SELECT source_key, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM f GROUP BY 1),
s AS (SELECT job AS source_key, count(*) AS segments FROM tracks WHERE type = 'audio' GROUP BY 1) SELECT source_key, high, medium, low, coalesce(segments, 0) AS segments, segments IS NULL AS no_edit_list, high + medium + (segments IS NULL)::INT AS issues FROM c LEFT JOIN s USING (source_key)"""))
def q_stepping(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracks(spark, sf)
    severity = F.when(F.col("pos") % 3 == 0, "high").when(F.col("pos") % 3 == 1, "medium").otherwise("low")
    return stepping_quality(rows.where("type = 'audio'").select(F.col("job").alias("source_key")), rows.select(F.col("job").alias("source_key"), severity.alias("severity")))


@query("audit_attachments", oracle("tracks", body=", p AS (SELECT job, lower('Font' || id || '.TTF') AS name FROM tracks), m AS (SELECT job, lower('font' || id || '.ttf') AS name FROM tracks WHERE (job + id) % 7 <> 0) SELECT job, name FROM p ANTI JOIN m USING (job, name)"))
def q_attachments(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracks(spark, sf)
    made = rows.where((F.col("job") + F.col("id")) % 7 != 0).select("job", F.concat(F.lit("font"), F.col("id").cast("string"), F.lit(".ttf")).alias("file_name"))
    return missing_attachments(rows.select("job", F.concat(F.lit("/x/Font"), F.col("id").cast("string"), F.lit(".TTF")).alias("path")), made)
