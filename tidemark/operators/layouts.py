"""Layouts of jobs: signatures of their tracks, matching and copying, checking saved ones, and reports about jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators.tracks import ordinals
from tidemark.plans.fixtures import jobs, oracle, subs, tracks
from tidemark.plans.registry import query
from tidemark.session import table


def track_signature(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(job, key, n): tracks by source and type; strict: also by codec, language and number among the job's tracks of the type."""
    parts = [F.col("source"), F.col("type")]
    if strict:
        rows = ordinals(rows)
        parts += [F.lower("codec"), F.lower("lang"), F.col("nth").cast("string")]
    return rows.groupBy("job", F.concat_ws("_", *parts).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def auto_apply_signature(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(job, key, n): tracks by source and type; strict: also by language and codec."""
    parts = ["source", "type", *([F.lower("lang"), F.lower("codec")] if strict else [])]
    return rows.groupBy("job", F.concat_ws("_", *parts).alias("key")).agg(F.count(F.lit(1)).alias("n"))


KINDS = ("audio", "subtitles", "video")


def structure_signature(rows: DataFrame) -> DataFrame:
    """(job, structure, hash): each source's tracks by type, in order, as canonical JSON, and its hash. Keys are sorted."""
    item = F.to_json(F.struct(F.col("codec").alias("codec_id"), "id", "lang"))
    lists = rows.groupBy("job", "source").agg(*[F.sort_array(F.collect_list(F.when(F.col("type") == k, F.struct("pos", item.alias("j"))))).alias(k) for k in KINDS])
    inner = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":['), F.array_join(F.transform(k, lambda x: x["j"]), ","), F.lit("]")) for k in KINDS])
    source = F.struct("source", F.concat(F.lit('"'), F.col("source"), F.lit('":{'), inner, F.lit("}")).alias("j"))
    joined = lists.groupBy("job").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(source)), lambda x: x["j"]), ","), F.lit("}")).alias("structure"))
    return joined.withColumn("hash", F.sha2("structure", 256))


def compatible_copies(signatures: DataFrame, saved: DataFrame) -> DataFrame:
    """(job, copied_from): jobs that may take over a saved layout: of the same structure as the first job(job, hash) that has one; those that have their own keep it."""
    first = signatures.join(saved, "job", "left_semi").groupBy("hash").agg(F.min("job").alias("copied_from"))
    return signatures.join(saved, "job", "left_anti").join(first, "hash").select("job", "copied_from")


def pool_match(rows: DataFrame, previous: DataFrame, fields: list[str]) -> DataFrame:
    """Tracks with the fields of the track of the same number among those of source and type in previous, where there is one."""
    order = Window.partitionBy("job", "source", "type").orderBy("pos")
    ours = rows.withColumn("__k", F.row_number().over(order))
    theirs = previous.withColumn("__k", F.row_number().over(order)).select("job", "source", "type", "__k", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("matched"))
    joined = ours.join(theirs, ["job", "source", "type", "__k"], "left")
    return joined.withColumns({f: F.when(F.col("matched"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields} | {"matched": F.coalesce("matched", F.lit(False))}).drop("__k", *[f"__{f}" for f in fields])


#: Fields that a layout and its items must have, and what is said about one that hasn't.
LAYOUT_FIELDS = ("job_id", "sources", "enhanced_layout", "track_signature", "structure_signature")
ITEM_FIELDS = ("source", "id", "type", "user_order_index")


def layout_problem(layout: Column) -> Column:
    """The first thing wrong with a layout as JSON text, or Valid."""
    keys = F.json_object_keys(layout)
    missing = [F.when(~F.array_contains(keys, f), F.lit(f"Missing required field: {f}")) for f in LAYOUT_FIELDS]
    raw = F.get_json_object(layout, "$.enhanced_layout")
    items = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))

    def item_problem(item: Column, i: Column) -> Column:
        own = F.json_object_keys(item)
        lacking = [F.when(~F.array_contains(own, f), F.concat(F.lit("Layout item "), i.cast("string"), F.lit(f" missing required field: {f}"))) for f in ITEM_FIELDS]
        return F.when(own.isNull(), F.concat(F.lit("Layout item "), i.cast("string"), F.lit(" is not a dictionary."))).otherwise(F.coalesce(*lacking))

    first_item = F.get(F.filter(F.transform(items, item_problem), lambda p: p.isNotNull()), F.lit(0))
    return F.when(keys.isNull(), "Layout data is not a dictionary.").otherwise(F.coalesce(*missing, F.when(items.isNull(), "Enhanced layout must be a list."), first_item, F.lit("Valid")))


def upsert(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored(job, layout, seq) after changes(job, layout, seq): the latest of each job counts, and one without a layout deletes it."""
    both = stored.unionByName(changes)
    return both.groupBy("job").agg(F.max_by(F.struct("layout", "seq"), "seq").alias("b")).select("job", "b.layout", "b.seq").where("layout is not null")


def recorded(records: DataFrame) -> DataFrame:
    """(path, key, value) of a document after records(seq, path, value map, merge): a record replaces what its path held, or with merge only the keys it names; the latest value of a key counts."""
    base = records.where(~F.col("merge")).groupBy("path").agg(F.max("seq").alias("from_seq"))
    live = records.join(base, "path", "left").where(F.col("seq") >= F.coalesce("from_seq", F.lit(0)))
    return live.select("path", "seq", F.explode("value").alias("key", "value")).groupBy("path", "key").agg(F.max_by("value", "seq").alias("value"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """Failed jobs, those with issues, those without, all issues, and completed ones."""
    failed = F.col("status") == "Failed"
    return rows.agg(
        F.count_if(failed).alias("failed"), F.count_if(~failed & (F.col("issues") > 0)).alias("warnings"), F.count_if(~failed & (F.col("issues") <= 0)).alias("successful"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues"), F.count_if(~failed).alias("completed"),
    )


def discover(files: DataFrame, reference: str) -> DataFrame:
    """A job for each file (source, name) of the reference's folder, with the files of the same name in the others' folders as a map; missing ones are left out."""
    first = files.where(F.col("source") == reference).select("name")
    others = files.where(F.col("source") != reference).groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "path")))).alias("others"))
    return first.join(others, "name", "left").select("name", F.coalesce("others", F.create_map().cast("map<string,string>")).alias("others"))


def exclusion_preview(rows: DataFrame, styles: list[str], exclude: bool) -> DataFrame:
    """Per track the events that a sync exclusion leaves: those of the styles, or all but those."""
    own = F.count_if(F.col("style").isin(styles))
    return rows.groupBy("track_id").agg((F.count(F.lit(1)) - own if exclude else own).alias("n"))


_T = ("tracks",)
_ITEM = """'{"codec_id":"' || codec || '","id":' || id || ',"lang":"' || lang || '"}'"""
_STRUCTURE = f""", li AS (SELECT job, source, {", ".join(f"coalesce(string_agg({_ITEM}, ',' ORDER BY pos) FILTER (type = '{k}'), '') AS {k}" for k in KINDS)} FROM tracks GROUP BY 1, 2),
st AS (SELECT job, '{{' || string_agg('"' || source || '":{{"audio":[' || audio || '],"subtitles":[' || subtitles || '],"video":[' || video || ']}}', ',' ORDER BY source) || '}}' AS structure FROM li GROUP BY 1), sg AS (SELECT job, structure, sha256(structure) AS hash FROM st)"""


@query("layout_signature", oracle(*_T, body=" SELECT job, source || '_' || type AS key, count(*) AS n FROM tracks GROUP BY 1, 2"))
def q_signature(spark: SparkSession, sf: str) -> DataFrame:
    return track_signature(tracks(spark, sf))


@query("layout_signature_strict", oracle(*_T, body=", o AS (SELECT *, row_number() OVER (PARTITION BY job, type ORDER BY pos) - 1 AS nth FROM tracks) SELECT job, source || '_' || type || '_' || lower(codec) || '_' || lower(lang) || '_' || nth AS key, count(*) AS n FROM o GROUP BY 1, 2"))
def q_strict(spark: SparkSession, sf: str) -> DataFrame:
    return track_signature(tracks(spark, sf), strict=True)


@query("layout_auto_apply", oracle(*_T, body=" SELECT job, source || '_' || type || '_' || lower(lang) || '_' || lower(codec) AS key, count(*) AS n FROM tracks GROUP BY 1, 2"))
def q_auto(spark: SparkSession, sf: str) -> DataFrame:
    return auto_apply_signature(tracks(spark, sf), strict=True)


@query("layout_structure", oracle(*_T, body=_STRUCTURE + " SELECT job, structure, hash FROM sg"))
def q_structure(spark: SparkSession, sf: str) -> DataFrame:
    return structure_signature(tracks(spark, sf))


@query("layout_copies", oracle(*_T, body=_STRUCTURE.replace("FROM tracks", "FROM (SELECT * REPLACE (1 AS id, 'x' AS lang) FROM tracks)") + ", fi AS (SELECT hash, min(job) AS copied_from FROM sg WHERE job % 3 = 0 GROUP BY 1) SELECT job, copied_from FROM sg JOIN fi USING (hash) WHERE job % 3 <> 0"))
def q_copies(spark: SparkSession, sf: str) -> DataFrame:
    """With ids and languages made alike, so that structures repeat; every third job has a layout."""
    rows = tracks(spark, sf).withColumns({"id": F.lit(1), "lang": F.lit("x")})
    return compatible_copies(structure_signature(rows).select("job", "hash"), rows.where("job % 3 = 0").select("job").distinct())


@query("layout_pool_match", oracle(*_T, body=""", o AS (SELECT *, row_number() OVER (PARTITION BY job, source, type ORDER BY pos) AS k FROM tracks), p AS (SELECT job + 1 AS job, source, type, k, custom_name, is_default FROM o)
SELECT o.job, o.pos, CASE WHEN p.job IS NOT NULL THEN p.custom_name ELSE o.custom_name END AS custom_name, CASE WHEN p.job IS NOT NULL THEN p.is_default ELSE o.is_default END AS is_default, p.job IS NOT NULL AS matched FROM o LEFT JOIN p USING (job, source, type, k)"""))
def q_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Each job with the layout of the one before."""
    rows = tracks(spark, sf)
    return pool_match(rows, rows.withColumn("job", F.col("job") + 1), ["custom_name", "is_default"]).select("job", "pos", "custom_name", "is_default", "matched")


def _json_fields(**fields: str) -> str:
    """A JSON object of fields as SQL text; those that are null are left out."""
    return "'{' || concat_ws(', ', " + ", ".join(f"'\"{name}\": ' || {value}" for name, value in fields.items()) + ") || '}'"


_WRITTEN = "CASE WHEN is_corrected THEN '7' ELSE " + _json_fields(source="CASE WHEN NOT is_preserved THEN '\"' || source || '\"' END", id="CASE WHEN custom_name = '' THEN CAST(id AS STRING) END", type="CASE WHEN NOT frame_adjusted THEN '\"' || type || '\"' END", user_order_index="CASE WHEN custom_lang = '' THEN CAST(pos AS STRING) END") + " END"


@query("layout_validation", oracle(*_T, body=""", i AS (SELECT job, pos, CASE WHEN is_corrected THEN 'is not a dictionary.' WHEN is_preserved THEN 'missing required field: source' WHEN custom_name <> '' THEN 'missing required field: id' WHEN frame_adjusted THEN 'missing required field: type' WHEN custom_lang <> '' THEN 'missing required field: user_order_index' END AS p FROM tracks),
j AS (SELECT job, count(*) AS n, bool_or(is_forced AND pos = 0) AS listed, bool_or(source = 'Source 1') AS has_source, bool_or(type = 'audio') AS has_audio, bool_or(lang = 'und' AND pos = 0) AS unnamed FROM tracks GROUP BY 1),
f AS (SELECT job, arg_min(p, pos) AS p, min(pos) AS pos FROM i WHERE p IS NOT NULL GROUP BY 1)
SELECT job, CASE WHEN listed THEN 'Layout data is not a dictionary.' WHEN unnamed THEN 'Missing required field: job_id' WHEN NOT has_source THEN 'Missing required field: sources' WHEN n = 2 THEN 'Missing required field: enhanced_layout' WHEN NOT has_audio THEN 'Missing required field: track_signature' WHEN n = 6 THEN 'Missing required field: structure_signature'
  WHEN n = 1 THEN 'Enhanced layout must be a list.' WHEN p IS NOT NULL THEN 'Layout item ' || f.pos || ' ' || p ELSE 'Valid' END AS problem FROM j LEFT JOIN f USING (job)"""))
def q_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts written from the tracks of jobs, in which what tracks lack is lacking."""
    items = tracks(spark, sf).select("job", "pos", "source", "type", "lang", "is_forced", F.expr(_WRITTEN).alias("item"))
    first = F.col("pos") == 0
    made = items.groupBy("job").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("is_forced") & first).alias("listed"), F.bool_or(F.col("source") == "Source 1").alias("has_source"), F.bool_or(F.col("type") == "audio").alias("has_audio"), F.bool_or((F.col("lang") == "und") & first).alias("unnamed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ", ").alias("items"),
    )
    layout = _json_fields(job_id="CASE WHEN NOT unnamed THEN CAST(job AS STRING) END", sources="CASE WHEN has_source THEN '{}' END", enhanced_layout="CASE n WHEN 2 THEN NULL WHEN 1 THEN items ELSE '[' || items || ']' END", track_signature="CASE WHEN has_audio THEN '1' END", structure_signature="CASE WHEN n <> 6 THEN '2' END")
    return made.select("job", layout_problem(F.expr(f"CASE WHEN listed THEN '[1]' ELSE {layout} END")).alias("problem"))


@query("job_ids", oracle(*_T, body=""", s AS (SELECT DISTINCT job, source FROM tracks) SELECT job, sha256(string_agg(source || ':ep' || job % 50 || '.mkv', '|' ORDER BY source))[1:16] AS job_id FROM s GROUP BY 1"""))
def q_ids(spark: SparkSession, sf: str) -> DataFrame:
    """ids by the names of the sources' files."""
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/ep"), (F.col("job") % 50).cast("string"), F.lit(".mkv"))
    sources = tracks(spark, sf).select("job", F.struct(F.col("source").alias("key"), path.alias("path")).alias("s")).distinct().groupBy("job").agg(F.collect_list("s").alias("sources"))
    return sources.select("job", texts.job_id(F.col("sources")).alias("job_id"))


@query("job_discovery", """WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Source 1' WHEN 1 THEN 'Source 2' WHEN 2 THEN 'Source 3' ELSE 'Source 1' END AS source, 'ep' || p_partkey % 700 || '.mkv' AS name FROM part GROUP BY 1, 2)
SELECT a.name, (SELECT coalesce(string_agg(source || '=' || '/' || source || '/' || name, ',' ORDER BY source), '') FROM f b WHERE b.name = a.name AND b.source <> 'Source 1') AS others FROM f a WHERE a.source = 'Source 1'""")
def q_discovery(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    files = table(spark, sf, "part").select(F.when(k == 1, "Source 2").when(k == 2, "Source 3").otherwise("Source 1").alias("source"), F.concat(F.lit("ep"), (F.col("p_partkey") % 700).cast("string"), F.lit(".mkv")).alias("name")).distinct()
    found = discover(files.withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), "name")), "Source 1")
    return found.select("name", F.array_join(F.transform(F.map_entries("others"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("others"))


@query("job_layouts", oracle("jobs", "tracks", body=""", l AS (SELECT job, string_agg(id || ':' || type, ',' ORDER BY l_order, pos) AS items FROM (SELECT *, (pos * 5) % 7 AS l_order FROM tracks WHERE job % 2 = 0) GROUP BY 1) SELECT job_id, status, items, items IS NOT NULL AS configured FROM jobs LEFT JOIN l ON job = job_id"""))
def q_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with their saved layout's items in the user's order; jobs without one have none."""
    saved = tracks(spark, sf).where("job % 2 = 0").withColumn("user_order", F.col("pos") * 5 % 7)
    items = saved.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("user_order", "pos", "id", "type"))).alias("items"))
    listed = items.select("job", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["id"].cast("string"), i["type"])), ",").alias("items"))
    return jobs(spark, sf).join(listed, F.col("job") == F.col("job_id"), "left").select("job_id", "status", "items", F.col("items").isNotNull().alias("configured"))


@query("job_summary", oracle("jobs", body=" SELECT count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status <> 'Failed' AND issues > 0) AS warnings, count(*) FILTER (status <> 'Failed' AND issues = 0) AS successful, sum(issues)::BIGINT AS total_issues, count(*) FILTER (status <> 'Failed') AS completed FROM jobs"))
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A22, A39."""
    return batch_summary(jobs(spark, sf))


@query("job_lines", oracle("jobs", body=""" SELECT job_id, CASE WHEN status = 'Failed' THEN 'Failed' WHEN issues > 0 THEN 'Warning (' || issues || CASE WHEN issues <> 1 THEN ' issues)' ELSE ' issue)' END ELSE 'Success' END AS status_text,
  CASE WHEN job_id % 4 = 0 THEN '-' ELSE 'S2: ' || printf('%+d', job_id % 500 - 250) || 'ms, S3: ' || printf('%+d', job_id % 7) || 'ms' END AS delays_text FROM jobs"""))
def q_lines(spark: SparkSession, sf: str) -> DataFrame:
    """F40."""
    job = F.col("job_id")
    delays = F.array(F.struct(F.lit("Source 3").alias("source"), (job % 7).alias("ms")), F.struct(F.lit("Source 2").alias("source"), (job % 500 - 250).alias("ms")))
    delays = F.when(job % 4 == 0, F.slice(delays, 1, 0)).otherwise(delays)
    return jobs(spark, sf).select("job_id", texts.status_summary(F.col("status"), F.col("issues")).alias("status_text"), texts.delays_summary(delays).alias("delays_text"))


_STORED = """, s AS (SELECT job_id AS job, 'a' || issues AS layout, 1 AS seq FROM jobs WHERE job_id % 2 = 0), c AS (SELECT job_id AS job, CASE WHEN job_id % 3 = 0 THEN NULL ELSE 'b' || issues END AS layout, 2 AS seq FROM jobs WHERE job_id % 5 = 0)"""


@query("layout_store", oracle("jobs", body=_STORED + " SELECT job, layout, seq FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS k FROM (SELECT * FROM s UNION ALL SELECT * FROM c)) WHERE k = 1 AND layout IS NOT NULL"))
def q_store(spark: SparkSession, sf: str) -> DataFrame:
    """K13."""
    rows = jobs(spark, sf)
    text = F.col("issues").cast("string")
    stored = rows.where("job_id % 2 = 0").select(F.col("job_id").alias("job"), F.concat(F.lit("a"), text).alias("layout"), F.lit(1).alias("seq"))
    changes = rows.where("job_id % 5 = 0").select(F.col("job_id").alias("job"), F.when(F.col("job_id") % 3 != 0, F.concat(F.lit("b"), text)).alias("layout"), F.lit(2).alias("seq"))
    return upsert(stored, changes)


@query("audit_document", """WITH r AS (SELECT event_id AS seq, event_type || '.u' || user_id % 5 AS path, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events),
b AS (SELECT path, max(seq) AS from_seq FROM r WHERE k % 10 = 0 GROUP BY 1), v AS (SELECT r.path, seq, 'k' || k % 4 AS key, k AS value FROM r LEFT JOIN b USING (path) WHERE seq >= coalesce(from_seq, 0) UNION ALL SELECT r.path, seq, 'last', k FROM r LEFT JOIN b USING (path) WHERE seq >= coalesce(from_seq, 0))
SELECT path, key, arg_max(value, seq)::VARCHAR AS value FROM v GROUP BY 1, 2""")
def q_document(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records of a document, every tenth a replacement."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.col("event_type"), F.lit(".u"), (F.col("user_id") % 5).cast("string"))
    value = F.create_map(F.concat(F.lit("k"), (k % 4).cast("string")), k.cast("string"), F.lit("last"), k.cast("string"))
    return recorded(table(spark, sf, "events").select(F.col("event_id").alias("seq"), path.alias("path"), value.alias("value"), (k % 10 != 0).alias("merge")))


@query("sync_exclusions", oracle("subs", body=" SELECT track_id, count(*) FILTER (style IN ('user', 'system')) AS included, count(*) - count(*) FILTER (style IN ('user', 'system')) AS excluded FROM subs GROUP BY 1"))
def q_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """A40, both ways."""
    rows = subs(spark, sf)
    first, other = (exclusion_preview(rows, ["user", "system"], e).withColumnRenamed("n", n) for e, n in ((False, "included"), (True, "excluded")))
    return first.join(other, "track_id")
