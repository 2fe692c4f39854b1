"""Views over the driver tables that feed the queries, as DataFrames and, word for word the same, as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import spread, table

def micros_since(day: str, column: str) -> Column:
    """Microseconds from a day's start to a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(day).cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def r6(column: Column) -> Column:
    """Six decimals without a negative zero, as every double of a result is given."""
    return F.round(column, 6) + F.lit(0.0)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Scored signal windows: (source_key, window_idx, start_s, raw_delay_ms, delay_ms, match_pct, accepted, method)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pct = F.get_json_object("props", "$.k").cast("double")
    numbered = spread(spark, sf, "events", "user_id").withColumn("window_idx", F.row_number().over(order))  # before the key is renamed, as in tracks()
    return numbered.select(
        F.col("user_id").alias("source_key"), "window_idx",
        (micros_since("2024-01-01", "ts") / 1e6).alias("start_s"), F.col("value").alias("raw_delay_ms"),
        F.round("value").cast("int").alias("delay_ms"), pct.alias("match_pct"), (pct >= 10).alias("accepted"), F.col("event_type").alias("method"),
    )


def subs(spark: SparkSession, sf: str) -> DataFrame:
    """Timed text events: (track_id, idx, start_ms, end_ms, text, style, layer, is_comment)."""
    start = F.col("turn") * F.lit(2002.002)
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("track_id"), F.col("turn").alias("idx"), start.alias("start_ms"), (start + F.length("text") * F.lit(40.0)).alias("end_ms"),
        "text", F.col("role").alias("style"), (F.col("turn") % 2).cast("int").alias("layer"), (F.col("role") == "system").alias("is_comment"),
    )


def edl(spark: SparkSession, sf: str) -> DataFrame:
    """Edit lists: windows 1, n/3 and 2n/3 of each source as (source_key, start_s, delay_ms, delay_raw)."""
    w = windows(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_key")))
    picked = w.where((F.col("window_idx") == 1) | (F.col("window_idx") == F.floor(F.col("n") / 3)) | (F.col("window_idx") == F.floor(2 * F.col("n") / 3)))
    return picked.select("source_key", "start_s", "delay_ms", F.col("raw_delay_ms").alias("delay_raw"))


#: Columns of the track plans, in expressions that both engines read: an order is a job, its lines are the tracks.
PLAN = (
    "l_orderkey AS job",
    "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos",
    "CASE l_suppkey % 4 WHEN 0 THEN 'Source 1' WHEN 1 THEN 'Source 2' WHEN 2 THEN 'Source 3' ELSE 'External' END AS source",
    "CAST(l_linenumber AS INT) AS id",
    "CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'N' THEN 'video' ELSE 'subtitles' END AS type",
    """CASE l_returnflag WHEN 'A' THEN CASE l_partkey % 6 WHEN 0 THEN 'A_AAC' WHEN 1 THEN 'A_FLAC' WHEN 2 THEN 'A_AC3' WHEN 3 THEN 'A_TRUEHD' WHEN 4 THEN 'A_EAC3' ELSE 'A_PCM/INT/LIT' END
      WHEN 'N' THEN CASE l_partkey % 3 WHEN 0 THEN 'V_MPEGH/ISO/HEVC' WHEN 1 THEN 'V_MPEG4/ISO/AVC' ELSE 'V_AV1' END
      ELSE CASE l_partkey % 4 WHEN 0 THEN 'S_TEXT/ASS' WHEN 1 THEN 'S_TEXT/UTF8' WHEN 2 THEN 'S_HDMV/PGS' ELSE 'S_VOBSUB' END END AS codec""",
    "CASE l_partkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'jpn' WHEN 2 THEN 'deu' ELSE 'und' END AS lang",
    "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'Track ' || CAST(l_partkey % 10 AS STRING) END AS name",
    "l_linenumber = 1 AS is_default", "l_partkey % 7 = 0 AS is_forced",
    "CASE WHEN l_partkey % 11 = 0 THEN 'fra' ELSE '' END AS custom_lang", "CASE WHEN l_partkey % 13 = 0 THEN 'Custom' ELSE '' END AS custom_name", "l_partkey % 2 = 0 AS apply_name",
    "CAST(l_partkey % 401 - 200 AS INT) AS container_ms", "CASE WHEN l_suppkey % 4 = 3 AND l_partkey % 2 = 1 THEN 'Source 2' END AS sync_to",
    "l_returnflag = 'R' AND l_partkey % 9 = 0 AS stepping_adjusted", "l_returnflag = 'R' AND l_partkey % 10 = 0 AS frame_adjusted", "l_returnflag <> 'N' AND l_partkey % 6 = 5 AS is_preserved",
    "l_returnflag = 'R' AND l_partkey % 12 = 9 AS convert_to_ass", "l_returnflag = 'R' AND l_partkey % 12 IN (2, 7) AS perform_ocr", "l_returnflag = 'A' AND l_partkey % 8 = 3 AS is_corrected",
    "CAST(CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 8 ELSE 3 END AS INT) AS channels", "CASE WHEN l_partkey % 2 = 0 THEN '48000' ELSE '44100' END AS rate",
    "CASE l_partkey % 3 WHEN 0 THEN '16' WHEN 1 THEN '24' END AS bits",
)
#: Columns of the tracks that came out: the plan's, some of them changed, and a few jobs' last track missing.
FINAL = (
    "job", "pos", "CASE WHEN h = 6 THEN 'other' ELSE type END AS type",
    "CASE WHEN h = 0 THEN 'X_OTHER' WHEN convert_to_ass THEN 'S_TEXT/ASS' WHEN perform_ocr THEN 'S_TEXT/UTF8' ELSE codec END AS codec",
    "CASE WHEN h = 1 THEN 'xxx' WHEN custom_lang <> '' THEN custom_lang ELSE lang END AS lang", "CASE WHEN h = 1 AND job % 2 = 0 THEN CASE WHEN custom_lang <> '' THEN custom_lang ELSE lang END ELSE '' END AS lang_ietf",
    "CASE WHEN h = 4 THEN 'Other' WHEN custom_name <> '' THEN custom_name WHEN apply_name THEN name ELSE '' END AS name",
    "CASE WHEN h = 2 THEN NOT is_default ELSE is_default END AS is_default", "CASE WHEN h = 3 THEN NOT is_forced ELSE is_forced END AS is_forced",
    "CAST(CASE WHEN h = 7 THEN channels + 1 ELSE channels END AS INT) AS channels", "CASE WHEN h = 8 THEN '96000' ELSE rate END AS rate", "CASE WHEN h = 9 THEN '8' ELSE bits END AS bits", "h",
)


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Planned tracks of jobs: (job, pos, source, id, type, codec, lang, name, ...)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = spread(spark, sf, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    # numbered before the key is renamed, so that Spark knows the rows to lie by job
    numbered = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
    return numbered.selectExpr(*["pos" if c.endswith(" AS pos") else c for c in PLAN])


def final_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of the files that came out: (job, pos, type, codec, lang, lang_ietf, name, is_default, ...)."""
    planned = tracks(spark, sf).withColumns({"h": F.expr("CAST((job * 31 + pos * 7) % 17 AS INT)"), "__n": F.count(F.lit(1)).over(Window.partitionBy("job"))})
    return planned.where("NOT (job % 19 = 0 AND pos = __n - 1)").selectExpr(*FINAL)


def job_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Delays of jobs' sources: (job, source, delay_ms, subtitle_ms)."""
    each = spread(spark, sf, "orders", "o_orderkey", like="lineitem").select(F.col("o_orderkey").alias("job"), F.explode(F.array(*map(F.lit, ("Source 1", "Source 2", "Source 3")))).alias("source"))
    return each.selectExpr("job", "source", "CAST(CASE source WHEN 'Source 1' THEN 0 WHEN 'Source 2' THEN job % 500 - 250 ELSE job * 7 % 900 - 450 END AS INT) AS delay_ms", "CASE WHEN source = 'Source 3' AND job % 5 = 0 THEN job % 100 + 0.25D END AS subtitle_ms")


def job_shift(job: Column) -> Column:
    """The global shift of a job in ms."""
    return (job % 3 * 50).cast("int")


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter starts: (track, id, start_ns)."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("id"), (micros_since("1995-01-01", "o_orderdate") * 1000).alias("start_ns"))


def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframe times: (track, key_ns)."""
    items = table(spark, sf, "lineitem").select("l_orderkey", (micros_since("1995-01-01", "l_shipdate") * 1000).alias("key_ns"))
    return items.join(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("track")), F.col("l_orderkey") == F.col("o_orderkey")).select("track", "key_ns").distinct()


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of two clips: (clip, frame_idx, feature, hash64), the hash the sign bits of the feature."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 2).cast("int").alias("clip"), F.floor(F.col("vec_id") / 2).alias("frame_idx"), F.col("embedding").alias("feature"), bits.alias("hash64"))


def pcm(spark: SparkSession, sf: str) -> DataFrame:
    """Samples: (signal, sample_idx from 0, value in [0, 1]). Samples are numbered inside each hour of a signal, and hours by their counts, so that no task holds a whole signal."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("signal"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "value")
    top = e.agg(F.max("value").alias("top"))
    hours = e.groupBy("signal", "hour").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("signal").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("signal", "hour").orderBy("ts", "event_id")) - 1
    placed = e.withColumn("own", own).join(hours.select("signal", "hour", before.alias("before")), ["signal", "hour"])
    return placed.crossJoin(F.broadcast(top)).select("signal", (F.col("before") + F.col("own")).cast("long").alias("sample_idx"), (F.col("value") / F.col("top")).alias("value"))  # top is one row


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs: (job_id, owner, status, issues)."""
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Merged").otherwise("Analyzed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), status.alias("status"), (F.col("o_orderkey") % 3).cast("int").alias("issues"))


CTES = {
    "windows": """windows AS (
  SELECT user_id AS source_key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS window_idx,
         (epoch_us(ts) - 1704067200000000) / 1e6 AS start_s, value AS raw_delay_ms, round(value)::INT AS delay_ms,
         json_extract_string(props, '$.k')::DOUBLE AS match_pct, json_extract_string(props, '$.k')::DOUBLE >= 10 AS accepted, event_type AS method
  FROM events)""",
    "subs": """subs AS (
  SELECT conv_id AS track_id, turn AS idx, turn * 2002.002::DOUBLE AS start_ms, turn * 2002.002::DOUBLE + length(text) * 40.0::DOUBLE AS end_ms,
         text, role AS style, (turn % 2)::INT AS layer, role = 'system' AS is_comment FROM conversations)""",
    "edl": """edl AS (
  SELECT source_key, start_s, delay_ms, raw_delay_ms AS delay_raw FROM (SELECT *, count(*) OVER (PARTITION BY source_key) AS n FROM windows)
  WHERE window_idx = 1 OR window_idx = floor(n / 3) OR window_idx = floor(2 * n / 3))""",
    "tracks": "tracks AS (SELECT " + ", ".join(PLAN) + " FROM lineitem)",
    "final": "final AS (SELECT " + ", ".join(FINAL) + " FROM (SELECT *, CAST((job * 31 + pos * 7) % 17 AS INT) AS h, count(*) OVER (PARTITION BY job) AS n FROM tracks) WHERE NOT (job % 19 = 0 AND pos = n - 1))",
    "delays": """jdelays AS (SELECT job, source, CAST(CASE source WHEN 'Source 1' THEN 0 WHEN 'Source 2' THEN job % 500 - 250 ELSE job * 7 % 900 - 450 END AS INT) AS delay_ms, CASE WHEN source = 'Source 3' AND job % 5 = 0 THEN job % 100 + 0.25::DOUBLE END AS subtitle_ms
  FROM (SELECT o_orderkey AS job, unnest(['Source 1', 'Source 2', 'Source 3']) AS source FROM orders))""",
    "chapters": """chapters AS (
  SELECT o_custkey AS track, o_orderkey AS id, (epoch_us(o_orderdate) - 788918400000000) * 1000 AS start_ns FROM orders)""",
    "keyframes": """keyframes AS (
  SELECT DISTINCT o_custkey AS track, (epoch_us(l_shipdate) - 788918400000000) * 1000 AS key_ns FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "frames": """frames AS (
  SELECT (vec_id % 2)::INT AS clip, vec_id // 2 AS frame_idx, embedding AS feature,
         list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (CASE WHEN i = 1 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (64 - i)::HUGEINT END) ELSE 0::HUGEINT END))::BIGINT AS hash64
  FROM embeddings)""",
    "pcm": """pcm AS (
  SELECT event_type AS signal, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::BIGINT AS sample_idx,
         value / (SELECT max(value) FROM events) AS value FROM events)""",
    "jobs": """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS owner,
         CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Merged' ELSE 'Analyzed' END AS status, (o_orderkey % 3)::INT AS issues FROM orders)""",
}


def oracle(*names: str, body: str) -> str:
    """body behind the CTEs of the named views."""
    return "WITH " + ",\n".join(CTES[n] for n in names) + body
