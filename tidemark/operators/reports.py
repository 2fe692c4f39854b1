"""Queries of reports and stepping data that are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clusters import _LABEL, _accepted, cluster_details, clustered_windows
from tidemark.plans.fixtures import jobs, oracle, r6, windows
from tidemark.plans.registry import query
from tidemark.session import shared_path
from tidemark.sources.stepping import load_stepping, save_stepping, stepping_clusters, stepping_documents, stepping_windows
from tidemark.streaming.reports import JobReport, load_report


@query("job_report", oracle("jobs", body=""" SELECT 'jobs' AS part, status, count(*) AS n, sum(issues)::BIGINT AS issues FROM jobs GROUP BY 2
UNION ALL SELECT 'summary', unnest(['failed', 'successful', 'warnings']), unnest([count(*) FILTER (status = 'Failed'), count(*) FILTER (status <> 'Failed' AND issues = 0), count(*) FILTER (status <> 'Failed' AND issues > 0)]), sum(issues)::BIGINT FROM jobs"""))
def q_report(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs as a stream of four files, a batch each; the stream is run again and a batch is handed over once more before the report is finalised, and the loaded report is counted."""
    folder, path = shared_path(spark, "job-stream"), shared_path(spark, "job-report")
    rows = jobs(spark, sf).select("job_id", F.concat(F.lit("job "), F.col("job_id").cast("string")).alias("name"), "status", "issues")
    rows.repartition(4, "job_id").write.parquet(folder)
    report = JobReport(spark, path).create("all jobs", rows.count())
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        stream.writeStream.foreachBatch(report.add).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    report.add(rows, 0)
    report.finalise()
    header, loaded = load_report(spark, path)
    counted = loaded.groupBy(F.lit("jobs").alias("part"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("issues").alias("issues"))
    summary = [("summary", k, header["summary"][k], header["summary"]["total_issues"]) for k in ("failed", "successful", "warnings")]
    return counted.unionByName(spark.createDataFrame(summary, "part string, status string, n long, issues long"))


def _reloaded(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of all sources, saved and loaded, with a damaged row among them; a source's track is its number modulo three."""
    track = (F.col("source_key") % 3).cast("int")
    found = cluster_details(clustered_windows(_accepted(spark, sf)))
    labelled = clustered_windows(_accepted(spark, sf)).where("label >= 0").groupBy("source_key", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("window_idx", "raw_delay_ms"))), lambda x: x["raw_delay_ms"]).alias("raw_delays"))
    clusters = found.join(labelled, ["source_key", "label"]).select(
        "source_key", track.alias("track_id"), F.col("label").alias("cluster_id"), F.col("mean_ms").alias("mean_delay_ms"), F.col("std_ms").alias("std_delay_ms"), F.col("n").alias("chunk_count"), F.col("members").alias("chunk_numbers"),
        "raw_delays", F.array("t0", "t1").alias("time_range"), F.col("avg_match").alias("mean_match_pct"), F.col("min_match").alias("min_match_pct"),
    )
    path = shared_path(spark, "stepping")
    save_stepping(stepping_documents(windows(spark, sf).withColumn("track_id", track), clusters), path)
    save_stepping(spark.createDataFrame([('{"version": 2, "source_key": "cut o',)], "text string"), path)
    return load_stepping(spark, path)


@query("stepping_windows", oracle("windows", body=""" SELECT source_key::VARCHAR AS source_key, (source_key % 3)::INT AS track_id, window_idx, delay_ms, round(raw_delay_ms, 6) + 0.0 AS raw_delay_ms, match_pct, round(start_s, 6) + 0.0 AS start_s, accepted, NULL AS problem FROM windows
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no JSON'"""))
def q_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of every source after a round through documents, and what was damaged."""
    loaded = _reloaded(spark, sf)
    rows = stepping_windows(loaded).withColumns({"raw_delay_ms": r6(F.col("raw_delay_ms")), "start_s": r6(F.col("start_s")), "problem": F.lit(None).cast("string")})
    return rows.unionByName(loaded.where("problem IS NOT NULL").select("source_key", "track_id", "problem"), allowMissingColumns=True)


@query("stepping_clusters", oracle("windows", body=_LABEL + """ SELECT source_key::VARCHAR AS source_key, (source_key % 3)::INT AS track_id, label AS cluster_id, round(avg(delay_ms), 6) + 0.0 AS mean_delay_ms, round(stddev_pop(delay_ms), 6) + 0.0 AS std_delay_ms, count(*) AS chunk_count,
  string_agg(window_idx, ',' ORDER BY window_idx) AS chunk_numbers, round(sum(raw_delay_ms), 4) + 0.0 AS raw_sum, round(min(start_s), 6) + 0.0 AS t0, round(max(start_s), 6) + 0.0 AS t1, round(avg(match_pct), 6) + 0.0 AS mean_match_pct, min(match_pct) AS min_match_pct FROM lab WHERE label >= 0 GROUP BY ALL"""))
def q_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters of every source after a round through documents."""
    rows = stepping_clusters(_reloaded(spark, sf))
    total = F.aggregate("raw_delays", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "source_key", "track_id", "cluster_id", *[r6(F.col(c)).alias(c) for c in ("mean_delay_ms", "std_delay_ms", "mean_match_pct")], "chunk_count", F.array_join(F.col("chunk_numbers").cast("array<string>"), ",").alias("chunk_numbers"),
        (F.round(total, 4) + 0.0).alias("raw_sum"), r6(F.col("time_range")[0]).alias("t0"), r6(F.col("time_range")[1]).alias("t1"), "min_match_pct",
    )
