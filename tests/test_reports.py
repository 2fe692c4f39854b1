"""Job reports batch by batch, and stepping documents sound and damaged."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources.stepping import load_stepping, save_stepping, stepping_clusters, stepping_documents, stepping_windows
from tidemark.streaming.reports import JobReport, load_report


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "job_id long, status string, issues int")


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "report")
    report = JobReport(spark, path).create("one", 5)
    assert report.jobs().count() == 0 and report.finalise() == {"successful": 0, "warnings": 0, "failed": 0, "total_issues": 0}
    report.add(batch(spark, (1, "Merged", 0), (2, "Failed", 4)), 0)
    report.add(batch(spark, (3, None, 2)), 1)
    report.add(batch(spark, (9, "Merged", 9)), 0)
    again = JobReport(spark, path).create("another name", 1)
    again.add(batch(spark, (9, "Merged", 9)), 1)
    assert again.finalise() == {"successful": 1, "warnings": 1, "failed": 1, "total_issues": 6}
    header, jobs = load_report(spark, path)
    assert header["batch_name"] == "one" and header["finalized_at"] and header["summary"]["total_issues"] == 6
    assert sorted((r.job_id, r.name, r.status, r.issues, r.batch) for r in jobs.collect()) == [(1, "Unknown", "Merged", 0, 0), (2, "Unknown", "Failed", 4, 0), (3, "Unknown", "Unknown", 2, 1)]
    assert sorted(p.name for p in (tmp_path / "report").iterdir() if not p.name.startswith(".")) == ["jobs", "report.json"]


def test_a_batch_that_failed_half_way_is_added_whole_later(spark, tmp_path):
    path = str(tmp_path)
    report = JobReport(spark, path).create("one", 2)
    broken = batch(spark, (1, "Merged", 0)).withColumn("status", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        report.add(broken, 0)
    assert report.jobs().count() == 0
    report.add(batch(spark, (1, "Merged", 0)), 0)
    assert report.jobs().count() == 1 and report.finalise()["successful"] == 1 and not (tmp_path / "_staging").exists()


def test_reports_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(ValueError, match="failed to read"):
        load_report(spark, str(tmp_path))
    (tmp_path / "report.json").write_text("{")
    with pytest.raises(ValueError, match="failed to parse"):
        load_report(spark, str(tmp_path))


WINDOWS = [("a b", 1, 2, 10, 10.25, 88.0, 2.0, True), ("a b", 1, 1, -5, -5.125, 12.5, 0.0, False), ("c", 2, 1, 0, 0.1, 1e-9, 1e12, True)]
CLUSTERS = [("a b", 1, 0, 10.0, 0.0, 1, [2], [10.25], [2.0, 2.0], 88.0, 88.0)]


def test_documents_are_kept_and_reloaded(spark, tmp_path):
    windows = spark.createDataFrame(WINDOWS, "source_key string, track_id int, window_idx int, delay_ms int, raw_delay_ms double, match_pct double, start_s double, accepted boolean")
    clusters = spark.createDataFrame(CLUSTERS, "source_key string, track_id int, cluster_id int, mean_delay_ms double, std_delay_ms double, chunk_count long, chunk_numbers array<int>, raw_delays array<double>, time_range array<double>, mean_match_pct double, min_match_pct double")
    save_stepping(stepping_documents(windows, clusters), str(tmp_path))
    loaded = load_stepping(spark, str(tmp_path))
    assert dict(loaded.dtypes)["document"] == "variant" and loaded.where("problem IS NOT NULL").count() == 0
    assert sorted(tuple(r) for r in stepping_windows(loaded).collect()) == sorted(WINDOWS)
    assert [tuple(r) for r in stepping_clusters(loaded).collect()] == CLUSTERS
    assert {r.source_key: len(r.clusters) for r in loaded.collect()} == {"a b": 1, "c": 0}


def document(**changes):
    window = {"delay_ms": 1, "raw_delay_ms": 1.5, "match_pct": 50, "start_s": 0, "accepted": True}
    return {"source_key": "a", "track_id": 1, "windows": [window], "clusters": []} | changes


def test_damaged_documents_are_reported_and_kept(spark, tmp_path):
    window = document()["windows"][0]
    given = {
        None: document(), "no JSON": '{"source_key": "a', "a version that isn't known": document(version=3), "no source or track": document(track_id="x"), "no list of windows": document(windows=None),
        "no list of clusters": {k: v for k, v in document().items() if k != "clusters"}, "windows without all fields of their types": document(windows=[window, {"delay_ms": 1}]),
        "clusters without all fields of their types": document(clusters=[{"cluster_id": 1}]),
    }
    of_types = [document(windows=[window | {"accepted": [1]}]), document(windows=[7])]
    texts = [(v if isinstance(v, str) else json.dumps(v),) for v in [*given.values(), *of_types]]
    save_stepping(spark.createDataFrame(texts, "text string"), str(tmp_path))
    rows = load_stepping(spark, str(tmp_path)).select("problem", "corrupt", F.to_json("document").alias("document"), F.size("windows").alias("n")).collect()
    assert sorted((r.problem for r in rows), key=str) == sorted([*given, *["windows without all fields of their types"] * 2], key=str) and all((r.corrupt is None) != (r.problem == "no JSON") for r in rows)
    assert all((r.n == 1) == (r.problem is None) and (r.document is None) == (r.problem == "no JSON") for r in rows)


def test_fields_that_are_not_known_stay(spark, tmp_path):
    texts = [(json.dumps(document(version=v, note={"by": "hand"}, windows=[document()["windows"][0] | {"more": 7}])),) for v in (1, 2)]
    save_stepping(spark.createDataFrame(texts, "text string"), str(tmp_path))
    loaded = load_stepping(spark, str(tmp_path))
    assert [tuple(r) for r in loaded.select("problem", F.variant_get("document", "$.note.by", "string"), F.variant_get("document", "$.windows[0].more", "int")).collect()] == [(None, "hand", 7)] * 2
