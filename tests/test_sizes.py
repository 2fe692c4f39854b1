"""Queries whose tasks, shuffles and files must not grow faster than their tables."""

from __future__ import annotations

import pytest
from compare import check, connect

import __spark_entry__
from tidemark import session
from tidemark.sources.staged import register


def plan(spark, sf, name):
    return __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution()


def exchanges(spark, sf, name):
    """Shuffles by hash of a query before it runs."""
    return [x for x in plan(spark, sf, name).executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_all_rules_meet_both_sides_once(spark, tiny):
    # lineitem twice by job, then counts by rule and job, and by rule
    assert len(exchanges(spark, tiny, "audit_all")) <= 4


@pytest.mark.parametrize("name, most", [("track_options", 2), ("track_order", 1), ("track_first_places", 1), ("layout_signature_strict", 1)])
def test_tracks_are_shuffled_once(spark, tiny, name, most):
    assert len(exchanges(spark, tiny, name)) <= most


@pytest.mark.parametrize("name", ("track_order", "track_first_places", "track_options", "layout_signature_strict", "cluster_validation", "audit_all"))
def test_large_tables_go_to_tasks_by_their_size(spark, sf, name, monkeypatch):
    monkeypatch.setattr(session, "LARGE", 1 << 10)
    monkeypatch.setattr(session, "TASK", 16 << 10)
    assert "REPARTITION_BY_NUM" in plan(spark, sf, name).executedPlan().toString()
    assert check(spark, sf, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", ("track_options", "track_effective_delay"))
def test_a_jobs_lists_are_gathered_without_aggregates(spark, sf, name):
    # an aggregate of lists sorts its rows once more and holds them all, which spills
    assert "Aggregate" not in plan(spark, sf, name).executedPlan().toString()


def test_rows_of_small_files_go_to_tasks_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "LARGE", 1 << 10)
    monkeypatch.setattr(session, "ROWS", 1000)
    tasks = session.table(spark, sf, "lineitem").count() // 1000
    text = plan(spark, sf, "track_options").executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == text.count("Exchange hashpartitioning") == text.count(f", {tasks}), REPARTITION_BY_NUM") == 2  # both sides in the same tasks


def test_clusters_are_made_once_for_all_modes(spark, tiny):
    assert plan(spark, tiny, "cluster_validation").executedPlan().toString().count("FileScan parquet") == 1


def test_tags_are_scaled_a_hundred_texts_at_a_time(spark, tiny):
    assert "BatchEvalPython" in plan(spark, tiny, "scaled_tags").executedPlan().toString()


def test_a_dictionary_is_made_of_distinct_words(spark, tiny):
    text = plan(spark, tiny, "kana_dictionary").optimizedPlan().toString()
    assert text.rindex("Aggregate [") > text.rindex("ArrowEvalPython")  # below what spells them


def test_packed_documents_take_few_files(spark, tmp_path):
    register(spark)
    good = spark.range(40).selectExpr("concat('job', id, '.txt') AS name", "IF(id % 9 = 0, NULL, concat('täxt ', id)) AS text").repartition(3)
    good.write.format("textdocument").option("packed", "true").mode("append").save(str(tmp_path))
    read = spark.read.format("textdocument").option("packed", "true").load(str(tmp_path))
    assert sorted(tuple(r) for r in read.collect()) == sorted((f"job{i}.txt", "" if i % 9 == 0 else f"täxt {i}") for i in range(40))
    assert len([f for f in tmp_path.rglob("*") if f.is_file()]) == 3
    with pytest.raises(Exception, match="no name for a document"):
        good.selectExpr("concat('_', name) AS name", "text").write.format("textdocument").option("packed", "true").mode("append").save(str(tmp_path))


def test_a_job_without_made_tracks_is_told_by_the_rules(spark, tiny):
    rows = connect(tiny).execute("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND l_orderkey % 19 = 0").fetchall()
    found = {r.job for r in __spark_entry__.queries()["audit_track_count"](spark, tiny).where("actual = '0'").collect()}
    assert found == {r[0] for r in rows}
