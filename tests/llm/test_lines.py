"""Line dedup against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm.lines import LineRuns, _sorted_scans, line_dedup
from tidemark.session import shared_path


def brute(rows, min_docs, min_chars=1):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    found = {}
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            found.setdefault(k, set()).add(doc_id if doc_id is not None else (text,))
    hot = {k for k, docs in found.items() if len(docs) >= min_docs and len(k) >= min_chars}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, min_docs, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup(docs, min_docs, **more)
    return sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def test_lines_of_many_documents_go(spark):
    rng = random.Random(1)
    pool = ["Menu", " menu\t", "ÄB", "äb", "", "  ", "x\r", "one of a kind", "Über\x0b", "a "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(6)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n")]
    for min_docs in (2, 5, 10, 30):
        assert run(spark, rows, min_docs) == brute(rows, min_docs)
    assert run(spark, rows, 5, min_chars=3) == brute(rows, 5, min_chars=3)


def test_a_very_long_text_and_repeated_rows(spark):
    long = "\n".join(["line"] + [f"number {i}" for i in range(100_000)])
    rows = [(1, long), (2, "line\nown"), (2, "line\nown"), (3, "line")]
    assert {(r[0], r[2], r[3]) for r in run(spark, rows, 3)} == {(1, 100_001, 1), (2, 2, 1), (3, 1, 1)}
    assert {(r[0], r[2], r[3]) for r in run(spark, rows, 4)} == {(1, 100_001, 0), (2, 2, 0), (3, 1, 0)}  # a repeated row is the same document


def test_rows_without_an_id_are_documents_by_their_text(spark):
    rows = [(None, "line"), (None, "line"), (None, "line\nmore"), (None, None), (7, "line")]
    for min_docs in (2, 3, 4):
        assert run(spark, rows, min_docs) == brute(rows, min_docs)


def test_nulls_empty_table_and_clashing_columns(spark):
    schema = "N_dropped string, text string, doc_id long, line int, `batch` string, own_id int, Own_Lines int, __doc_id int, key int, found int"
    docs = spark.createDataFrame([("a", "x\ny", None, 1, "b", 1, 2, 3, 4, 5), (None,) * 10, ("c", "x", 3, 2, "d", 1, 2, 3, 4, 5)], schema)
    got = line_dedup(docs, 2)
    assert got.columns == ["text", "doc_id", "line", "batch", "own_id", "Own_Lines", "__doc_id", "key", "found", "n_lines", "n_dropped"]
    rest = (1, 2, 3, 4, 5)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("y", None, 1, "b", *rest, 2, 1), ("", *(None,) * 8, 1, 0), ("", 3, 2, "d", *rest, 1, 1)]))
    assert line_dedup(docs.limit(0), 2).count() == 0


def test_runs_are_levelled(spark):
    store = LineRuns(spark, shared_path(spark, "runs"), min_docs=3, fanout=2)
    for batch in range(5):
        store.add(spark.createDataFrame([(bytearray(b"often"), 1), (bytearray([batch]), 1)], "line binary, n long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert {bytes(r.line): r.n for r in spark.table(store.levels[2][0]).collect()}[b"often"] == 3  # what three batches prove isn't added again
    assert [bytes(r.line) for r in store.frequent().collect()] == [b"often"]
    store.close()
    assert LineRuns(spark, shared_path(spark, "runs"), 3).frequent().count() == 0


def test_runs_are_merged_without_a_shuffle(spark):
    store = LineRuns(spark, shared_path(spark, "runs"), min_docs=3, fanout=9)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for batch in range(3):
            store.add(spark.range(50 * batch, 60 * batch + 90).select(F.md5(F.col("id").cast("string")).cast("binary").alias("line"), F.lit(1).cast("long").alias("n")))
        with _sorted_scans(spark):
            plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan(store._merged(*store.levels[0][:2]))
            batch = spark.range(9).select(F.md5(F.col("id").cast("string")).cast("binary").alias("line"), F.lit(1).cast("long").alias("n"))
            joined = plan(store.unproven(batch))
            assert joined.count("Exchange") == 1 and joined.count("SortMergeJoin") == 3 and joined.count("Sort [") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        store.close()
