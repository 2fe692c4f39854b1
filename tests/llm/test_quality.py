"""Quality rules: hosts' verdicts and odd rows; the base counts are held against SQL."""

from __future__ import annotations

from tidemark.llm.quality import Limits, verdicts

GOOD = " ".join(f"word{i}" for i in range(80))
BAD = "a b c " * 60


def test_a_bad_host_loses_its_documents_and_a_small_one_does_not(spark):
    rows = [(i, GOOD, "good.org") for i in range(200)] + [(300 + i, "# & | " * 3 + GOOD if i % 10 == 0 else BAD, "bad.org") for i in range(100)] + [(500, BAD, "one.org"), (501, GOOD, "two.org"), (502, GOOD, "two.org"), (503, BAD, "two.org")]
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept for i in range(200))
    assert not any(got[300 + i].kept for i in range(100))
    assert not got[310].base_failed and got[310].host_rate > 0.5
    assert not got[500].kept and got[501].kept and got[502].kept and not got[503].kept


def test_rates_are_shrunk_towards_the_mean(spark):
    rows = [(i, GOOD, f"h{i % 7}") for i in range(70)] + [(100, BAD, "new")]
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert 1 / 71 < got[100].host_rate < 1.0 and 0 < got[0].host_rate < 1 / 71


def test_nulls_repeats_long_texts_empty_table_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, None, None, 1), (None, "", None, 2), (2, GOOD, None, 3), (2, GOOD, None, 3), (3, long, "s", 4)], "doc_id long, text string, source string, kept int")
    got = verdicts(docs)
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.base_failed) for r in got.collect()))) == sorted(map(repr, [(1, 0, True), (None, 0, True), (2, 80, False), (2, 80, False), (3, 150_000, False)]))
    assert verdicts(docs.limit(0)).count() == 0
    assert verdicts(docs, limits=Limits(min_words=81, max_host_rate=1.0)).where("kept").count() == 1
