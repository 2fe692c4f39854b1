"""Repeated passages against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tidemark.llm.repeats import DEPTH, MIN_WORDS, RUNS, all_pieces, open_windows, repeated_regions


def regions(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(tuple(r) for r in repeated_regions(frame).collect())


def covered_by_other(rows, n):
    """Word positions of each document that lie in a run of n words which another document has too."""
    words = {d: (t or "").lower().split() for d, t in rows}
    owners = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            owners.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = {d: set() for d in words}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            if len(owners[tuple(w[i : i + n])]) > 1:
                out[d].update(range(i, i + n))
    return out


def planted(seed, docs=40):
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate([20, 30, 49, 50, 51, 60, 75, 120, 400])]
    rows = []
    for d in range(docs):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(0, 90))]
            words += rng.choice(passages)
        words += [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(0, 90))]
        rows.append((d, " ".join(words)))
    return rows


def as_all_pairs(spark, rows):
    """Hold the regions against brute force, word by word; what they cover."""
    found = {d: set() for d, _ in rows}
    for d, a, b in regions(spark, rows):
        assert b - a >= MIN_WORDS
        found[d].update(range(a, b))
    assert found == covered_by_other(rows, MIN_WORDS)
    return found


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_passages_are_found_whole_and_nothing_else(spark, seed):
    assert any(as_all_pairs(spark, planted(seed)).values())


def test_no_two_documents_together_make_a_passage(spark):
    rng = random.Random(4)
    rows = []
    for i in range(20):  # 70 words of which one document has the first half and another the second
        passage = [f"p{i}x{k}" for k in range(70)]
        own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
        rows += [(3 * i, " ".join(own(40) + passage + own(40))), (3 * i + 1, " ".join(own(30) + passage[:35] + own(30))), (3 * i + 2, " ".join(own(35) + passage[35:] + own(35)))]
    assert not any(as_all_pairs(spark, rows).values())


def test_a_third_document_has_what_the_nearest_ones_have_not(spark):
    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, d = [], 0
    for i in range(25):
        passage = [f"p{i}x{k}" for k in range(110)]
        pieces = [(0, 110), (30, 85), (30 + i, 110), (0, 62 + i), (20, 69), (25, 75), (26, 76)]  # some long to one side of a minimiser, one short on both
        for a, b in pieces:
            rows.append((d, " ".join(own(rng.randrange(40)) + passage[a:b] + own(rng.randrange(1, 40)))))
            d += 1
    found = as_all_pairs(spark, rows)
    assert sum(bool(f) for f in found.values()) > 100


def test_mosaics_of_many_documents(spark):
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for d in range(60):
        words = []
        while len(words) < 400:
            at, n = rng.randrange(2800), rng.choice((10, 25, 45, 50, 51, 70, 140))
            words += pool[at : at + n]
        rows.append((d, " ".join(words)))
    as_all_pairs(spark, rows)


def test_windows_that_are_open():
    starts, ends = np.array([100, 120, 300, 400]), np.array([152, 172, 320 + 30, 421])
    got = [w.tolist() for w in open_windows(starts, ends)]
    assert got[0] == list(range(100 - RUNS + 1, 100)) and got[1] == list(range(91, 100)) and got[2] == list(range(271, 300)) and got[3] == [371]
    assert [w.tolist() for w in open_windows(np.array([5]), np.array([50]))] == [[0]]


def test_repeats_inside_one_document_do_not_count(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    assert regions(spark, [(1, f"{passage} between {passage}"), (2, "other words")]) == []
    assert regions(spark, [(1, f"{passage} between {passage}"), (2, passage)]) == [(1, 0, 80), (1, 81, 161), (2, 0, 80)]


def test_many_copies_and_very_long_texts(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(100)]
    rows = [(d, " ".join([f"w{d}x{i}" for i in range(d % 30)] + passage)) for d in range(600)]
    assert regions(spark, rows) == sorted((d, d % 30, d % 30 + 100) for d in range(600))
    long = [f"w{rng.randrange(10**9)}" for _ in range(60_000)]
    assert regions(spark, [(1, " ".join(long)), (2, " ".join(["own"] * 7 + long))]) == [(1, 0, 60_000), (2, 7, 60_007)]


def test_one_word_over_and_over(spark):
    got = regions(spark, [(1, "la " * 500), (2, "la " * 300), (3, "x " * 500)])
    assert got == [(1, 0, 500), (2, 0, 300)]


def test_nulls_repeated_rows_empty_table_and_clashing_columns(spark):
    text = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, 1), (None, text, 2), (1, None, 3), (2, "", 4)], "doc_id long, text string, place int")
    assert repeated_regions(docs).count() == 0  # rows without an id are one document
    more = docs.unionByName(spark.createDataFrame([(3, text, 5), (3, text, 5)], docs.schema))
    assert sorted(map(repr, map(tuple, repeated_regions(more).collect()))) == sorted(map(repr, [(None, 0, 60), (3, 0, 60)]))
    assert repeated_regions(docs.limit(0)).count() == 0


@pytest.mark.parametrize("docs, tasks", [((1, 1, 1, 2), 2), ((2, 1, 1, 1), 2), ((1, 1, 1, 1, 1, 2), 3), ((1, 1, 2, 2), 2), ((2, 1, 1, 1, 1, 3), 6)])
def test_every_row_of_a_run_meets_the_other_document_beyond_a_task(spark, docs, tasks):
    suffix = bytearray(np.arange(1, DEPTH + 1).astype(">u4").tobytes())
    rows = [(suffix, d, d, 100 * i, 40) for i, d in enumerate(docs)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "suffix binary, doc long, key long, place int, room int")
    assert {tuple(r) for r in all_pieces(frame).select("doc", "key", "start", "end").collect()} == {(d, d, 100 * i, 100 * i + 40) for i, d in enumerate(docs)}


def shuffles(spark):
    """Ids of the shuffles that have files on disk."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {part.split("_")[1] for part in manager.getAllFiles().mkString(",").replace("/", ",").split(",") if part.startswith("shuffle_")}


def test_shuffles_leave_the_disk_as_steps_end(spark):
    frame = spark.createDataFrame(planted(5), "doc_id long, text string").repartition(4)
    before = shuffles(spark)
    found = repeated_regions(frame)
    until = time.time() + 20  # files go beside the work
    while len(shuffles(spark) - before) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(shuffles(spark) - before) <= 1  # Spark holds on to the last job's until there is another
    assert found.count() > 0
