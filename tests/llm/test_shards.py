"""Sharding against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.shards import interleave, write_shards
from tidemark.session import shared_path


def brute(rows, shards, seed=11):
    """(doc_id, shard, slot) of rows (doc_id, source) with distinct ids."""
    key = lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    fractions = []
    for source in {s for _, s in rows}:
        own = sorted((i for i, s in rows if s == source), key=key)
        fractions += [((2 * k + 1) / (2 * len(own)), key(i), i) for k, i in enumerate(own)]
    out, filled = [], Counter()
    for place, (_, _, i) in enumerate(sorted(fractions)):
        shard = place * shards // len(rows)
        out.append((i, shard, filled[shard]))
        filled[shard] += 1
    return sorted(out)


def run(spark, rows, shards, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    return sorted((r.doc_id, r.shard, r.slot) for r in interleave(docs, shards, **more).collect())


ROWS = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}") for i in range(500)]


@pytest.mark.parametrize("shards", (1, 7, 16, 600))
def test_rows_are_ranked_and_cut(spark, shards):
    assert run(spark, ROWS, shards) == brute(ROWS, shards)


def test_every_shard_has_the_mixture(spark):
    source = dict(ROWS)
    share = Counter(source.values())
    got = run(spark, ROWS, 8)
    for shard in range(8):
        inside = Counter(source[i] for i, s, _ in got if s == shard)
        assert all(abs(inside[s] - n / 8) <= 2 for s, n in share.items())


def test_another_seed_gives_another_order(spark):
    assert run(spark, ROWS, 4, seed=5) == brute(ROWS, 4, seed=5) != brute(ROWS, 4)


def test_rows_without_an_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a", None)] * 90 + [(1, "b", "")] * 30 + [(2, None, "x" * 2_000_000)], "doc_id long, source string, text string").repartition(6)
    got = interleave(docs, 4)
    counts = Counter(r.shard for r in got.select("shard").collect())
    assert sorted(counts.values()) == [30, 30, 30, 31]
    for shard in range(4):
        assert sorted(r.slot for r in got.where(F.col("shard") == shard).select("slot").collect()) == list(range(counts[shard]))
    assert sorted(map(repr, got.groupBy("doc_id", "source").count().collect())) == sorted(map(repr, docs.groupBy("doc_id", "source").count().collect()))


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, "r", "k", "b", 1.5), (2, "a", 6, "R", None, "c", None)], "doc_id long, source string, Shard int, row string, KEY string, bin string, place double")
    got = interleave(docs, 2)
    assert got.columns == ["doc_id", "source", "row", "KEY", "bin", "place", "shard", "slot"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == [(1, "a", "r", "k", "b", 1.5), (2, "a", "R", None, "c", None)]
    assert interleave(docs.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        interleave(docs, 0)


def test_written_shards_hold_their_slots_in_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string")
    path = shared_path(spark, "written")
    write_shards(interleave(docs, 4), path)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == brute(ROWS, 4)
    files = back.groupBy(F.input_file_name()).agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n"), F.countDistinct("shard").alias("s")).collect()
    assert all(f.b - f.a + 1 == f.n and f.s == 1 for f in files)
