"""SimHash near-dedup against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import connected_components
from tidemark.llm.simhash import WIDE, Ring, drop_near_duplicates, fingerprint, groups_apart, links, links_in_groups, near_duplicates, op3_simhash, shingle_hashes
from tidemark.session import table


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_documents_against_all_pairs(spark, tiny):
    rows = table(spark, tiny, "documents").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = components(ids, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, tiny).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}
    assert any(a != b for a, b in roots.items())


@pytest.mark.parametrize("seed, block_rows", [(1, 20_000), (2, 20_000), (3, 7)])
def test_no_link_is_lost_in_dense_fingerprints(spark, seed, block_rows):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(15)]
    values = set(centres)
    for c in centres:
        for _ in range(30):
            x = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    frame = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fingerprint binary")
    found = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in links(frame, Ring(64, 3, 16, True), block_rows=block_rows).collect()]
    assert components(values, found) == components(values, near)


def test_ring_that_has_to_find_all_says_so():
    assert Ring(64, 3, 16, True).complete and not WIDE.complete


def test_copies_edited_by_some_words_are_found_on_five_word_shingles(spark):
    rng = random.Random(5)
    rows, groups = [], 60
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 800]))]
        rows.append((3 * g, " ".join(words)))
        for k in (1, 2):
            edited = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                edited[at] = "changed"
            rows.append((3 * g + k, " ".join(edited)))
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {3 * g for g in range(groups)} <= kept
    assert len(kept) <= 1.02 * groups


def test_wide_links_have_the_recall_they_are_meant_to_have():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2, (4000, 256), dtype=np.uint8)
    flip = np.zeros_like(a)
    for row in flip:
        row[rng.choice(256, 39, replace=False)] = 1  # as many as differ at a similarity of 0.8 on average
    sizes = np.full((4000, 1), 100, dtype=">u4").view(np.uint8)
    prints = [np.concatenate([np.packbits(x, axis=1), sizes], axis=1) for x in (a, a ^ flip)]
    left, right = (WIDE.cut(p) for p in prints)
    agree = (left == right).any(axis=1)
    assert agree.mean() >= 0.9


def test_documents_go_at_a_similarity_of_four_fifths_and_stay_below(spark):
    rng = random.Random(8)
    rows, stay, go = [], set(), set()
    for g in range(240):
        words = [f"w{rng.randrange(10**9)}" for _ in range(304)]
        cut = (33, 34, 33, 52)[g % 4]  # of 300 shingles cut differ: 0.802, 0.796, 0.802, 0.705
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[: 304 - cut] + [f"v{rng.randrange(10**9)}" for _ in range(cut)]))]
        (stay if g % 2 else go).add(2 * g + 1)
    rows += [(900 + i, " ".join(f"c{k}" for k in range(12 * i, 12 * i + 304))) for i in range(20)]  # a chain of neighbours at 0.92
    rows += [(990, " ".join(["la"] * 300)), (991, " ".join(["la"] * 9))]  # one distinct shingle each
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert {2 * g for g in range(240)} | stay <= kept
    assert len(go & kept) <= 0.05 * len(go)  # the segments miss some at the limit
    assert {i for i in kept if i >= 900} == {900, 990}


@pytest.mark.parametrize("small, cut", [(100_000, 24), (0, 1), (0, 5)])
def test_links_in_groups_join_what_all_links_join(spark, monkeypatch, small, cut):
    monkeypatch.setattr(simhash, "SMALL_BYTES", small)
    monkeypatch.setattr(simhash, "CUT", cut)
    rng = random.Random(2)
    rows, links_ = [], []
    for group in range(3):
        words = [f"g{group}w{i}" for i in range(120)]
        for part in range(40):
            text = list(words)
            for i in rng.sample(range(120), rng.choice((1, 2, 3, 4, 5, 60))):
                text[i] = f"x{rng.randrange(10**9)}"
            codes = np.unique(shingle_hashes(" ".join(text), 5))
            rows.append((group, part // 2, bytearray(fingerprint(codes, 256) + len(codes).to_bytes(4, "big") + len(rows).to_bytes(8, "big")), codes.view(np.int64).tolist()))
    rows.append((7, 1, bytearray(WIDE.bytes), []))
    rows.append((8, 1, bytearray(WIDE.bytes), [5]))
    for i, (g, p, a, x) in enumerate(rows):
        for h, q, b, y in rows[:i]:
            if g == h and p != q and (int.from_bytes(a[:32], "big") ^ int.from_bytes(b[:32], "big")).bit_count() <= 64 and len({*x} & {*y}) >= 0.8 * len({*x} | {*y}):
                links_.append(((g, p), (h, q)))
    frame = spark.createDataFrame(rows, "group long, part long, fingerprint binary, codes array<long>").repartition(5)
    apart = groups_apart(frame.withColumn("n", F.size("codes")))
    assert {r.group for r in apart.collect()} == {0, 1, 2} and {r.blocks for r in apart.collect()} == ({1} if small else {cut})
    of = {bytes(f): (g, p) for g, p, f, _ in rows[:-2]}
    found = [(of[bytes(r.a)], of[bytes(r.b)]) for r in links_in_groups(apart.join(frame.select("fingerprint", "codes"), "fingerprint"), WIDE).collect()]
    assert set(map(frozenset, found)) <= set(map(frozenset, links_)) and len(found) < len(links_)

    def trees(edges):
        root = {n: n for n in of.values()}
        for a, b in edges:
            a, b = root[a], root[b]
            root = {n: min(a, b) if r in (a, b) else r for n, r in root.items()}
        return root

    assert trees(found) == trees(links_) and 3 < len(set(trees(links_).values())) < 60


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 5000, rng.integers(0, 900)).astype(np.uint64)) for _ in range(1100)]
    parity = simhash._parity(np.concatenate(sets), np.repeat(np.arange(1100), [len(x) for x in sets]), 1100)
    for a, b in rng.integers(0, 1100, (300, 2)):
        assert np.bitwise_count(parity[a] ^ parity[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
    assert (np.bitwise_count(parity).sum(axis=1)[:5] <= [len(x) for x in sets[:5]]).all()


def test_clean_documents_stay(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 300)))) for i in range(400)]
    assert drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 400


def test_nulls_ties_long_texts_empty_table_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    schema = "doc_id long, text string, fingerprint string, root int, component_id string, Row string"
    rows = [(4, None), (2, ""), (3, " \n"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, long), (9, long + " end")]
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], schema)
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "key", "fingerprint", "root", "component_id"]
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in got.collect()))) == sorted(map(repr, [(4, 2), (2, 2), (3, 2), (None, 7), (7, 7), (7, 7), (8, 8), (9, 8)]))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [2, None, 8]))
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_keep_no_growing_estimate(spark):
    """A chain takes many rounds; the plan that comes out must not carry the product of all joins' sizes."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    found = connected_components(edges)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(61)]
