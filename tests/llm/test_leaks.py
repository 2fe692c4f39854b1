"""Benchmark decontamination: planted passages, blocks and odd rows."""

from __future__ import annotations

import random

from tidemark.llm.leaks import Item, ItemIndex, contained_items, decontaminate


def text_of(rng, n, pool=3000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def brute(docs, items):
    def grams(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    out = set()
    for item_id, text in items:
        words = (text or "").lower().split()
        if not words:
            continue
        own = grams(words, min(5, len(words)))
        for doc_id, doc in docs:
            shared = len(own & grams((doc or "").lower().split(), min(5, len(words))))
            if shared >= 0.8 * len(own):
                out.add((doc_id, item_id, shared, len(own)))
    return out


def test_planted_items_of_every_size_are_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(text_of(rng, n))) for i, n in enumerate([1, 2, 3, 5, 6, 8, 12, 20, 50, 130, 700])]
    docs = []
    for d in range(120):
        words = text_of(rng, rng.choice([0, 30, 400, 3000]))
        if d % 2:
            own = rng.choice(items)[1].split()
            if len(own) > 20 and d % 4 == 1:
                own[len(own) // 2] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, " ".join(words).upper() if d % 3 == 0 else "\n ".join(words)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert {tuple(r) for r in contained_items(frame, bench).collect()} == expected
    assert {tuple(r) for r in contained_items(frame, bench, block_chars=400).collect()} == expected
    clean = {d for d, _ in docs} - {e[0] for e in expected}
    assert {r.doc_id for r in decontaminate(frame, bench).collect()} == clean
    assert {r.doc_id for r in decontaminate(frame, bench, block_chars=400).collect()} == clean


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b c d e f", 2), (2, "a b c d e f", 3), (2, "a b c d e f", 3), (3, "", 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, "A b c d e f"), (9, "A b c d e f"), (8, None), (None, "  ")], "item_id long, text string")
    found = sorted(map(repr, map(tuple, contained_items(docs, bench).collect())))
    assert found == sorted(map(repr, [(None, 9, 2, 2), (2, 9, 2, 2), (2, 9, 2, 2)]))
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert contained_items(docs, bench.limit(0)).count() == 0 and contained_items(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 5 and decontaminate(docs.limit(0), bench).count() == 0


def test_no_small_item_is_missed():
    rng = random.Random(9)
    for n_words in (*range(1, 13),):
        items = [Item.of(i, " ".join(f"i{i}x{k}" for k in range(n_words))) for i in range(40)]
        index, texts, planted = ItemIndex(items), [], []
        for t in range(2000):
            words = text_of(rng, rng.choice([0, 3, 40, 200]))
            i, at = rng.randrange(40), rng.randrange(len(words) + 1)
            own = [f"i{i}x{k}" for k in range(n_words)]
            texts.append(" ".join(words[:at] + own + words[at:]))
            planted.append(i)
        found = index.search(texts)
        assert all([j for j, _ in own] == [i] for own, i in zip(found, planted)), n_words


def test_a_small_item_that_lacks_a_shingle_is_found_where_enough_are_left():
    item = Item.of(1, " ".join(f"w{k}" for k in range(12)))  # eight shingles, of which seven are enough
    index = ItemIndex([item])
    for words, hit in ((range(11), 7), (range(1, 12), 7), (range(10), None), (range(2, 12), None)):
        assert index.search([" ".join(f"w{k}" for k in words)]) == [[(0, hit)] if hit else []]


def test_a_very_long_text(spark):
    words = [f"v{i}" for i in range(200_000)]
    item = [f"q{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:123_456] + item + words[123_456:])), (2, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in contained_items(docs, bench).collect()] == [(1, 5, 36, 36)]
    assert [r.doc_id for r in decontaminate(docs, bench).collect()] == [2]
