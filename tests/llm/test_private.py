"""Personal data: patterns against the regular expressions, and the tagger's held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import private
from tidemark.llm.tagger import KINDS, Tagger, allowed
from tidemark.session import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "0", "1", "12", "255", "4111 1111 1111 1111", "4111111111111111", ".", "@", "-", "+", " ", "(", ")", "\n", "%", "_", "é", "x@y", ".com", "+1 (555) 010-9999", "٣"]), max_size=30).map("".join))
def test_patterns_find_what_the_regular_expressions_do(text):
    assert private.base_spans(text) == brute(text)


def test_patterns_are_linear_in_long_texts():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1(" * 100_000, "1 " * 150_000):
        private.base_spans(text)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    tagger = Tagger.fresh(hidden=4)
    x, y = private.labelled_windows(3)
    x, y = x[:, :12].T, y[:, :12].T.copy()
    y[(y > 0) & (y % 2 == 0)] = 0  # so that no path is impossible
    _, grads = tagger.gradients(x, y)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if name == "moves" and not allowed()[at]:
                continue
            kept, e = tagger.weights[name][at], 1e-5
            tagger.weights[name][at] = kept + e
            up = tagger.gradients(x, y)[0]
            tagger.weights[name][at] = kept - e
            down = tagger.gradients(x, y)[0]
            tagger.weights[name][at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 1e-4


class Tokens:
    """A stand-in for the tagger that marks each run of characters that aren't blank as an email, as far as a window shows it."""

    def __init__(self, shift=0):
        self.shift = shift

    def decode(self, x):
        blank = np.isin(x, [private.PAD, *private.classes(" \n")])
        tags = np.where(blank, 0, 2).astype(np.int8)
        tags[:, 0] = np.where(blank[:, 0], 0, 1)
        tags[:, 1:][~blank[:, 1:] & blank[:, :-1]] = 1
        return tags


def test_spans_of_any_length_are_joined_at_every_offset():
    for size in (20, 45, 48, 50, 60, 72, 90, 96, 97, 130, 200, 300):
        email = "a" * (size - 8) + "@b.c.org"
        for lead in range(0, 100, 3):
            text = "x " * (lead // 2) + "x" * (lead % 2) + " " + email + " tail " * 40
            at = text.index(email)
            found = private.tagged_spans(Tokens(), [text])[0]
            assert found == [(at, private.EMAIL, at + size)], (size, lead)


def test_many_spans_of_one_text_never_overlap():
    text = " ".join(f"name{i}@host{i}.org" for i in range(2000))
    found = private.tagged_spans(Tokens(), [text])[0]
    assert found == [(m.start(), private.EMAIL, m.end()) for m in re.finditer(r"\S+", text)]

    class Disagreeing(Tokens):
        """Every second window sees its spans begin one character later."""

        def decode(self, x):
            tags = super().decode(x)
            for row in tags[1::2]:
                for a in np.flatnonzero(row[:-1] == 1):
                    if row[a + 1] == 2:
                        row[a], row[a + 1] = 0, 1
            return tags

    found = private.tagged_spans(Disagreeing(), [text])[0]
    assert len(found) > 1900 and all(a[2] <= b[0] for a, b in zip(found, found[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(1, 9)), max_size=9))
def test_the_heaviest_set_is_the_heaviest_of_all(drawn):
    weights = {(a, 0, a + n): w for a, n, w in drawn}
    best = max(sum(weights[s] for s in some) for k in range(len(weights) + 1) for some in itertools.combinations(weights, k) if all(a[2] <= b[0] or b[2] <= a[0] for a, b in itertools.combinations(some, 2)))
    kept = private.heaviest_apart(weights)
    assert sum(weights[s] for s in kept) == best and all(a[2] <= b[0] for a, b in zip(kept, kept[1:]))


def test_training_anew_gives_the_weights_beside_the_module():
    fresh, x = private.train(), private.labelled_windows(300, seed=5)[0]
    assert (fresh.decode(x) == private.trained_tagger().decode(x)).mean() >= 0.99


def test_query_against_brute_force(spark, tiny):
    tagger = private.trained_tagger()
    expected = {}
    for r in table(spark, tiny, "documents").collect():
        base = brute(r.text or "")
        added = [s for s in private.tagged_spans(tagger, [r.text or ""])[0] if all(s[2] <= b[0] or b[2] <= s[0] for b in base)]
        written = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        expected[r.doc_id] = (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written([*base, *added]))
    got = private.op9_private(spark, tiny)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected
    assert sum(sum(v[:4]) for v in expected.values()) > 0


def test_held_out_spans():
    x, y = private.labelled_windows(400, seed=77)
    got = private.trained_tagger().decode(x)
    hits = wrong = missed = 0
    for a, b in zip(got, y):
        own, true = set(private.spans_of_tags(a)), set(private.spans_of_tags(b))
        hits, wrong, missed = hits + len(own & true), wrong + len(own - true), missed + len(true - own)
    assert hits / (hits + missed) >= 0.9 and hits / (hits + wrong) >= 0.9


def test_numbers_without_a_plus_are_added_and_prose_is_left_alone():
    tagger = private.trained_tagger()
    texts = ["please call 555-010-9999 before noon today " * 3, "in 2024 we saw 17 of 30 birds, 4.5 each " * 20]
    found = private.tagged_spans(tagger, texts)
    assert [k for _, k, _ in found[0]] == [private.PHONE] * 3 and found[1] == []


def test_spans_at_any_offset_are_found_whole():
    tagger, rng = private.trained_tagger(), random.Random(1)
    words = ["some", "words", "of", "prose", "here", "and", "there"]
    hits = 0
    for n in range(60):
        lead = " ".join(rng.choices(words, k=n + 1)) + " "
        text = f"{lead}(555) 010-9999 " + " ".join(rng.choices(words, k=30))
        hits += (len(lead), private.PHONE, len(lead) + 14) in private.tagged_spans(tagger, [text])[0]
    assert hits >= 54


def test_nulls_repeats_long_texts_empty_table_and_clashing_columns(spark):
    long = "word " * 300_000 + "a@b.org"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a@b.org", "x"), (3, "a@b.org", "x"), (3, "a@b.org", "x"), (4, long, "x")], "doc_id long, text string, base string")
    got = private.find_private(docs)
    assert got.columns == ["doc_id", "base", "added"]
    rows = sorted(map(repr, ((r.doc_id, [(s["start"], s["kind"], s["end"]) for s in r.base]) for r in got.collect())))
    assert rows == sorted(map(repr, [(1, []), (2, []), (None, [(0, "email", 7)]), (3, [(0, "email", 7)]), (3, [(0, "email", 7)]), (4, [(1_500_000, "email", 1_500_007)])]))
    assert private.find_private(docs.limit(0)).count() == 0


def test_masking():
    assert private.mask("to a@b.org now", [(3, private.EMAIL, 10)]) == "to <email> now"
