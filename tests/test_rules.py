"""Rules through the automaton against the same rules one after the other."""

from __future__ import annotations

import random

import pytest

from tidemark.functions import rules as module
from tidemark.functions.rules import Automaton, Rulebook, rules_applied
from tidemark.functions.words import fixed_lines, replaced


def test_the_automaton_finds_what_occurs():
    rng = random.Random(1)
    literals = list({"".join(rng.choices("abé", k=rng.randint(1, 5))).encode() for _ in range(60)})
    automaton = Automaton(literals)
    texts = ["".join(rng.choices("abécd", k=rng.choice((0, 1, 3, 40, 30_000)))).encode() for _ in range(50)]
    wanted = [{i for i, x in enumerate(literals) if x in t} for t in texts]
    assert automaton.scan(texts) == wanted and [automaton.scan_one(t) for t in texts[:20]] == wanted[:20]
    assert Automaton([]).scan([b"abc"]) == [set()] and automaton.scan([]) == [] and automaton.scan([b""]) == [set()]


def test_a_string_over_the_edge_of_a_strip(monkeypatch):
    monkeypatch.setattr(module, "_STRIPS", 7)
    automaton = Automaton([b"needle", b"edl", b"hay"])
    for at in range(60):
        assert automaton.scan([b"-" * at + b"needle" + b"-" * (60 - at), b"nee", b"dle"]) == [{0, 1}, set(), set()]


def chained(spark, texts, rules):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, line string").repartition(3)
    wanted = {r.i: (r.line, r.fixes) for r in replaced(frame, "line", rules).collect()}
    got = {r.i: (r.line, r.fixes) for r in rules_applied(frame, "line", rules).collect()}
    assert got == wanted
    return got


@pytest.mark.parametrize("seed", range(4))
def test_as_the_rules_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé.", k=rng.randint(1, 3)))
    rules, used = [], set()
    while len(rules) < 25:
        kind, old = rng.choice(("literal", "word", "word_start", "word_end")), word()
        if (kind, old) not in used:  # counts are kept by kind and literal
            used.add((kind, old))
            rules.append((kind, old, rng.choice(("", "a", "bé", "$1", "\\", "x a"))))
    rules.append(("regex", "(b)a+", "$1-"))
    texts = ["".join(rng.choices("aabé. ", k=rng.randint(0, 30))) for _ in range(150)]
    assert any(fixes for _, fixes in chained(spark, texts, rules).values())


def test_what_one_rule_makes_another_finds(spark):
    rules = [("literal", "rn", "m"), ("literal", "mod", "MOD"), ("word", "MOD", "found"), ("word_end", "zz", "!"), ("literal", "vv", "w")]
    got = chained(spark, ["rnod vvord rnodzz", "modrn", "", "rnrnod"], rules)
    assert got[0][0] == "found word MOD!" and got[0][1] == {"rn>m": 2, "mod>MOD": 2, "word:MOD": 1, "word_end:zz": 1, "vv>w": 1}


def test_line_stages_as_the_chained_ones(spark):
    whole, begin, end, partial = {"a b": "whole"}, {"a": "b", "b": "c", "whole": "W"}, {"b": "a", "aa": "-"}, {"nd": "n d", "n d": "N", "c": ""}
    rules = [(k, old, new) for k, stage in (("begin_line", begin), ("partial_line", partial), ("whole_line", whole), ("end_line", end)) for old, new in stage.items()]
    rng = random.Random(7)
    texts = [" a b ", "a b", "bb", "b", "whole"] + ["".join(rng.choices("abcnd ", k=rng.randint(0, 12))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, line string")
    assert sorted(r.i for r in frame.collect()) == list(range(205))
    wanted = {r.i: r.line for r in fixed_lines(frame, "line", whole, begin, end, partial, {}).collect()}
    assert {r.i: r.line for r in rules_applied(frame, "line", rules).collect()} == wanted


def test_nulls_long_texts_tables_of_rules_and_bounds(spark, monkeypatch):
    frame = spark.createDataFrame([(1, None, "k"), (2, "ab " * 200_000, "l"), (3, "", "m")], "i long, line string, fixes string")
    table = spark.createDataFrame([("word", "ab", "c", 2), ("word", "", "x", 1), ("literal", "c", "never", 3)], "kind string, old string, new string, at int")
    got = {r.i: r for r in rules_applied(frame, "line", table).collect()}
    assert got[1].line is None and got[1].fixes == {} and got[2].line == "c " * 200_000 and got[2].fixes == {"word:ab": 200_000} and got[3].line == ""
    assert rules_applied(frame.limit(0), "line", []).count() == 0 and rules_applied(frame, "line", []).count() == 3
    monkeypatch.setattr(module, "CELLS", 100)
    with pytest.raises(ValueError):
        Rulebook([("word", f"word{i}", "") for i in range(100)])


def test_more_words_than_go_to_a_task(spark):
    """A table of rules beyond what is sent gives what the same rules give one after the other."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abé_1", k=rng.randint(1, 3)))
    rules = [("whole_word", w, rng.choice(("", "<*>", "-", " "))) for w in {word() for _ in range(60)}] + [("partial_word", "b1", "a b"), ("whole_line", "aa", "é1")]
    texts = ["".join(rng.choices("aabé_1. \n-", k=rng.randint(0, 40))) for _ in range(150)] + ["aa", "", "aa", "aa"]
    frame = spark.createDataFrame([*enumerate(texts), (999, None)], "i long, line string").repartition(3)
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rules)], "at long, kind string, old string, new string")
    wanted = {r.i: (r.line, r.fixes) for r in rules_applied(frame, "line", rules).collect()}
    assert {r.i: (r.line, r.fixes) for r in rules_applied(frame, "line", table, sent=0).collect()} == wanted
    many = spark.range(400_000).selectExpr("id AS at", "'whole_word' AS kind", "concat('word', id) AS old", "'<*>' AS new")
    some = spark.createDataFrame([(1, "word7 word399999 word400000")], "i long, line string")
    assert rules_applied(some, "line", many).first().line == "<*> <*> word400000"
