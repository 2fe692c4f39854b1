"""The pipeline's stages, each against a brute-force version, and odd rows in each."""

from __future__ import annotations

import hashlib
import re

import pytest
import sentencepiece

from tidemark.llm import pipeline
from tidemark.llm.pieces import default_model
from tidemark.session import table


@pytest.fixture(scope="module")
def made(spark, tiny):
    """The input and the output of each stage, as rows by doc_id."""
    docs, out = table(spark, tiny, "documents"), []
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, tiny)
        after = spark.createDataFrame(after.collect(), after.schema)
        out.append(({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    return out


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def test_columns_and_order(made):
    assert [len(b) for _, b in made] == sorted((len(b) for _, b in made), reverse=True)
    for before, after in made[:4]:
        assert next(iter(after.values())).asDict().keys() == next(iter(before.values())).asDict().keys()


def test_line_dedup(made):
    before, after = made[1]
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for r in before.values():
        for k in {key(x) for x in (r.text or "").split("\n")} - {""}:
            found[k] = found.get(k, 0) + 1
    for i, r in before.items():
        assert after[i].text == "\n".join(x for x in (r.text or "").split("\n") if found.get(key(x), 0) < 10)
        assert after[i].n_chars == len(after[i].text) and after[i].source == r.source


def test_near_duplicates_go_and_others_stay(made):
    before, after = made[2]
    sets = {i: shingles(r.text) for i, r in before.items()}
    similarity = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(before)
    close = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(a, b) >= 0.8]
    assert close and not [(a, b) for a, b in close if a in after and b in after]
    for gone in set(before) - set(after):
        assert max(similarity(gone, x) for x in ids if x != gone) >= 0.8


def test_decontamination(made, spark, tiny):
    before, after = made[3]
    items = [shingles(r.text) for r in table(spark, tiny, "benchmark").collect()]
    leaks = {i for i, r in before.items() if any(len(x & shingles(r.text)) >= 0.8 * len(x) for x in items)}
    assert set(before) - set(after) == leaks


def test_sentencepiece(made):
    before, after = made[4]
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert set(before) == set(after)
    for i, r in after.items():
        assert list(r.ids) == library.encode(before[i].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.ids)).encode()).hexdigest()


def test_run_gives_what_the_stages_give(made, spark, tiny):
    assert {r.doc_id for r in pipeline.run(spark, tiny).collect()} == set(made[-1][1])


def test_the_root_file_gives_the_same_stages():
    import corpus_pipeline

    assert (corpus_pipeline.STAGES, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL) == (pipeline.STAGES, pipeline.run, pipeline.ORACLE_SQL)


def test_odd_rows_have_their_results(spark, tiny):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Row string, key int, own_id int, n_lines int"
    good = " ".join(f"word{i}" for i in range(80))
    more = (None, 7, 8, 9)
    rows = [(None, None, None, None, None, *more), (1, "", "en", "s", 0, *more), (2, good, None, None, None, *more), (2, good, None, None, None, *more), (3, "x " * 60_000, None, "s", 1, *more), (None, good + " more", None, "s", 1, *more), (4, f"{good}\nmenu", "en", "s", 9, *more)]
    rows += [(10 + i, f"{good} {i} own{i} " + " ".join(f"p{i}x{k}" for k in range(40)) + "\nMenu ", "en", "s", 9, *more) for i in range(10)]
    docs = spark.createDataFrame(rows, schema)

    def after(stage):
        function = dict(pipeline.STAGES)[stage]
        assert function(spark, docs.limit(0), tiny).count() == 0
        got = function(spark, docs, tiny)
        assert stage == "SentencePiece" or got.columns == docs.columns
        return got.collect()

    ids = lambda got: sorted(map(repr, (r.doc_id for r in got)))
    eleven = [4, *range(10, 20)]
    assert ids(after("quality rules")) == sorted(map(repr, [2, 2, None, *eleven]))
    lines = after("line dedup")
    assert ids(lines) == ids(docs.collect())
    assert {r.text for r in lines if r.doc_id == 4} == {good} and all("enu" not in r.text for r in lines)
    assert {(r.doc_id, r.text, r.n_chars) for r in lines if r.n_chars == 0} == {(None, "", 0), (1, "", 0)}
    near = after("SimHash near-dedup")
    assert ids(near) == sorted(map(repr, [None, None, 3, *range(10, 20)]))  # no text with the empty one, the good one with more of it, and with the menu
    assert ids(after("benchmark decontamination")) == ids(docs.collect())
    tokens = after("SentencePiece")
    assert ids(tokens) == ids(docs.collect()) and {r.n_tokens for r in tokens if r.doc_id == 1} == {0}
