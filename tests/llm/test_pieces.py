"""SentencePiece encoding and decoding against the library's own."""

from __future__ import annotations

import itertools
import math

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces
from tidemark.session import table

MODEL = pieces.default_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def transducer():
    return pieces.Transducer.load(MODEL)


def ids_of(transducer, text):
    return list(memoryview(transducer.encode(text)).cast("i"))


def test_documents_encode_and_decode_as_the_library_does(spark, tiny, library):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    rows = pieces.encode(docs, MODEL).collect()
    texts = [r.text or "" for r in rows]
    assert [list(r.ids) for r in rows] == library.encode(texts)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, MODEL).drop("text"), MODEL).collect()}
    assert back == {r.doc_id: library.decode(list(r.ids)) for r in rows}


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n", "a\n\nb", "▁", "▁▁a", "日本語テキスト", "\U0001f600é", "\x00\x01", "�", "a" * 3000, "1234567890" * 50, "<s>", "<0x41>", "tab\tx", "  "])
def test_odd_texts(text, library, transducer):
    ids = ids_of(transducer, text)
    assert ids == library.encode(text)
    assert transducer.decode(ids) == library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst ,.\n'AB▁é日\U0001f600"), max_size=60))
def test_any_text(text):
    transducer, library = _both()
    assert ids_of(transducer, text) == library.encode(text)


def _both(held=[]):
    if not held:
        held.extend([pieces.Transducer.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)])
    return held


def test_least_path_of_a_unigram_model_is_the_least_of_all():
    scores = {"a": -1.0, "b": -1.5, "ab": -1.9, "ba": -2.2, "aba": -3.1, "▁": -0.5, "▁a": -1.2}
    own = pieces.Transducer([("<unk>", 0.0, pieces.UNKNOWN), *[(p, s, pieces.NORMAL) for p, s in scores.items()]], pieces.UNIGRAM)

    def least(text):
        best = math.inf
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            if all(p in scores for p in parts):
                best = min(best, -sum(scores[p] for p in parts))
        return best

    for text in ("a", "ab", "aba", "abab", "babaab", "aabba"):
        path = own.shortest_path(own.normalise(text))
        assert "".join(map(own.text, path)) == own.normalise(text)
        assert math.isclose(-sum(scores[own.text(s)] for s in path), least(own.normalise(text)))


def test_weights_of_a_byte_pair_path_are_summed(transducer):
    path = transducer.shortest_path(transducer.normalise("unbelievable"))
    assert "".join(map(transducer.text, path)) == "▁unbelievable"
    assert all(transducer.follow(a, b) for a, b in zip([-1, *path], path))


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_pairs_follow_as_merging_their_characters_says(data):
    transducer, _ = _both()
    plain = [i for i, p in enumerate(transducer.texts) if p in transducer.score_of]
    left, right = (data.draw(st.sampled_from(plain)) for _ in range(2))
    apart = [transducer.text(left), transducer.text(right)]
    if transducer.merged(list(apart[0])) == apart[:1]:
        assert transducer.follow(left, right) == (transducer.merged(list("".join(apart))) == apart)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["ab", "ba", "aa", "bb", "aba", "bab", "aab", "abab", "bba", "aaaa"]), unique=True), st.text(alphabet="ab", min_size=1, max_size=14), st.randoms())
def test_any_small_byte_pair_model_encodes_as_its_merges_do(longer, text, rng):
    rng.shuffle(longer)
    texts = [*longer, "a", "b", "▁"]
    own = pieces.Transducer([("<unk>", 0.0, pieces.UNKNOWN), *[(p, -float(i), pieces.NORMAL) for i, p in enumerate(texts)]], pieces.BYTE_PAIR)
    assert [own.text(s) for s in own.shortest_path(text)] == own.merged(list(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeinorst,.'AB▁é日\U0001f600"), min_size=1, max_size=12), min_size=1, max_size=20))
def test_paths_side_by_side_are_those_one_by_one(words):
    transducer, _ = _both()
    symbols, bounds = transducer.shortest_paths(words)
    assert [symbols[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [transducer.shortest_path(w) for w in words]


def test_unigram_paths_side_by_side():
    scores = {"a": -1.0, "b": -1.5, "ab": -1.9, "ba": -2.2, "aba": -3.1}
    own = pieces.Transducer([("<unk>", 0.0, pieces.UNKNOWN), *[(p, s, pieces.NORMAL) for p, s in scores.items()]], pieces.UNIGRAM)
    words = ["a", "ab", "aba", "abab", "babaab", "xabx", "x"]
    symbols, bounds = own.shortest_paths(words)
    assert [symbols[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [own.shortest_path(w) for w in words]


def test_a_character_map_is_compiled(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec
    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("▁a", -3.5, 1), ("fi", -3.2, 1), ("f", -4.0, 1), ("i", -4.1, 1), ("1", -4.2, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.CopyFrom(spec)
    path = tmp_path / "small.model"
    path.write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Transducer.load(str(path))
    for text in ("ﬁ a", "  a　　ａ ", "①ｆｉ", "e\u0301 é", "\t a\r\n a", "㌔", "ｶﾞ", "", " ", "日本"):
        assert ids_of(own, text) == library.encode(text), text


def test_ids_that_no_piece_has(spark, transducer):
    assert transducer.decode([len(transducer.texts), -1, -5, 10**9]) == "\ufffd" * 4
    rows = spark.createDataFrame([(1, [10**8, -1, None])], "doc_id long, ids array<int>")
    assert pieces.decode(rows, MODEL).first().text == "\ufffd" * 3


def test_a_very_long_text_and_word(spark, library):
    texts = ["word " * 200_000, "x" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in pieces.encode(docs, MODEL).collect()} == dict(enumerate(library.encode(texts)))


def test_nulls_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "one", None), (2, "one", None)], "doc_id long, text string, ids string")
    got = pieces.encode(docs, MODEL)
    assert got.columns == ["doc_id", "text", "ids"]
    assert sorted(map(repr, ((r.doc_id, len(r.ids)) for r in got.collect()))) == sorted(map(repr, [(1, 0), (None, 0), (2, 1), (2, 1)]))
    assert {(r.doc_id, r.text) for r in pieces.decode(got, MODEL).collect()} == {(1, ""), (None, ""), (2, "one")}
    assert pieces.encode(docs.limit(0), MODEL).count() == 0 and pieces.decode(got.limit(0), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first().text == ""
