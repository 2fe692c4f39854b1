"""Token files: the coding's round trip, and ids against whole texts' encodings."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens
from tidemark.session import shared_path, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=600), st.sampled_from([7, 64, 240, 4096]))
def test_blocks_round_trip(values, block):
    ids = np.array(values, dtype=np.uint64)
    words, per_block, exceptions = tokens.encode_blocks(ids, block)
    assert per_block.sum() == len(words)
    assert (tokens.decode_blocks(words, per_block, len(ids), exceptions, block) == ids).all()


def test_equal_small_ids_share_words():
    assert len(tokens.encode_blocks(np.zeros(4096, np.uint64))[0]) == -(-4096 // 120)
    assert len(tokens.encode_blocks(np.full(600, (1 << 15) - 1, np.uint64))[0]) == 150


def expected(rows, tokenizer=TOKENIZER, plain_specials=False):
    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = plain_specials
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def through_files(spark, docs, **more):
    folder = shared_path(spark, "tokens")
    tokens.write_token_files(docs, folder, more.pop("tokenizer", TOKENIZER), **more)
    return sorted((tuple(r) for r in tokens.read_token_files(spark, folder).collect()), key=lambda r: r[1])


def test_documents_come_back_as_the_library_encodes_them(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    assert through_files(spark, docs) == expected(sorted(tuple(r) for r in docs.collect()))


def test_small_files_and_blocks_give_the_same(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    assert through_files(spark, docs, max_ids=3000, block=128) == expected(sorted(tuple(r) for r in docs.collect()))


ODD = ["", " ", "  two  blanks ", "a\n\n b", "\n", " \n", "x \n y", "tab\tand\r\nline", "don't I'LL we've", "<|endoftext|>", "a <|endoftext|> b", "日本 語", " nb  sp", "1 22 333 4444", "é è́", "\U0001f600 \U0001f600", "a" * 5000, "...  !!! ,", "  em  ", "\x1c x \x1d", "\u0085 next", "' s 't 'll", "a word!!! a word?! a word$$$ word,, \n word.\nword. x's. x'. x.'s é... É) ß%% æ.b naïve*", "$$$ !a a!a a!!'t"]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    assert through_files(spark, spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


END = "<|endoftext|>"


@pytest.mark.parametrize("plain", (False, True))
def test_strings_of_special_tokens(spark, plain):
    texts = [END, END * 3, f"a {END} b", f"a\n\n{END}", f"{END}\n\nb", f"a {END}", f"{END} a", f"word!!!{END}word?", f"two  {END}  blanks", END[:-1], END[1:], f"<{END}>", f"'s{END}'s", f"\n{END}\n"]
    texts += [f"some words {END}" * 50, "nothing of the kind", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert through_files(spark, docs, plain_specials=plain) == expected(rows, TOKENIZER, plain)
    ids = Tokenizer.from_file(TOKENIZER).encode(END, add_special_tokens=False).ids
    assert ids == [50256] and np.frombuffer(tokens.ChunkEncoder(TOKENIZER, plain).encode([END])[0], "<u4").tolist() == (ids if not plain else [27, 91, 437, 1659, 5239, 91, 29])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"ab1 .,'\n\té日 st\r\x1f" * 2, END]), min_size=1, max_size=40).map("".join))
def test_chunks_encode_as_the_whole_text(text):
    if not _held:
        library = Tokenizer.from_file(TOKENIZER)
        _held.extend([library, tokens.ChunkEncoder(TOKENIZER)])
    library, own = _held
    assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


_held: list = []


def test_any_other_tokenizer_encodes_whole_texts(spark):
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.splits_at_blanks(TOKENIZER) and not tokens.splits_at_blanks(other)
    rows = [(i, t) for i, t in enumerate(ODD)]
    assert through_files(spark, spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=other) == expected(rows, other)


def test_a_very_long_text_spans_blocks(spark):
    rows = [(1, "short"), (2, "some words, and more. " * 20_000), (3, "after")]
    assert through_files(spark, spark.createDataFrame(rows, "doc_id long, text string"), max_ids=1000) == expected(rows)


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(2, "b", 1, "f"), (None, "a", 2, "f"), (2, "b", 3, "f"), (1, None, 4, "f")], "doc_id long, text string, start int, file string")
    assert through_files(spark, docs) == expected([(None, "a"), (1, None), (2, "b"), (2, "b")])
    assert through_files(spark, docs.limit(0)) == []


def test_files_hold_nothing_half_written(spark, tmp_path):
    writer = tokens.FileWriter(f"file://{tmp_path}/x.s8b")
    writer.add(1, np.arange(9, dtype="<u4").tobytes())
    assert not (tmp_path / "x.s8b").exists()
    writer.close()
    assert [p.name for p in Path(tmp_path).iterdir()] == ["x.s8b"]
    with pytest.raises(ValueError):
        list(tokens.read_documents(bytes(tokens.TRAILER.size)))
