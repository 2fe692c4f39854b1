"""Chat formatting: what is written reads back, and only replies are trained."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.llm.chat import digest_examples, escape, format_examples, parse_turns, unescape

HARD = ["", "\\", "\\s", "</turn>", "\\/turn>", "### assistant: x", "### ### ", "\\# ", "</turn>\n### user: hi</turn>\n", "\\\\s\\c", "a: b", "</turn</turn>>", "\n", "日本\U0001f600", "#### ", "\\c"]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rows = [(a + b,) for a in HARD for b in HARD]
    out = spark.createDataFrame(rows, "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and "</turn>" not in r.e and "### " not in r.e for r in out)


def test_every_reply_is_an_example_and_is_all_that_is_trained(spark):
    turns = [("system", "be kind"), ("user", HARD[8]), ("assistant", HARD[5]), ("a: b", "x"), ("user", "q\\"), ("assistant", ""), ("assistant", "last"), ("user", "bye")]
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    examples = format_examples(frame).orderBy("example").collect()
    assert [e.text[e.loss_start : e.loss_end] for e in examples[:3]] == ["\\# assistant: x", "", "last"]
    assert len(examples) == 4 and examples[3].loss_start == examples[3].loss_end
    read = format_examples(frame).select("example", parse_turns(F.col("text")).alias("turns")).orderBy("example").collect()
    assert [[tuple(t) for t in r.turns] for r in read] == [turns[:3], turns[:6], turns[:7], turns]


def test_digests_nulls_ties_and_clashing_columns(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "b", "x"), (1, 1, "assistant", "a", "y"), (1, 1, "assistant", "a", "y"), (None, None, None, None, None), (None, 0, "assistant", "z", "x"), (None, 0, "assistant", "y", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    digests = digest_examples(format_examples(frame)).collect()
    got = {r.conv_id: r for r in digests}
    said = [("user", ""), ("", "b"), ("assistant", "a"), ("assistant", "a")]
    assert got[1].n_turns == 4 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"aa").hexdigest()
    assert sorted((r.n_turns, r.loss_chars) for r in digests if r.conv_id is None) == [(1, 0), (1, 1), (1, 1)]
    assert format_examples(frame.limit(0)).count() == 0


def test_a_long_conversation(spark):
    frame = spark.range(400).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.repeat(F.lit("t "), 500).alias("text"))
    got = digest_examples(format_examples(frame)).first()
    assert got.n_turns == 400 and got.loss_chars == 200 * 1000
