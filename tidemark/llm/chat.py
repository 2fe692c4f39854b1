"""Operator 6: chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as its mark, its text and an end mark:

    ### role: text</turn>

A backslash in a role or text becomes \\s, an end mark \\/turn>, a mark's start \\#
and a blank, and a colon in a role \\c. So every backslash starts an escape, no
text can close a turn or open one, and replacing the escapes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_path, table

#: Fixed values of the template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("</turn>", "\\/turn>"), ("### ", "\\# "))
BACKSLASH, ESCAPED_BACKSLASH = "\\", "\\s"
COLON, ESCAPED_COLON = ":", "\\c"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A text in which no control string is left."""
    text = F.replace(text, F.lit(BACKSLASH), F.lit(ESCAPED_BACKSLASH))
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return F.replace(text, F.lit(ESCAPED_BACKSLASH), F.lit(BACKSLASH))


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one example for each assistant turn, with all turns before it as context.

    Only code points from loss_start (counted from 0) up to loss_end are trained:
    the reply's escaped text. A conversation that doesn't end with an assistant turn
    has one more example of all its turns, with an empty mask, so that no turn is
    lost. Turns are in order of turn, ties by role and text, repeated rows each.
    Null text or role: empty. A row with a null conv_id is a conversation of its own,
    with others like it. Roles other than assistant are context. An empty table gives an empty table; other
    columns are ignored, and very long texts stay whole. An example holds its whole context, so a conversation's
    output grows with the square of its turns, as the method has it.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv_id = F.col("conv_id").cast("long")
    own = F.when(conv_id.isNull(), F.xxhash64(turn)).alias("own")  # so that rows without an id don't make one group
    turns = conversations.groupBy(conv_id.alias("conv_id"), own).agg(F.sort_array(F.collect_list(turn)).alias("turns")).drop("own")

    def write(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(COLON), F.lit(ESCAPED_COLON)), F.lit(AFTER_ROLE))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == TRAINED_ROLE).alias("trained"))

    written = turns.select("conv_id", F.transform("turns", write).alias("parts"))
    whole = F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))
    places = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get(F.col("parts"), i - 1)["trained"] | (i == F.size("parts")))
    placed = written.select("conv_id", "parts", whole.alias("whole"), F.posexplode(places).alias("example", "at"))
    before = F.array_join(F.slice("whole", F.lit(1), F.col("at") - 1), "")
    own = F.get(F.col("parts"), F.col("at") - 1)
    made = placed.select("conv_id", F.col("example").cast("long").alias("example"), before.alias("before"), F.get(F.col("whole"), F.col("at") - 1).alias("own"), own.alias("last"))
    last = F.col("last")
    start = F.length("before") + F.length(last["head"])
    return made.select(
        "conv_id", "example", F.concat("before", "own").alias("text"),
        start.cast("long").alias("loss_start"),
        (start + F.when(last["trained"], F.length(last["body"])).otherwise(0)).cast("long").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """The turns (role, text) of an example's text."""
    pieces = F.split(text, CLOSE)

    def read(piece: Column) -> Column:
        at = F.instr(piece, AFTER_ROLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        return F.struct(unescape(F.replace(role, F.lit(ESCAPED_COLON), F.lit(COLON))).alias("role"), unescape(F.substring(piece, at + F.lit(len(AFTER_ROLE)), F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read from their text and mask alone; examples without a conv_id are told apart by their text."""
    reply = unescape(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    grouped = examples.withColumn("reply", reply).groupBy("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("text")).alias("own")).agg(
        F.max_by("text", "example").alias("text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return grouped.select("conv_id", parse_turns(F.col("text")).alias("turns"), "loss", "formatted_chars").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: Fixed values of the contract: conversation -7, whose texts hold control strings.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, with conversation -7, through written examples and back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = shared_path(spark, "op6-chat")
    format_examples(rows).write.parquet(path)
    return digest_examples(spark.read.parquet(path))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\s'), '</turn>', '\/turn>'), '### ', '\# ') AS body,
             replace(replace(replace(replace(role, '\', '\s'), '</turn>', '\/turn>'), '### ', '\# '), ':', '\c') AS head FROM t),
c AS (SELECT *, sum(14 + length(head) + length(body)) OVER o AS upto, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n
      FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
