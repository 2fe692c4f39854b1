"""Operator 10: quality rules with verdicts on hosts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.session import table

#: A word's separators, and the characters that count as symbols.
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """Where a document or a host fails. Shares are of words, or of lines that have a word."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_symbol_share: float = 0.3
    max_dup_line_share: float = 0.5
    min_word_chars: float = 2.0
    max_word_chars: float = 20.0
    #: A host is rejected if its shrunk failure rate, less this many standard deviations, is above max_host_rate.
    deviations: float = 2.0
    max_host_rate: float = 0.5
    #: Bounds of the prior's strength in documents.
    least_strength: float = 2.0
    most_strength: float = 1000.0


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more in the text.

    Windows are compared by a 64-bit hash of their words. A text whose hashes are
    all distinct is done; else sorting puts equal ones side by side.
    """

    def count(hashes: Column) -> Column:
        entries = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(rows: Column) -> Column:
            twice = F.filter(rows, lambda e, i: F.coalesce(F.get(rows, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == e["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(entries, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(hashes, count))


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of each row; key is a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col(host).cast("string").alias("host"), text.alias("text"))

    def measure(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeat_words(words).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD_CHAR))
    counts = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    measured = base.select(
        "doc_id", "key", "host",
        bind(F.array_remove(F.split(F.col("text"), BLANK_RUN), ""), measure).alias("w"),
        counts.alias("l"),
        F.regexp_count(F.col("text"), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    return measured.select("doc_id", "key", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def verdicts(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """features() with base_failed, failed, host_docs, host_rate and kept.

    base_failed: fewer than min_words words, or too many in repeated windows. failed:
    that, or too many symbols or repeated lines, or words that are too short or long
    on average. A host's rate of failed documents is shrunk towards a beta prior
    fitted to the rates of all hosts by their mean and variance (hosts of one
    document don't count in the variance). kept: not base_failed, on a host whose
    shrunk rate isn't surely above the limit.

    Null or empty text: no words, so base_failed. Rows with a null host form one
    host; a null doc_id is a row like any other. A very long text is measured whole.
    Repeated rows count each, and hosts that tie get the same verdict. An empty
    table gives an empty table. Columns other than doc_id, text and the host's are
    ignored, whatever their names.
    """
    seen = checkpointed(features(docs, host))
    words = F.col("n_words")
    base = (words < limits.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(100 * limits.max_repeat_share) * words)
    other = (F.col("n_symbols") > F.lit(limits.max_symbol_share) * words) | (F.col("n_dup_lines") > F.lit(limits.max_dup_line_share) * F.col("n_lines"))
    length = F.col("word_chars") / F.greatest(words, F.lit(1))
    judged = seen.withColumn("base_failed", base).withColumn("failed", base | other | (length < limits.min_word_chars) | (length > limits.max_word_chars))
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("mean"), F.var_pop(F.when(F.col("host_docs") > 1, rate)).alias("spread"))
    spare = F.col("mean") * (1 - F.col("mean"))
    strength = F.when(F.col("spread") > 0, F.least(F.greatest(F.try_divide(spare, F.col("spread")) - 1, F.lit(limits.least_strength)), F.lit(limits.most_strength))).otherwise(F.lit(limits.most_strength))
    rated = hosts.crossJoin(F.broadcast(prior.select("mean", strength.alias("strength"))))  # the prior is one row
    total = F.col("host_docs") + F.col("strength")
    rated = rated.withColumn("host_rate", (F.col("host_failed") + F.col("mean") * F.col("strength")) / total)
    lower = F.col("host_rate") - F.lit(limits.deviations) * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (total + 1))
    rated = rated.select(F.col("host").alias("__host"), "host_docs", "host_rate", (lower > limits.max_host_rate).alias("host_rejected"))
    rated = checkpointed(rated)  # a plain table, so that Spark may split a hot host's side of the join
    joined = judged.join(rated, F.col("host").eqNullSafe(F.col("__host")))
    return joined.select(*judged.columns, "host_docs", "host_rate", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             base_failed OR n_symbols > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines
             OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 20 AS failed FROM f),
h AS (SELECT source, count(*) AS n, sum(failed::INT) AS bad FROM j GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS m, var_pop(CASE WHEN n > 1 THEN bad / n END) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM p),
r AS (SELECT source, (bad + m * s) / (n + s) AS rate, rate - 2 * sqrt(rate * (1 - rate) / (n + s + 1)) > 0.5 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""
