"""The corpus pipeline: documents through five of the text operators, each stage on all that the one before kept.

In every stage a row without an id is a row like any other, columns beside doc_id,
text and source pass whatever their names and values, and an empty table gives an
empty table. What a stage does with nulls, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leaks, lines, pieces, quality, simhash
from tidemark.llm.common import keep_rows
from tidemark.session import delete_path, shared_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules and their hosts' verdicts keep. A null or empty text has no words and goes; repeated rows stay or go together."""
    return keep_rows(docs, quality.verdicts(docs).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have; n_chars follows the text. A null text becomes an empty one; repeated rows count as one document and all stay."""
    kept = lines.line_dedup(docs, min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles: that with the smallest doc_id, a null one before all. Null and empty texts are one group; of repeated rows one stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no item of benchmark. A null or empty text contains none; repeated rows stay or go together."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids of each document, and the hash of the text that the ids decode to. A null or empty text has no ids; repeated rows all stay."""
    model = pieces.default_model()
    encoded = pieces.encode(docs.select("doc_id", "source", "lang", "text"), model).drop("text")
    decoded = pieces.decode(encoded, model)
    return decoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece", sentencepiece),
]

#: SQL can express neither SimHash components nor the encoding; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again as the next one's input; what only the next stage needs is removed after it."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_path(spark, f"{folder}/{i - 1}")
    return docs
