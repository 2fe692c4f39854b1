"""Operator 1: line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BLANKS, arrow_map, fresh, text_slices
from tidemark.session import delete_path, shared_path, table

_BLANKS = BLANKS.encode()
#: A line that is one in so many of all documents' lines, or commoner, isn't dealt out by its hash; so there are at most so many of them.
HOT_SHARE = 1000


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """128-bit hash of a line without its outer blanks and with A-Z lower-cased; None if fewer than min_chars code points are left."""
    key = line.strip(_BLANKS).lower()
    if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def document_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, key, line): the distinct keys of each row's lines, key a hash of its text; null or empty text has one empty line and so none."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                owners, lines = [], []
                for i, text in enumerate(texts):
                    keys = {line_key(x, min_chars) for x in text.encode().split(b"\n")} - {None}
                    owners += [i] * len(keys)
                    lines += keys
                owner = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(owner), part.column("key").take(owner), pa.array(lines, pa.binary())], names=["doc_id", "key", "line"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, explode, "doc_id long, key long, line binary")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Has Spark read runs by their buckets and rely on the order inside a bucket's one file."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class LineRuns:
    """Counts of line hashes as sorted runs on levels, each level's runs merged into the next once there are fanout of them.

    A run is a table (line, n), n the documents of one or more batches that hold the
    line, in fixed buckets by hash, one sorted file to each. So a batch, dealt out
    and sorted once, is merged with all runs side by side, and runs are merged with
    each other without a shuffle. Runs are never changed, only written whole and
    then replaced, so a task that is run again does no harm.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = 2):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _save(self, run: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        self.written += 1
        run.select("line", "n").write.bucketBy(self.buckets, "line").sortBy("line").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete_path(self.spark, f"{self.folder}/{name}")

    def _merged(self, a: str, b: str) -> DataFrame:
        """One row for each line of two runs, which are read side by side; to be planned under _sorted_scans."""
        left, right = (self.spark.table(name).select(F.col("line").alias(f"line_{i}"), F.col("n").alias(f"n_{i}")) for i, name in enumerate((a, b)))
        n = F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))
        return left.join(right, F.col("line_0") == F.col("line_1"), "full_outer").select(F.coalesce("line_0", "line_1").alias("line"), n.alias("n"))

    def _merge(self, names: list[str], level: int) -> None:
        """Replace runs, already taken off their levels, by one run of a level."""
        first, *others = names
        for i, other in enumerate(others):
            name = self._save(self._merged(first, other))
            self._drop([first, other])
            first = name
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(first)

    def unproven(self, counts: DataFrame) -> DataFrame:
        """The rows of counts (line, n) whose line the runs together don't yet prove frequent: a merge anti-join with all of them."""
        own, total = counts.repartition(self.buckets, "line").alias("own"), F.lit(0)
        for name in (n for level in self.levels for n in level):
            run = self.spark.table(name).select(F.col("line").alias(f"line_{name}"), F.col("n").alias(f"n_{name}"))
            own = own.join(run, F.col("own.line") == F.col(f"line_{name}"), "left")
            total = total + F.coalesce(f"n_{name}", F.lit(0))
        return own.where(total < self.min_docs).select("own.line", "own.n")

    def add(self, counts: DataFrame) -> None:
        """Merge-anti-join a batch's counts (line, n), one row for each line, against the runs, and add what is left as a run."""
        with _sorted_scans(self.spark):
            self.levels[0].append(self._save(self.unproven(counts)))
            level = 0
            while len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                level += 1
                self._merge(full, level)

    def frequent(self) -> DataFrame:
        """(line) of every hash whose counts reach min_docs; merges all runs into one for it."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "line binary")
        with _sorted_scans(self.spark):
            top = len(self.levels) - 1
            self.levels = [[] for _ in self.levels]
            self._merge(names, top)
        return self.spark.table(self.levels[top][0]).where(F.col("n") >= self.min_docs).select("line")

    def close(self) -> None:
        """Remove the runs."""
        self._drop([n for level in self.levels for n in level])
        self.levels = [[]]


def _lines_of_documents(lines: DataFrame, frequent: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, key, found): the frequent lines of each row of lines; counts has each line's documents by batch.

    Lines that one in HOT_SHARE of all rows of counts' documents have, of which there
    can be no more than HOT_SHARE, go to every task; the others are dealt out by line.
    """
    spark = lines.sparkSession
    totals = counts.groupBy("line").agg(F.sum("n").alias("n"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = totals.where((F.col("n") >= least) & (F.col("n") > 1)).join(frequent, "line", "left_semi").select("line").collect()
    hot = F.broadcast(spark.createDataFrame([(bytes(r.line),) for r in hot], "line binary"))  # at most HOT_SHARE rows
    rest = lines.join(hot, "line", "left_anti").join(frequent.join(hot, "line", "left_anti"), "line", "left_semi")
    return lines.join(hot, "line", "left_semi").unionByName(rest).groupBy("doc_id", "key").agg(F.collect_set("line").alias("found"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs without the lines whose key is found in at least min_docs documents; adds n_lines (before) and n_dropped.

    A document is all rows that share a doc_id: a repeated row counts no line again.
    Rows with a null doc_id are one document if they share their text. Null text: one
    empty line, and the result is an empty text. Lines with fewer than min_chars code
    points stay. Very long texts are split whole; a line's length doesn't matter, as
    only its hash is kept. An empty table gives an empty table. Other columns pass
    unchanged, whatever their names; columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "lines")
    document_lines(docs, min_chars).write.parquet(f"{folder}/lines")
    lines = spark.read.schema("doc_id long, key long, line binary").parquet(f"{folder}/lines")
    owner = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("key")).alias("unnamed")]
    owned = lines.select("line", *owner).distinct()
    batched = owned.groupBy(F.pmod(F.xxhash64("doc_id", "unnamed"), F.lit(batches)).alias("batch"), "line").agg(F.count(F.lit(1)).alias("n"))
    batched.write.partitionBy("batch").parquet(f"{folder}/batches")
    store = LineRuns(spark, folder, min_docs, fanout)
    counts = spark.read.schema("line binary, n long, batch int").parquet(f"{folder}/batches")
    for batch in range(batches):
        store.add(counts.where(F.col("batch") == batch).select("line", "n"))
    _lines_of_documents(lines, store.frequent(), counts).write.parquet(f"{folder}/found")
    store.close()
    for name in ("lines", "batches"):
        delete_path(spark, f"{folder}/{name}")
    found = spark.read.schema("doc_id long, key long, found array<binary>").parquet(f"{folder}/found")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    own_id, own_key, own_lines = (fresh(n, docs) for n in ("own_id", "own_key", "own_lines"))
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    found = found.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("found").alias(own_lines))
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)), "left").drop(own_id, own_key)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                kept, before, dropped = [], [], []
                for text, hot in zip(texts, part.column(own_lines).to_pylist()):
                    split = text.encode().split(b"\n")
                    hot = set(hot or ())
                    stay = [x for x in split if line_key(x, min_chars) not in hot] if hot else split
                    kept.append(b"\n".join(stay).decode())
                    before.append(len(split))
                    dropped.append(len(split) - len(stay))
                columns = {f.name: part.column(f.name) for f in schema.fields[:-2]}
                columns["text"] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=[f.name for f in schema.fields])

    return arrow_map(joined, drop, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without lines found in ten or more: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN h.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h USING (key) GROUP BY doc_id
"""
