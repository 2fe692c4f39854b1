"""What the operators share: Arrow maps, reliable checkpoints and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import delete_path, ensure_checkpoint_dir, shared_path, ship

#: White space of the text contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Texts of a batch that are handled at once inside a task.
BATCH_CHARS = 4_000_000
#: Edges of a graph that one task takes in a round of connected_components.
EDGES = 100_000


def release_memory() -> None:
    """Give back to the system what a finished task has freed, as its process waits for the next task and others need the memory meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package shipped to the executors first; a task's memory is given back after it."""
    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return frame.mapInArrow(run, schema)


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    kept = frame.checkpoint(eager=True)
    drop_unused(frame.sparkSession)
    return kept


def drop_unused(spark: SparkSession, share: float = 0.4) -> None:
    """Have the driver collect garbage if over a share of its memory is in use. Spark then removes the shuffles, checkpoints and classes of plans that nothing refers to any more; a chain of many small jobs makes many."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > share * runtime.maxMemory():
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def column_slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are about limit bytes each, so that a task never works on a whole batch of long texts at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """column_slices() with their texts as strings (null: empty)."""
    for part in column_slices(batch, column, limit):
        yield part, [t or "" for t in part.column(column).to_pylist()]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps: each points nodes at the smallest
    neighbour, so a hub's edges are spread over the rows of its neighbours and no
    group is collected. Every step is written to the shared folder and read back; it
    ends when a round changes nothing. Files have their own size, where a checkpoint
    keeps its plan's estimate, which each join squares: after a few rounds the driver
    reckons with numbers of millions of bits. A round has as many tasks as its edges
    need, as the driver keeps what it knows of every task. Nodes are compared as the
    column's own type; empty edges give no rows.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType
    folder = shared_path(spark, "components")

    def written(frame: DataFrame, step: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{step}")
        drop_unused(spark)
        return spark.read.schema(frame.schema).parquet(f"{folder}/{step}")

    try:
        current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        current = written(current, "edges-0")
        known = _digest(current)
        for n in range(1, max_rounds + 1):
            tasks = known[0] // EDGES + 1
            current = current.coalesce(tasks)
            both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # written first, so that the join's sides are plain shuffles and adaptive execution may split a hub
            least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), f"near-{n}")
            large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks), f"large-{n}")
            least = written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), f"least-{n}")
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            current = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), f"edges-{n}")
            for step in (f"edges-{n - 1}", f"near-{n}", f"large-{n}", f"least-{n}"):
                delete_path(spark, f"{folder}/{step}")
            now = _digest(current)
            if now == known:
                break
            known = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
        found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        return checkpointed(found.select(F.col("node").cast(kind), F.col("component").cast(kind)))
    finally:
        delete_path(spark, folder)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(row)


def row_id(columns: tuple[str, str] = ("doc_id", "text")) -> Column:
    """What tells rows apart: the id and a hash of the text. Structs compare null ids as equal."""
    return F.struct(F.col(columns[0]).cast("long").alias("doc_id"), F.xxhash64(columns[1]).alias("key"))


def fresh(name: str, frame: DataFrame) -> str:
    """name, with underscores in front until no column of frame is called so in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that are in kept(doc_id, key), with all their columns, whatever their names. Null ids match each other; repeated rows all stay."""
    row = fresh("row", docs)
    wanted = kept.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "key").alias(row)).distinct()
    return docs.withColumn(row, row_id()).join(wanted, row, "left_semi").drop(row)
