"""Session helpers: building a session, shipping the package, finding the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Bytes of files from which a table is large, and bytes and rows of a large one in one task.
LARGE, TASK, ROWS = 64 << 20, 8 << 20, 300_000


def build_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter configures its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it there."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, Path(_PACKAGE.name) / path.relative_to(_PACKAGE))
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in a local session where none is set, as in tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir."""
    base = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or base
    return os.path.join(named, f"{name}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path that shared_path gave, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(spark: SparkSession, sf_dir: str, name: str, *keys: str, like: str | None = None):
    """A table by keys, for what is done within each key. The rows of a large one go to a task for each TASK bytes of its files or for each ROWS, as files of like rows are small, so that what a task sorts doesn't grow with the table; Spark's own number of tasks, which it lessens to that of the cores, does for a small one. like: the table that this one is to meet by these keys, in whose tasks it is put."""
    rows, sized = table(spark, sf_dir, name), like or name
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{sized}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if size < LARGE:
        return rows
    return rows.repartition(max(size // TASK, table(spark, sf_dir, sized).count() // ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
