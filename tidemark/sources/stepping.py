"""Stepping data (K04, S19): the windows and clusters of a source's track as one versioned document, kept as VARIANT, and read back with a check of its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version that is written. Documents without a version are of the first, which has the same fields.
VERSION = 2
#: The fields of windows and clusters, with their types.
WINDOW = {"delay_ms": "int", "raw_delay_ms": "double", "match_pct": "double", "start_s": "double", "accepted": "boolean"}
CLUSTER = {"cluster_id": "int", "mean_delay_ms": "double", "std_delay_ms": "double", "chunk_count": "bigint", "chunk_numbers": "array<int>", "raw_delays": "array<double>", "time_range": "array<double>", "mean_match_pct": "double", "min_match_pct": "double"}


def _struct(fields: dict[str, str]) -> str:
    return "array<struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">>"


def stepping_documents(windows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source_key, track_id, text): a document of JSON for each track, from windows(source_key, track_id, window_idx, WINDOW's fields) and clusters(source_key, track_id, CLUSTER's fields). A document is one value, so a track's windows meet in one row."""
    keys = ["source_key", "track_id"]
    listed = windows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("window_idx", *WINDOW))), lambda w: F.struct(*[w[n].cast(t).alias(n) for n, t in WINDOW.items()])).alias("windows"))
    grouped = clusters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(n).cast(t).alias(n) for n, t in CLUSTER.items()]))).alias("clusters"))
    both = listed.join(grouped, keys, "left").withColumn("clusters", F.coalesce("clusters", F.array().cast(_struct(CLUSTER))))
    return both.select(*keys, F.to_json(F.struct(F.lit(VERSION).alias("version"), "source_key", "track_id", "windows", "clusters")).alias("text"))


def save_stepping(documents: DataFrame, path: str, column: str = "text") -> None:
    """Keep documents as VARIANT; what is no JSON is kept as it came, in corrupt."""
    document = F.try_parse_json(column)
    documents.select(document.alias("document"), F.when(document.isNull(), F.col(column)).alias("corrupt")).write.mode("append").parquet(path)


def _problem(document: Column) -> Column:
    """What is wrong with a document; null if nothing is."""
    version = F.try_variant_get(document, "$.version", "int")
    has_version = F.variant_get(document, "$.version", "variant").isNotNull()

    def lacking(name: str, fields: dict[str, str]) -> list[Column]:
        rows, raw = F.try_variant_get(document, f"$.{name}", _struct(fields)), F.try_variant_get(document, f"$.{name}", "array<variant>")
        broken = F.exists(rows, lambda row: row.isNull() | F.greatest(*[row[f].isNull() for f in fields]))
        return [F.when(raw.isNull(), f"no list of {name}"), F.when(rows.isNull() | broken, f"{name} without all fields of their types")]

    return F.coalesce(
        F.when(document.isNull(), "no JSON"),
        F.when(has_version & (version.isNull() | ~version.isin(1, VERSION)), "a version that isn't known"),
        F.when(F.try_variant_get(document, "$.source_key", "string").isNull() | F.try_variant_get(document, "$.track_id", "int").isNull(), "no source or track"),
        *lacking("windows", WINDOW), *lacking("clusters", CLUSTER),
    )


def load_stepping(spark: SparkSession, path: str) -> DataFrame:
    """(source_key, track_id, windows, clusters, document, corrupt, problem): every document that was kept. One with a problem has null windows and clusters and is there nevertheless; fields that aren't known stay in document."""
    kept = spark.read.schema("document variant, corrupt string").parquet(path)
    problem = _problem(F.col("document"))
    value = lambda name, kind: F.try_variant_get("document", f"$.{name}", kind)
    sound = kept.withColumn("problem", problem)
    rows = lambda name, fields: F.when(F.col("problem").isNull(), value(name, _struct(fields))).alias(name)
    return sound.select(value("source_key", "string").alias("source_key"), value("track_id", "int").alias("track_id"), rows("windows", WINDOW), rows("clusters", CLUSTER), "document", "corrupt", "problem")


def stepping_windows(loaded: DataFrame) -> DataFrame:
    """(source_key, track_id, window_idx from 1, WINDOW's fields) of the sound documents."""
    return loaded.where("problem IS NULL").select("source_key", "track_id", F.posexplode("windows").alias("at", "w")).select("source_key", "track_id", (F.col("at") + 1).alias("window_idx"), "w.*")


def stepping_clusters(loaded: DataFrame) -> DataFrame:
    """(source_key, track_id, CLUSTER's fields) of the sound documents."""
    return loaded.where("problem IS NULL").select("source_key", "track_id", F.explode("clusters").alias("c")).select("source_key", "track_id", "c.*")
