"""Operator 11: shards that all match the mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.session import shared_path, table

#: Rows are numbered inside bins of their order, BINS for each group of rows and for all; COARSE of them are summed first, so that no task adds up more than 256 counts.
BINS, COARSE = 65536, 256
SEED, SHARDS = 11, 16


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows(bin from 0 to BINS - 1, ...) with place, their number from 0 in their group, and total, the group's rows.

    order must begin with what bin was cut from. A group's bins are counted, the counts
    summed over two levels, and rows numbered inside their bin, so a group of any size
    is spread over as many tasks as it has bins.
    """
    coarse = F.floor(F.col("bin") / COARSE)
    counts = rows.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", coarse)
    sums = counts.groupBy(*group, "coarse").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group, F.lit(0))
    before = whole.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "coarse", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy(*group, "coarse").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "coarse", "bin", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("upper")).join(sums, [*group, "coarse"])
    starts = counts.select(*group, "bin", (F.col("lower") + F.col("upper")).alias("start"), "total")
    own = F.row_number().over(Window.partitionBy(*group, "bin").orderBy(*order)) - 1
    return rows.join(starts, [*group, "bin"]).withColumn("place", F.col("start") + own).drop("start", "bin")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with shard (from 0) and slot (from 0 without gaps): every shard has each source in the proportion that all rows have.

    Rows of a source are put in a seeded random order; the k-th of n has the fractional
    rank (2k - 1) / 2n. All rows are sorted by it, equal ranks by the same random order,
    and cut into shards whose counts are at most one apart. So a shard has within two of
    its share of every source, and within a shard the sources are interleaved.

    The order of a row hangs on the seed and its id alone. Rows with a null id, and rows
    that share an id, have no order of their own: they are told apart by where they stand
    in the table. A null source is a source. Texts play no part, whatever their length;
    null and empty ones are rows like others. Other columns pass unchanged, whatever
    their names; columns named shard or slot are replaced. An empty table gives an empty
    table. More shards than rows leave some shards empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    row, key = fresh("row", docs), fresh("key", docs)
    stand = F.monotonically_increasing_id()
    named = F.coalesce(F.col(ident).cast("string"), F.concat(F.lit("row "), stand.cast("string")))
    path = shared_path(spark, "shards")
    # written once, so that what numbers the rows and what moves them see the same rows, also after an executor is lost
    docs.withColumns({row: stand, key: F.md5(F.concat(F.lit(f"{seed}:"), named))}).write.parquet(path)
    kept = spark.read.parquet(path)
    slim = kept.select(F.col(row).alias("row"), F.col(key).alias("key"), F.struct(F.col(source).alias("source")).alias("stratum"))
    slim = slim.withColumn("bin", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    ranked = numbered(slim, ["stratum"], [F.col("key"), F.col("row")])
    fraction = (2 * F.col("place") + 1).cast("double") / (2 * F.col("total")).cast("double")
    ranked = ranked.select("row", "key", fraction.alias("fraction")).withColumn("bin", F.floor(F.col("fraction") * BINS).cast("int"))
    placed = numbered(ranked, [], [F.col("fraction"), F.col("key"), F.col("row")])
    cut = placed.withColumn("shard", F.expr(f"CAST(place * {shards} DIV total AS INT)"))
    cut = cut.select(F.col("row").alias(row), "shard", F.expr(f"place - (shard * total + {shards - 1}) DIV {shards}").alias("slot"))
    return kept.join(cut, row).drop(row, key)


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows with shard and slot as Parquet, a folder to each shard; a shard's files hold runs of its slots in order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 16 shards of equal counts and equal mixture: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


# crc32 bit by bit from its polynomial 0xEDB88320: eight steps make the table of a byte's remainders, and a fold over bytes does the rest.
OP11_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
folds AS (SELECT list(c ORDER BY byte) AS remainders FROM steps WHERE k = 8),
ranked AS (
  SELECT doc_id, source, text, md5('{SEED}:' || doc_id) AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id)) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * place + 1)::DOUBLE / (2 * n)::DOUBLE, key) - 1 AS pos, count(*) OVER () AS total FROM ranked)
SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
       xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: ('0x' || b)::BIGINT),
                       lambda a, b: xor(a >> 8, remainders[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, (pos * {SHARDS} // total)::INT AS shard, (pos - (pos * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM placed, folds
"""
