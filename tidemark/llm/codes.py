"""Operator 12: vectors as codes of their parts, each part's nearest entry found among those that its grid cell leaves over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map
from tidemark.session import shared_path, table

SCALE, DIMS, PARTS, ENTRIES, ROUNDS = 256, 64, 16, 64, 2
#: Integers beyond this size are refused, so that sums of squared distances fit a long.
LARGEST = 1 << 27
#: Cells that lie side by side over the span of a part's entries, cells that a task remembers for each part, and rows that it works on at once.
CELLS, REMEMBERED, ROWS = 8, 50_000, 4096


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has dims components, none of them null, infinite or not a number."""
    each = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & each, F.lit(False))


def scaled(column: pa.ListArray, dims: int, scale: int = SCALE) -> np.ndarray:
    """The vectors of a column as rows of floor(scale * x)."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(-1, dims)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} in size can't be coded")
    return x.astype(np.int64)


class Cells:
    """Nearest entries of one part. Space is cut into cubes; what a cube leaves over is worked out once and remembered.

    An entry is dominated in a cube if its least distance to the cube is more than
    another's greatest distance: it is nearest to no point there. Of the others, the
    nearest to each point is found exactly, the lower index first. A full memory is
    emptied, which costs time and changes nothing.
    """

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        self.entries = entries
        self.width = max(1, -(-int(np.ptp(entries, axis=0).max() + 1) // cells))
        self.memory: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Indexes of the entries that no other dominates, for each cell."""
        low = (cells * self.width)[:, None, :]
        high = low + self.width - 1
        nearest = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        farthest = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
        nearest, farthest = (nearest * nearest).sum(axis=2), (farthest * farthest).sum(axis=2)
        return [np.flatnonzero(keep) for keep in nearest <= farthest.min(axis=1, keepdims=True)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x."""
        cells = np.ascontiguousarray(x // self.width)
        keys, first, own = np.unique(cells.view(f"V{cells.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        keys = [key.tobytes() for key in keys]
        new = [i for i, key in enumerate(keys) if key not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(range(len(keys)))
        if new:
            self.memory.update(zip((keys[i] for i in new), self.candidates(cells[first[new]])))
        left = [self.memory[key] for key in keys]
        table = np.repeat(np.array([some[0] for some in left])[:, None], max(map(len, left)), axis=1)  # short lists are filled up with their first
        for row, some in zip(table, left):
            row[: len(some)] = some
        asked = table[own]
        apart = self.entries[asked] - x[:, None, :]
        apart = (apart * apart).sum(axis=2)
        best = apart.argmin(axis=1)
        rows = np.arange(len(x))
        return asked[rows, best], apart[rows, best]


def _coded(books: np.ndarray, cells: list[Cells], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes (n, parts), squared distances (n, parts)) of rows x."""
    width = books.shape[2]
    found = [part.nearest(x[:, i * width : (i + 1) * width]) for i, part in enumerate(cells)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, dims: int = DIMS, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids, ascending; null ids come last, equal ids by their vectors."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    first = rows.select(F.col(ident).alias("ident"), whole.alias("x")).orderBy(F.col("ident").asc_nulls_last(), "x").limit(entries).collect()
    x = np.array([r.x for r in first], dtype=np.int64)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} in size can't be coded")
    return x.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()


def _next_books(rows: DataFrame, books: np.ndarray, dims: int, vector: str, scale: int) -> np.ndarray:
    """Every entry replaced by the floor of its parts' mean; those that no part is nearest to stay. Tasks add up their own parts, so a row for each entry and task is shuffled."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = scaled(batch.column("vector"), dims, scale)
            for start in range(0, len(x), ROWS):
                some = x[start : start + ROWS]
                at = (_coded(books, cells, some)[0] + np.arange(parts) * entries).ravel()
                np.add.at(n, at, 1)
                np.add.at(sums, at, some.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    partial = arrow_map(rows.select(F.col(vector).alias("vector")), add, "entry long, n long, sums array<long>")
    total = partial.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = books.copy().reshape(parts * entries, width)
    for row in total.collect():  # one row for each entry of the codebooks
        out[row.entry] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return out.reshape(books.shape)


def train_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, width) of integers: started from the smallest ids, then rounds of assigning every part and replacing every entry by a mean. Fewer usable vectors than entries give as many entries."""
    if dims % parts:
        raise ValueError("parts must divide the dimensions")
    rows = vectors.where(usable(F.col(vector), dims))
    books = first_books(rows, parts, entries, dims, ident, vector, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = _next_books(rows, books, dims, vector, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The usable rows of vectors with code array<int>, an index for each part, and error, the squared distances summed over parts; both replace columns so called."""
    parts, entries, width = books.shape
    dims = DIMS if not entries else parts * width
    vectors = vectors.drop(*[c for c in vectors.columns if c.lower() in ("code", "error")])
    rows = vectors.where(usable(F.col(vector), dims))
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not entries:
        return vectors.sparkSession.createDataFrame([], schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                code, error = _coded(books, cells, scaled(part.column(vector), dims, scale))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * parts), pa.array(code.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(error.sum(axis=1))], names=names)

    return arrow_map(rows, run, schema)


def decode(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for: the middles of its entries' components."""
    entries = F.array(*[F.array(*[F.array(*[F.lit((int(c) + 0.5) / scale) for c in entry]) for entry in book]) for book in books])
    return F.flatten(F.transform(code, lambda index, part: F.get(F.get(entries, part), index)))


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows with code and error, codebooks) of vectors(ident, vector, ...): a part's nearest entry by squared distance between integers, ties to the lower index.

    Rows whose vector is null, has another length than dims, or holds a null or
    non-finite component are dropped. Components beyond LARGEST / scale in size are an
    error. Repeated rows count each and all stay; null ids come last where codebooks
    start. No usable vector gives no rows and codebooks without entries. Other columns
    pass unchanged, whatever their names, texts of any length among them.
    """
    books = train_books(vectors, parts, entries, rounds, dims, ident, vector, scale)
    return encode(vectors, books, vector, scale), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 16 indexes of 64 entries: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    path = shared_path(spark, "codes")
    digits = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    coded.select("vec_id", "label", digits.alias("code"), "error").write.parquet(path)  # read twice below
    coded = spark.read.parquet(path)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    mean = ", ".join(f"coalesce((s{c} - (s{c} % n + n) % n) // n, e.{c})::BIGINT AS {c}" for c in "abcd")
    apart = " + ".join(f"(p.{c} - e.{c}) * (p.{c} - e.{c})" for c in "abcd")
    found = f"m{i} AS MATERIALIZED (SELECT vec_id, part, label, p.a, p.b, p.c, p.d, min(({apart}) * {ENTRIES} + entry) AS m FROM p JOIN b{i} e USING (part) GROUP BY ALL)"
    if i == ROUNDS:
        return found
    sums = ", ".join(f"sum({c}) AS s{c}" for c in "abcd")
    return f"""{found},
b{i + 1} AS MATERIALIZED (SELECT e.part, e.entry, {mean} FROM b{i} e LEFT JOIN (SELECT part, m % {ENTRIES} AS entry, count(*) AS n, {sums} FROM m{i} GROUP BY 1, 2) s ON s.part = e.part AND s.entry = e.entry)"""


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS} AND len(embedding) = {DIMS}),
p AS MATERIALIZED (SELECT vec_id, label, part::BIGINT AS part, x[4 * part + 1] AS a, x[4 * part + 2] AS b, x[4 * part + 3] AS c, x[4 * part + 4] AS d FROM v, range({PARTS}) t(part)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, a, b, c, d FROM p JOIN k USING (vec_id)),
{", ".join(map(_round, range(ROUNDS + 1)))},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM m{ROUNDS} GROUP BY 1, 2),
digest AS (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
