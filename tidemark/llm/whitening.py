"""Operator 13: whitening of embeddings by Jacobi-Davidson on covariance products that Spark computes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.codes import usable
from tidemark.llm.common import arrow_map
from tidemark.session import shared_path, table

SCALE, SHIFT, DIMS, COMPONENTS = 64, 1_000_000, 64, 16
#: Vectors in a block of the fit list.
BLOCK = 4096
#: Residuals count as zero below so many roundings of the largest eigenvalue; eigenvalues below RANK of it have no component.
ROUNDINGS, RANK = 64, 1e-12
#: Steps of MINRES for one correction at most, and rounds of corrections at most.
INNER, OUTER = 4, 60

Product = Callable[[np.ndarray], np.ndarray]


def lattice(vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT):
    """Column of the longs floor(scale * c) + shift of a vector's components."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * scale) + shift).cast("long"))


@dataclass(frozen=True)
class Mean:
    """Number and sums of vectors of longs."""

    n: int
    sums: list[int]

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Rows of longs less the mean. The mean's whole part is taken off as a long, so nothing is lost to rounding before the difference."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest


@dataclass(frozen=True)
class Fit:
    """The distinct vectors as blocks of longs in a table, and their mean."""

    spark: SparkSession
    path: str
    dims: int
    mean: Mean

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of part(centred vectors) over all blocks. Tasks add up their own blocks; what is shuffled and collected is as large as the result."""
        size, dims, mean = int(np.prod(shape)), self.dims, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, any_block = np.zeros(size), False
            for batch in batches:
                for block in batch.column("x"):
                    x = np.frombuffer(block.as_py(), dtype="<i8").reshape(-1, dims)
                    sums += part(mean.moved(x)).ravel()
                    any_block = True
            if any_block:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], names=["place", "part"])

        blocks = self.spark.read.schema("x binary").parquet(self.path)
        found = arrow_map(blocks, run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
        out = np.zeros(size)
        for row in found:
            out[row.place] = row.part
        return out.reshape(shape)

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times the columns of u, from centred vectors, without the covariance itself."""
        return self.total(lambda x: x.T @ (x @ u), u.shape) / self.mean.n

    def trace(self) -> float:
        """The sum of the covariance's diagonal."""
        return float(self.total(lambda x: np.array([(x * x).sum()]), (1,))[0] / self.mean.n)


def fit_list(vectors: DataFrame, dims: int = DIMS, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Fit:
    """The distinct vectors of longs of the usable rows, written as blocks."""
    spark = vectors.sparkSession
    path = shared_path(spark, "whitening")
    distinct = vectors.where(usable(F.col(vector), dims)).select(lattice(vector, scale, shift).alias("x")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                held.append(part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8"))
                rows += part.num_rows
                if rows >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["x"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["x"])

    arrow_map(distinct, pack, "x binary").write.parquet(path)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            for block in batch.column("x"):
                x = np.frombuffer(block.as_py(), dtype="<i8").reshape(-1, dims)
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims)), pa.array([n, *sums], pa.int64())], names=["place", "part"])

    blocks = spark.read.schema("x binary").parquet(path)
    found = {r.place: int(r.part) for r in arrow_map(blocks, add, "place long, part long").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()}
    return Fit(spark, path, dims, Mean(found.get(-1, 0), [found.get(i, 0) for i in range(dims)]))


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what new adds to orthonormal bases; columns that add nothing go."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            for basis in (*bases, out):
                column = column - basis @ (basis.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size:
            column = column / left
            for basis in (*bases, out):
                column = column - basis @ (basis.T @ column)
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out


def corrections(product: Product, shifts: np.ndarray, fixed: list[np.ndarray], residuals: np.ndarray, reduce: float, steps: int) -> np.ndarray:
    """For each residual r an approximate t with (I - QQ')(A - s)(I - QQ') t = -r, Q its fixed basis, by MINRES.

    The equations run side by side, each with recurrences of its own; a step of all of
    them is one product with A. A column stops once its residual is reduced by reduce.
    """
    dims, count = residuals.shape
    project = lambda x, j: x - fixed[j] @ (fixed[j].T @ x)
    v = np.column_stack([project(-residuals[:, j], j) for j in range(count)])
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    v = v / np.where(beta > 0, beta, 1)
    before, t = np.zeros_like(v), np.zeros_like(v)
    w, w_before = np.zeros_like(v), np.zeros_like(v)
    cosine, sine, delta, epsilon = -np.ones(count), np.zeros(count), np.zeros(count), np.zeros(count)
    phi, going, lower = beta.copy(), beta > 0, np.zeros(count)
    for _ in range(steps):
        at = np.flatnonzero(going)
        if not len(at):
            break
        images = product(v[:, at])
        for k, j in enumerate(at):
            y = project(images[:, k] - shifts[j] * v[:, j], j) - lower[j] * before[:, j]
            alpha = v[:, j] @ y
            y = project(y - alpha * v[:, j], j)
            after = np.linalg.norm(y)
            turned, bar = cosine[j] * delta[j] + sine[j] * alpha, sine[j] * delta[j] - cosine[j] * alpha
            old_epsilon, epsilon[j], delta[j] = epsilon[j], sine[j] * after, -cosine[j] * after
            gamma = max(np.hypot(bar, after), np.finfo(float).tiny)
            cosine[j], sine[j] = bar / gamma, after / gamma
            w_new = (v[:, j] - old_epsilon * w_before[:, j] - turned * w[:, j]) / gamma
            w_before[:, j], w[:, j] = w[:, j].copy(), w_new
            t[:, j] += cosine[j] * phi[j] * w_new
            phi[j] *= sine[j]
            before[:, j], lower[j] = v[:, j], after
            if after <= 1e-14 * first[j] or phi[j] <= reduce * first[j]:
                going[j] = False
            else:
                v[:, j] = y / after
    return np.column_stack([project(t[:, j], j) for j in range(count)])


def eigenpairs(product: Product, dims: int, count: int, room: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, largest residual) of the count largest eigenvalues, falling, of a symmetric matrix that is only known by its products.

    Jacobi-Davidson: Rayleigh-Ritz in a subspace; the leading pairs whose residuals are
    down to rounding are locked and kept out of the subspace; the others' projected
    correction equations are solved by inner MINRES steps and widen it; beyond room
    columns it is begun again from its best vectors.
    """
    count = min(count, dims)
    spare = min(count + 4, dims)
    room = room or 3 * count
    start = np.random.default_rng(13).standard_normal((dims, spare))  # the same at every run
    basis = _orthonormal(start)
    images = product(basis)
    locked, values, worst = np.zeros((dims, 0)), [], 0.0
    largest, rounds = 0.0, 0
    while len(values) < count:
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, images @ turn
        largest = max([largest, *values[:1], theta[0] if len(theta) else 0.0])
        floor = ROUNDINGS * np.finfo(float).eps * largest
        wanted = min(count - len(values), len(theta))
        residuals = image[:, :wanted] - ritz[:, :wanted] * theta[:wanted]
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        good = 0
        while good < wanted and sizes[good] <= floor:
            good += 1
        if rounds >= OUTER and not good:
            raise RuntimeError(f"residual {sizes.max():.3g} did not reach {floor:.3g} in {OUTER} rounds")
        if good:
            worst = max(worst, float(sizes[:good].max()))
            locked = np.column_stack([locked, ritz[:, :good]])
            values += theta[:good].tolist()
            basis, images = ritz[:, good:], image[:, good:]
            theta, residuals, sizes = theta[good:], residuals[:, good:], sizes[good:]
            ritz, image = basis, images
        if len(values) == count:
            break
        rounds += 1
        open_ = [j for j in range(residuals.shape[1]) if sizes[j] > floor]
        if not open_:  # what is left of the subspace is exact, but no leading pair of it is wanted yet: widen it by anything new
            new = _orthonormal(np.random.default_rng(rounds).standard_normal((dims, 1)), locked, basis)
        else:
            fixed = [np.column_stack([locked, ritz[:, j]]) for j in open_]
            reduce = max(0.5**rounds, 1e-3)
            t = corrections(product, theta[open_], fixed, residuals[:, open_], reduce, INNER)
            if basis.shape[1] + len(open_) > room:
                keep = max(spare - len(values), 1)
                basis, images = ritz[:, :keep], image[:, :keep]
            new = _orthonormal(t, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(rounds).standard_normal((dims, 2)), locked, basis)
        if not new.shape[1]:  # nothing is left outside, so the pairs are as exact as the products are
            worst = max(worst, float(sizes.max(initial=0.0)))
            locked = np.column_stack([locked, ritz[:, : count - len(values)]])
            values += theta[: count - len(values)].tolist()
            break
        basis, images = np.column_stack([basis, new]), np.column_stack([images, product(new)])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], worst


@dataclass(frozen=True)
class Whitening:
    """Fit list, eigenvalues and unit eigenvectors of its covariance, trace, and the largest entry of the whitened covariance less the identity."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float


def train_whitening(vectors: DataFrame, components: int = COMPONENTS, dims: int = DIMS, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """Fits the leading components; there are fewer where the covariance has a smaller rank, none for fewer than two distinct vectors."""
    fit = fit_list(vectors, dims, vector, scale, shift)
    trace = fit.trace() if fit.mean.n else 0.0
    if trace <= 0:
        return Whitening(fit, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0, 0.0)
    values, found, residual = eigenpairs(fit.product, dims, components)
    keep = values > RANK * values[0]
    values, found = values[keep], found[:, keep]
    turn = found / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ turn
        return np.concatenate([w.sum(axis=0)[None, :], w.T @ w])

    sums = fit.total(moments, (k + 1, k)) / fit.mean.n
    covariance = sums[1:] - np.outer(sums[0], sums[0])  # the means are zero but for rounding
    return Whitening(fit, values, found, trace, float(np.abs(covariance - np.eye(k)).max()), residual)


def whiten(vectors: DataFrame, model: Whitening, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(ident, component from 1, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    mean, dims, turn, k, error = model.fit.mean, model.fit.dims, model.vectors / np.sqrt(model.values), len(model.values), model.identity_error
    rows = vectors.where(usable(F.col(vector), dims)).select(F.col(ident), lattice(vector, scale, shift).alias("x"))
    schema = T.StructType([T.StructField(ident, vectors.schema[ident].dataType), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    explained = (model.values / model.trace).tolist()

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S in whole numbers; null where a long can't hold one."""
        sums = []
        for row in x.tolist():
            d = sum((mean.n * a - s) ** 2 for a, s in zip(row, mean.sums))
            sums.append(d if d < 1 << 63 else None)
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                m = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(ident).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, mean.n)),
                    pa.array(deviations(x), pa.int64()).take(each), pa.array((mean.moved(x) @ turn).ravel()), pa.array(explained * m), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return arrow_map(rows, run, schema)


def whitening(vectors: DataFrame, components: int = COMPONENTS, dims: int = DIMS, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of vectors(ident, vector, ...) along the leading components of the distinct vectors' covariance.

    Entries become the longs floor(64 * c) + 1,000,000. Rows whose vector is null, has
    another length than dims, or holds a null or non-finite entry are dropped. Repeated
    vectors count once in the fit and are all given back; null ids stay null. A component
    whose eigenvalue is zero but for rounding has no direction and is left out, so constant
    tables, single rows and empty tables give no rows. deviation is null where a long can't
    hold it. Equal eigenvalues have no order of their own: any basis may come. Other
    columns, whatever their names and however long their texts, are not read.
    """
    return whiten(vectors, train_whitening(vectors, components, dims, vector), ident, vector)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings whitened along 16 components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitening(table(spark, sf_dir, "embeddings"))
