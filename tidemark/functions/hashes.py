"""Hashes of grids of grey pixels (F01, F03): neighbours after the nearest pixel, and means, differences and cosine transforms after a windowed-sinc resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

#: Lobes of the resampling window.
LOBES = 3


def nearest_difference(pixels: Column, width: int, height: int) -> Column:
    """64 bits of a grid in rows of width: of 9 by 8 nearest pixels, whether each is less than the one to its right, the first as the lowest bit."""
    pixel = lambda x, y: F.get(pixels, F.lit(y * height // 8 * width + x * width // 9))
    bits = [F.when(pixel(x, y) < pixel(x + 1, y), F.shiftleft(F.lit(1).cast("long"), y * 8 + x)).otherwise(F.lit(0).cast("long")) for y in range(8) for x in range(8)]
    return F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def resampling(size: int, wanted: int) -> np.ndarray:
    """(wanted, size): the weights by which each wanted pixel takes the given ones, from a sinc under LOBES lobes of a wider one, stretched where pixels are merged."""
    if size == wanted:
        return np.eye(size)
    ratio = size / wanted
    stretch = max(ratio, 1.0)
    centre = (np.arange(wanted) + 0.5) * ratio
    left = np.clip(np.floor(centre - LOBES * stretch), 0, size - 1)
    right = np.clip(np.ceil(centre + LOBES * stretch), left + 1, size)
    at = np.arange(size)
    apart = (at - (centre - 0.5)[:, None]) / stretch
    weights = np.where((at >= left[:, None]) & (at < right[:, None]) & (np.abs(apart) < LOBES), np.sinc(apart) * np.sinc(apart / LOBES), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resampled(grids: np.ndarray, height: int, width: int) -> np.ndarray:
    """(n, height, width) of grids (n, rows, columns): rows, then columns, then whole grey values from 0 to 255."""
    made = resampling(grids.shape[1], height) @ grids @ resampling(grids.shape[2], width).T
    return np.clip(np.floor(np.round(made, 9) + 0.5), 0, 255)


def difference_bits(grids: np.ndarray, size: int) -> np.ndarray:
    """Whether each pixel of size + 1 by size is less than the one to its right."""
    made = resampled(grids, size, size + 1)
    return (made[:, :, :-1] < made[:, :, 1:]).reshape(len(grids), -1)


def mean_bits(grids: np.ndarray, size: int) -> np.ndarray:
    """Whether each pixel of size by size is the mean at least."""
    made = resampled(grids, size, size).reshape(len(grids), -1)
    return made >= made.mean(axis=1, keepdims=True)


def cosine_bits(grids: np.ndarray, size: int) -> np.ndarray:
    """Whether each of the lowest size by size waves of 4 size by 4 size pixels is over the median of all but the first."""
    n = 4 * size
    waves = np.cos(np.pi * np.outer(np.arange(size), 2 * np.arange(n) + 1) / (2 * n))
    made = np.round((waves @ resampled(grids, n, n) @ waves.T).reshape(len(grids), -1), 6)
    return made > np.median(made[:, 1:], axis=1, keepdims=True)


METHODS = {"dhash": difference_bits, "average_hash": mean_bits, "phash": cosine_bits}


def hexadecimal(bits: np.ndarray) -> list[str]:
    """Rows of bits as hexadecimal digits, four bits each, the first the highest; the last digit may have fewer."""
    padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 4))).reshape(len(bits), -1, 4)
    return ["".join(f"{d:x}" for d in row) for row in padded @ np.array([8, 4, 2, 1])]


def grid_hashes(rows: DataFrame, pixels: str, width: int, height: int, size: int = 8, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """rows with a column of hexadecimal digits for each method of F03, of pixels: whole numbers from 0 to 255 in rows of width. A grid that is null, has a null or another number of pixels has null hashes."""
    ship(rows.sparkSession)
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"no hash {unknown[0]}; there are {', '.join(METHODS)}")
    rows = rows.drop(*methods)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(m, T.StringType()) for m in methods]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(pixels).to_pylist()
            sound = [i for i, g in enumerate(given) if g is not None and len(g) == width * height and None not in g]
            grids = np.array([given[i] for i in sound], dtype=float).reshape(-1, height, width)
            columns = []
            for m in methods:
                out: list[str | None] = [None] * len(given)
                for i, digits in zip(sound, hexadecimal(METHODS[m](grids, size)) if sound else ()):
                    out[i] = digits
                columns.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
