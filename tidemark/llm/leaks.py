"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, text_slices
from tidemark.session import table

SHINGLE = 5
CONTAINMENT = 0.8
#: Minima of each signature. One minimum is a band: windows are at most four times as large as an item, so a window that has four fifths of an item shares none of 48 minima with it once in 20,000 times at most.
MINIMA = 48
#: Items of up to so many shingles are found by the shingles themselves, none missed.
SMALL = 8
#: Characters of items that a task holds at once; more items are searched in further blocks.
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 16
_LOW = np.uint64((1 << _FILTER_BITS) - 1)


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


def shingle_codes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit codes of the runs of size words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    codes = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ codes >> np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(4).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Item:
    """A test item: its id, the words of a shingle, and its distinct shingles by code."""

    item_id: int | None
    size: int
    shingles: dict[int, bytes]

    @classmethod
    def of(cls, item_id: int | None, text: str) -> Item | None:
        words = words_of(text)
        if not words:
            return None
        size = min(SHINGLE, len(words))
        codes = shingle_codes(word_hashes(words), size).tolist()
        return cls(item_id, size, {c: b" ".join(words[i : i + size]) for i, c in enumerate(codes)})


def _sorted_band(values: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, their items, and a table of the values' low bits that sorts most others out."""
    order = np.argsort(values)
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[(values & _LOW).astype(np.int64)] = True
    return values[order], members[order], seen


def _met(values: np.ndarray, band: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Place of each value that the band has, with its items."""
    known, members, seen = band
    near = np.flatnonzero(seen[(values & _LOW).astype(np.int64)])
    left, right = np.searchsorted(known, values[near], "left"), np.searchsorted(known, values[near], "right")
    for n, a, b in zip(near[left < right], left[left < right], right[left < right]):
        yield n, members[a:b]


class ItemIndex:
    """Small items by their shingles, and larger ones by size class, each class with the minima of its items' signatures.

    A class holds the items of more than limit / 2 and at most limit shingles. A text
    is searched in windows of 2 * limit shingles that start every limit, so an item's
    passage lies whole in some window, and their similarity is far above what the
    signatures miss. An item of n <= SMALL shingles may lack n - ceil(containment * n)
    of them, so a text that contains it has one of any so many and one more: those,
    the least by code, are looked up.
    """

    def __init__(self, items: list[Item], containment: float = CONTAINMENT, minima: int = MINIMA):
        self.items, self.containment, self.factors = items, containment, _factors(minima)
        self.classes: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.small: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_class: dict[tuple[int, int], list[int]] = {}
        looked_up: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            n = len(item.shingles)
            if n <= SMALL:
                lacking = sum(k < containment * n for k in range(1, n + 1))  # sizes of a share that isn't enough
                looked_up.setdefault(item.size, []).extend((c, i) for c in sorted(item.shingles)[: n - lacking])
            else:
                by_class.setdefault((item.size, 1 << (n - 1).bit_length()), []).append(i)
        for size, entries in looked_up.items():
            codes, members = np.array([c for c, _ in entries], dtype=np.uint64), np.array([i for _, i in entries])
            self.small[size] = _sorted_band(codes, members)
        for key, members in by_class.items():
            codes = [np.array(list(items[i].shingles), dtype=np.uint64) for i in members]
            self.classes[key] = [_sorted_band(np.array([(c * factor).min() for c in codes], dtype=np.uint64), np.array(members)) for factor in self.factors]

    def search(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text, the (item, shared shingles) of every item that it contains."""
        words = [words_of(t) for t in texts]
        hashes = word_hashes([w for ws in words for w in ws])
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        candidates: list[set[int]] = [set() for _ in texts]
        codes_of: dict[int, list[np.ndarray]] = {}
        for size in {s for s, _ in self.classes} | set(self.small):
            codes_of[size] = [shingle_codes(hashes[a:b], size) for a, b in zip(bounds[:-1], bounds[1:])]
            lengths = np.array([len(c) for c in codes_of[size]])
            if not lengths.sum():
                continue
            self._collect(size, np.concatenate(codes_of[size]), lengths, candidates)
        found = []
        for i, own in enumerate(candidates):
            kept = []
            for j in sorted(own):
                shared = self._shared(self.items[j], words[i], codes_of[self.items[j].size][i])
                if shared >= self.containment * len(self.items[j].shingles):
                    kept.append((j, shared))
            found.append(kept)
        return found

    def _collect(self, size: int, codes: np.ndarray, lengths: np.ndarray, candidates: list[set[int]]) -> None:
        """Add the small items of which a text has a shingle that is looked up, and the larger ones that share a minimum with a window of it."""
        if size in self.small:
            owner = np.repeat(np.arange(len(lengths)), lengths)
            for n, members in _met(codes, self.small[size]):
                candidates[owner[n]].update(members.tolist())
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        plans = {}
        for limit in (x for s, x in self.classes if s == size):
            blocks = -(-lengths // limit)
            owner = np.repeat(np.arange(len(lengths)), blocks)
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            follows = np.append(owner[1:] == owner[:-1], False)
            plans[limit] = (starts[owner] + rank * limit, owner, follows)
        for k, factor in enumerate(self.factors if plans else []):
            values = codes * factor
            for limit, (at, owner, follows) in plans.items():
                low = np.minimum.reduceat(values, at)
                low[:-1] = np.where(follows[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                for n, members in _met(low, self.classes[size, limit][k]):
                    candidates[owner[n]].update(members.tolist())

    @staticmethod
    def _shared(item: Item, words: list[bytes], codes: np.ndarray) -> int:
        """Distinct shingles of the item that the text has, compared as words."""
        own = np.fromiter(item.shingles, dtype=np.uint64)
        places = np.flatnonzero(np.isin(codes, own))
        wanted = set(item.shingles.values())
        return len({s for p in places.tolist() if (s := b" ".join(words[p : p + item.size])) in wanted})


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items of benchmark(item_id, text) in blocks of about limit characters, so that what a task holds is bounded however many there are."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [i for i in (Item.of(r.item_id, r.text) for r in part.toLocalIterator()) if i]


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for each row of docs and each item of which it has at least the containment of distinct shingles.

    Shingles are five words; an item with fewer words is one shingle of all its
    words, and an item without words or with null text is never found. Null or
    empty documents contain nothing. Repeated documents are found each, repeated
    items once. A very long text is searched whole, in windows. Items that share
    text are each found. Empty tables give an empty table; other columns are
    ignored. The documents are read once for each block of items.
    """
    schema = "doc_id long, item_id long, n_shared long, n_shingles long"
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, block_chars):
        out = out.unionByName(arrow_map(source, _pairs(spark.sparkContext.broadcast(items), containment), schema))
    return out


def _pairs(items, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value, containment)
        for batch in batches:
            for part, texts in text_slices(batch):
                rows = [(d, index.items[j].item_id, n, len(index.items[j].shingles)) for d, own in zip(part.column("doc_id").to_pylist(), index.search(texts)) for j, n in own]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_shingles"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that contain no item, all columns as they are; cases as in contained_items. No row moves: each block of items is a filter over the documents."""
    for items in item_blocks(benchmark, block_chars):
        docs = arrow_map(docs, _clean(docs.sparkSession.sparkContext.broadcast(items), containment), docs.schema)
    return docs


def _clean(items, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value, containment)
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array([not own for own in index.search(texts)], pa.bool_()))

    return run


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents that contain items of benchmark: doc_id, item_id, n_shared, n_shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
g AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM s)))
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles
FROM g JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)
"""
