"""Operator 3: SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, checkpointed, connected_components, fresh, row_id, text_slices
from tidemark.session import table

SEED = 42
#: Links that are found before a task folds them into its forest.
FOLD = 500_000
#: Entries of a key that one task compares with each other; a larger key is cut into blocks.
BLOCK_ROWS = 20_000
#: Bytes of a group's shingle sets that one task compares, and of a block of a larger group; such a group has CUT blocks at least, so that its pairs are dealt to many tasks.
SMALL_BYTES, BLOCK_BYTES, CUT, SALTS = 100_000, 4_000_000, 24, 32
#: Bits of the parities that rule pairs out.
PARITY = 1024


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included: A-Z lower-cased, words split at ASCII white space, joined by a space; fewer words than size: the whole sequence; none: no hash."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    return np.array([digest(joined[a:b], SEED) for a, b in zip([0, *ends], (e - 1 for e in ends[size - 1 :]))], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Big-endian bits, each 1 if set in over half the hashes; more than 64 bits take further words from a mix of each hash; no hash: zero."""
    if not len(hashes):
        return bytes(bits // 8)
    words = []
    for k in range(bits // 64):
        mixed = hashes
        if k:
            mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(mixed), 100_000):
            ones += np.unpackbits(mixed[at : at + 100_000].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        words.append(np.packbits(ones * 2 > len(hashes)).tobytes())
    return b"".join(words)


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, sized: bool = False) -> DataFrame:
    """(doc_id, key, fingerprint) of each row; key is a hash of the text, for telling rows that share an id apart. sized: the bits are of the distinct shingles, and four bytes with their number and eight with a hash of their set follow, so that texts share a fingerprint only if they share all shingles."""

    def one(text: str) -> bytes:
        hashes = shingle_hashes(text, shingle)
        if not sized:
            return fingerprint(hashes, bits)
        hashes = np.unique(hashes)
        return fingerprint(hashes, bits) + len(hashes).to_bytes(4, "big") + xxhash.xxh64_digest(hashes.tobytes(), SEED)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([one(t) for t in texts], pa.binary())], names=["doc_id", "key", "fingerprint"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")), compute, "doc_id long, key long, fingerprint binary")


class Ring:
    """Segments of a fingerprint on a ring, with the pigeonring's budgets.

    If two fingerprints differ in at most threshold of their bits, some segment
    starts a chain in which the first l segments differ in at most l * threshold /
    segments bits, for every l. A key holds a chain's first segment, which must
    agree, and with flips the next one, which may differ in one bit. All links are
    found if the budgets are 0 and 1 there; with wider budgets links are found by
    the segments that agree, and how many is a matter of measurement.

    With ratio, fingerprints also end in their texts' sizes and shingle sets' hashes, and
    link only if the smaller size is at least ratio times the larger. Keys then name a size class, in
    which sizes differ by that ratio at most; each entry is in its own class and, as
    one that isn't compared with its like, in the next.
    """

    def __init__(self, bits: int, threshold: int, width: int, flips: bool, ratio: float | None = None):
        self.bits, self.threshold, self.width, self.flips, self.ratio = bits, threshold, width, flips, ratio
        self.bytes = bits // 8 + (12 if ratio else 0)
        self.segments = bits // width
        self.budgets = [n * threshold // self.segments for n in range(1, self.segments + 1)]
        self.complete = self.budgets[0] == 0 and (not flips or self.budgets[1] <= 1)

    def cut(self, prints: np.ndarray) -> np.ndarray:
        """Segments (n, segments) of fingerprints (n, bits / 8) as bytes."""
        ones = np.unpackbits(prints[:, : self.bits // 8], axis=1)[:, : self.segments * self.width].reshape(len(prints), self.segments, self.width)
        return ones.astype(np.int64) @ (1 << np.arange(self.width)[::-1])

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, role (0: as it is, 1: with a bit set that isn't) and row of each entry of the index."""
        cut = self.cut(prints)
        keys, roles, rows = [], [], []
        for i in range(self.segments):
            base = (i << 2 * self.width) | (cut[:, i] << self.width) if self.flips else (i << self.width) | cut[:, i]
            following = cut[:, (i + 1) % self.segments] if self.flips else np.zeros(len(cut), dtype=np.int64)
            keys.append(base | following)
            roles.append(np.zeros(len(cut), dtype=np.int8))
            rows.append(np.arange(len(cut)))
            for bit in range(self.width if self.flips else 0):
                own = np.flatnonzero(following >> bit & 1 == 0)
                keys.append(base[own] | following[own] | 1 << bit)
                roles.append(np.ones(len(own), dtype=np.int8))
                rows.append(own)
        key, role, row = np.concatenate(keys), np.concatenate(roles), np.concatenate(rows)
        if self.ratio:
            band = np.floor(np.log(np.maximum(self.sizes(prints), 1)) / -np.log(self.ratio)).astype(np.int64)[row]
            key = np.concatenate([band << 40 | key, band + 1 << 40 | key])
            role, row = np.concatenate([role, np.ones_like(role)]), np.concatenate([row, row])
        return key, role, row

    def sizes(self, prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints[:, self.bits // 8 : self.bits // 8 + 4]).view(">u4").ravel().astype(np.int64)

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The segment that a key's chain starts at."""
        return (keys & (1 << 40) - 1) >> (2 * self.width if self.flips else self.width)

    def linked(self, cut: np.ndarray, prints: np.ndarray, sizes: np.ndarray | None, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows keep within the budgets of their chain, if those lose no link, and then within the threshold."""
        alive = np.arange(len(a))
        if sizes is not None:
            alive = alive[np.minimum(sizes[a], sizes[b]) >= self.ratio * np.maximum(sizes[a], sizes[b])]
        total = np.zeros(len(a), dtype=np.int64)
        for n, budget in enumerate(self.budgets[:3] if self.complete else []):
            at = (start[alive] + n) % self.segments
            total[alive] += np.bitwise_count(cut[a[alive], at] ^ cut[b[alive], at])
            alive = alive[total[alive] <= budget]
        differ = np.bitwise_count(prints[a[alive]] ^ prints[b[alive]]).sum(axis=1, dtype=np.int64)
        return alive[differ <= self.threshold]


def _matrix(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    """A column of equally long byte strings as (n, width / size of kind)."""
    if not len(column):
        return np.zeros((0, width // np.dtype(kind).itemsize), dtype=kind)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


class _Forest:
    """Roots of a task's rows; the smallest row of a tree is its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def links(prints: DataFrame, ring: Ring, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links would, at most one for each fingerprint and run of buckets.

    prints(fingerprint) are distinct. Each goes into the index under its keys; rows
    of a key meet in one task, sorted, where only distinct fingerprints that agree
    in a key's bits are compared and a spanning forest of their links is kept. So
    copies never meet here, and no list of pairs leaves a bucket. A key of more than
    block_rows entries is compared by pairs of blocks, each in a task of its own.
    """
    width = ring.bytes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                column = batch.column("fingerprint").slice(at, 2000)
                keys, roles, rows = ring.keys(_matrix(column, width))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), column.take(pa.array(rows))], names=["key", "role", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(n).to_numpy() for n in ("key", "left", "right")], axis=1)
            fresh = (places, batch.column("role").to_numpy(), batch.column("block").to_numpy(), _matrix(batch.column("fingerprint"), width))
            held.append(fresh)
            size += len(places)
            first = held[0][0][0]
            if size < 50_000 or (first == places[-1]).all():
                continue
            whole = len(places) - int((places != places[-1]).any(axis=1)[::-1].argmax())  # the last key may go on in the next batch
            if (places == places[-1]).all():
                yield from found(*_joined(held[:-1]))
                held = [fresh]
            else:
                yield from found(*_joined([*held[:-1], tuple(x[:whole] for x in fresh)]))
                held = [tuple(x[whole:] for x in fresh)]
            size = len(held[0][0])
        if held:
            yield from found(*_joined(held))

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in ends], pa.binary()) for ends in (a, b)], names=["a", "b"])

    def found(places: np.ndarray, roles: np.ndarray, blocks: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        again = np.zeros(len(places), dtype=bool)
        again[1:] = (places[1:] == places[:-1]).all(axis=1)
        again[:-1] |= again[1:]
        places, roles, blocks, data = (x[again] for x in (places, roles, blocks, data))
        bucket = np.cumsum(np.append(True, (places[1:] != places[:-1]).any(axis=1))) if len(places) else np.zeros(0, np.int64)
        crossing = places[:, 1] != places[:, 2]  # two blocks of one key: only pairs between them
        distinct, local = np.unique(data.view(f"V{width}").ravel(), return_inverse=True) if len(data) else (data, np.zeros(0, np.int64))
        forest, cut, words = _Forest(len(distinct)), ring.cut(data), np.ascontiguousarray(data[:, : ring.bits // 8]).view(np.uint64)
        sizes = ring.sizes(data) if ring.ratio else None
        left, step, held, size = np.flatnonzero(roles == 0), 1, [], 0
        start = ring.first(places[:, 0])
        while len(left):
            left = left[left + step < len(bucket)]
            left = left[bucket[left] == bucket[left + step]]
            for at in range(0, len(left), FOLD):
                a = left[at : at + FOLD]
                b = a + step
                wanted = ~crossing[a] | (blocks[a] != blocks[b])
                a, b = a[wanted], b[wanted]
                hit = ring.linked(cut, words, sizes, start[a], a, b)
                held.append((local[a[hit]], local[b[hit]]))
                size += len(hit)
            if size >= FOLD or not len(left):
                forest.join(np.concatenate([x for x, _ in held] or [left]), np.concatenate([x for _, x in held] or [left]))
                held, size = [], 0
            step += 1
        forest.join(np.concatenate([x for x, _ in held] or [left]), np.concatenate([x for _, x in held] or [left]))
        while (forest.root[forest.root] != forest.root).any():
            forest.root = forest.root[forest.root]
        child = np.flatnonzero(forest.root != np.arange(len(distinct)))
        yield pairs(distinct[child], distinct[forest.root[child]])

    entries = arrow_map(prints.select("fingerprint"), index, "key long, role byte, fingerprint binary")
    dealt = _blocks(entries, block_rows)
    return arrow_map(dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "role"), compare, "a binary, b binary")


def _joined(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*held)]


def _blocks(entries: DataFrame, block_rows: int) -> DataFrame:
    """entries with the blocks (left, right) of their key that are to be compared, and their own block.

    A key of up to block_rows entries is one block, 0 with 0. A larger one is cut by
    its fingerprints' hash into blocks of about so many, and each pair of blocks is
    compared on its own, in any task: what a task holds doesn't grow with a key.
    """
    large = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    large = checkpointed(large.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    if large.isEmpty():
        return entries.select("*", F.lit(0).alias("block"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    cut = entries.join(large, "key", "left").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    return cut.select("key", "role", "fingerprint", "block", other).select("key", "role", "fingerprint", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fingerprint, codes): the distinct shingles of each row of texts(fingerprint, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in text_slices(batch):
                codes = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in own]
                yield pa.RecordBatch.from_arrays([part.column("fingerprint"), pa.array(codes, pa.list_(pa.int64()))], names=["fingerprint", "codes"])

    return arrow_map(texts.select("fingerprint", "text"), compute, "fingerprint binary, codes array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ratio."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("fingerprint").alias(end), F.col("codes").alias(f"codes_{end}")), end)
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    return pairs.where(both >= F.lit(ratio) * (F.size("codes_a") + F.size("codes_b") - both)).select("a", "b")


def _parity(codes: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY / 64): for each of n sets the parity of its codes that share their low bits. Two of these differ in no more bits than the sets do in codes."""
    out = np.zeros((n, PARITY // 8), dtype=np.uint8)
    for start in range(0, n, 500):
        own = (owners >= start) & (owners < start + 500)
        at = (owners[own] - start) * PARITY + (codes[own] & np.uint64(PARITY - 1)).astype(np.int64)
        out[start : start + 500] = np.packbits(np.bincount(at, minlength=min(500, n - start) * PARITY).reshape(-1, PARITY) & 1, axis=1)
    return out.view(np.uint64)


def alike_in_group(prints: np.ndarray, parts: np.ndarray, blocks: np.ndarray, codes: np.ndarray, bounds: np.ndarray, ring: Ring) -> list[tuple[int, int]]:
    """Links (row, row) of a spanning forest over all pairs of rows in one block, or in two different ones, that keep the ring's threshold and ratio and a Jaccard similarity of ratio between the sets codes[bounds[i]:bounds[i + 1]]; rows of one part are linked already.

    Pairs go by their distance, the nearest first, and those that are linked by then
    are passed over. Sets of that similarity differ in at most (1 - ratio) / (1 + ratio)
    of their codes together, so pairs whose parities differ in more bits are none; the
    rest are compared code by code.
    """
    words, sizes = np.ascontiguousarray(prints[:, : ring.bits // 8]).view(np.uint64), np.diff(bounds)
    parity = _parity(codes, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
    root = np.unique(parts, return_inverse=True)[1]
    tree = np.arange(root.max() + 1 if len(root) else 0)
    first = np.flatnonzero(blocks == blocks.min()) if len(blocks) else np.zeros(0, np.int64)
    second = np.flatnonzero(blocks != blocks.min()) if len(np.unique(blocks)) > 1 else first
    found = []

    def find(x: int) -> int:
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    for start in range(0, len(first), 100):
        while (tree[tree] != tree).any():
            tree = tree[tree]
        a = first[start : start + 100]
        differ = np.bitwise_count(words[a][:, None, :] ^ words[second][None, :, :]).sum(axis=2, dtype=np.int64)
        near = (differ <= ring.threshold) & (tree[root[a]][:, None] != tree[root[second]][None, :])
        if second is first:
            near &= a[:, None] < second[None, :]
        i, j = np.nonzero(near)
        distance, i, j = differ[i, j], a[i], second[j]
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        apart = np.zeros(len(i), dtype=np.int64)
        for at in range(0, len(i), 100_000):
            apart[at : at + 100_000] = np.bitwise_count(parity[i[at : at + 100_000]] ^ parity[j[at : at + 100_000]]).sum(axis=1, dtype=np.int64)
        fits = (small >= ring.ratio * large) & (apart * (1 + ring.ratio) <= (1 - ring.ratio) * (small + large) + 1e-6)
        order = np.argsort(distance[fits], kind="stable")
        for x, y in zip(i[fits][order].tolist(), j[fits][order].tolist()):
            p, q = find(root[x]), find(root[y])
            if p == q:
                continue
            own, other = codes[bounds[x] : bounds[x + 1]], codes[bounds[y] : bounds[y + 1]]
            place = np.searchsorted(own, other)
            both = int((own[np.minimum(place, len(own) - 1)] == other).sum()) if len(own) else 0
            if both >= ring.ratio * (len(own) + len(other) - both):
                tree[max(p, q)] = min(p, q)
                found.append((x, y))
    return found


def groups_apart(placed: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(group, part, fingerprint, blocks) of placed(group, part, fingerprint, n) in groups of more than one part; n is a set's codes, and blocks the number into which the group is to be cut. Rows of a group are dealt to SALTS tasks."""
    size = F.sum(8 * F.col("n") + 100)
    blocks = F.when(size <= SMALL_BYTES, 1).otherwise(F.greatest(F.lit(CUT), F.ceil(size / block_bytes))).cast("int")
    apart = placed.groupBy("group").agg(F.min("part").alias("least"), F.max("part").alias("most"), blocks.alias("blocks")).where("least <> most")
    apart = checkpointed(apart.select("group", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).cast("int"))
    return salted.join(apart, ["group", "salt"]).select("group", "part", "fingerprint", "blocks")


def links_in_groups(rows: DataFrame, ring: Ring) -> DataFrame:
    """(a, b): links of rows(group, part, fingerprint, blocks, codes) inside groups that join the same parts as all links of their similarity would; at most one for each row and task.

    A group is cut into blocks, and each pair of blocks is compared in a task of its
    own, which holds no more than two; only a forest leaves it.
    """
    width = ring.bytes
    cut = rows.withColumn("block", F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cut.select("group", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "part", "fingerprint", "codes")
    keys = ("group", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            places = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            ends = [*np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1, len(places)]
            start = 0
            for end in ends if len(places) else ():
                if last != (now := tuple(places[start].tolist())):
                    yield from found(held)
                    held, last = [], now
                held.append(batch.slice(start, end - start))
                start = end
        yield from found(held)

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held) < 2:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        column = {n: table.column(n).chunk(0) for n in ("block", "part", "fingerprint", "codes")}
        lists = column["codes"]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        pairs = alike_in_group(_matrix(column["fingerprint"], width), column["part"].to_numpy(), column["block"].to_numpy(), lists.flatten().to_numpy().view(np.uint64), bounds, ring)  # sets are in order of unsigned codes
        if pairs:
            ends = [column["fingerprint"].take(pa.array(x)) for x in zip(*pairs)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return arrow_map(dealt.repartition(*keys).sortWithinPartitions(*keys), compare, "a binary, b binary")


def verified_links(docs: DataFrame, prints: DataFrame, ring: Ring, shingle: int) -> DataFrame:
    """(a, b): links between distinct shingle sets whose Jaccard similarity is at least the ring's ratio, which join all that the ring's links of that similarity join.

    First one link of each fingerprint is held against the shingles. That settles
    the groups that those join whole, such as many copies of one text. In groups
    that fall apart, all pairs between two parts are held against them, block by
    block, and only a forest of links is kept.
    """
    nodes = prints.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "key")).alias("__row"))
    forest = checkpointed(links(nodes, ring))
    groups = checkpointed(connected_components(forest).select(F.col("node").alias("fingerprint"), F.col("component").alias("group")))
    rows = checkpointed(nodes.join(groups.select("fingerprint"), "fingerprint"))
    texts = docs.select(row_id().alias("__row"), F.col("text").cast("string").alias("text")).join(rows, "__row").dropDuplicates(["fingerprint"])
    sets = checkpointed(shingle_sets(texts, shingle))
    one = forest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))
    first = checkpointed(_alike(one, sets, ring.ratio))
    parts = connected_components(first).select(F.col("node").alias("fingerprint"), F.col("component").alias("part"))
    placed = groups.join(parts, "fingerprint", "left").select("fingerprint", F.xxhash64("group").alias("group"), F.xxhash64(F.coalesce("part", "fingerprint")).alias("part"))
    size = F.conv(F.hex(F.substring("fingerprint", ring.bits // 8 + 1, 4)), 16, 10).cast("int")  # fingerprints end in it and a hash
    placed = checkpointed(placed.withColumn("n", size))
    rows = checkpointed(groups_apart(placed)).join(sets, "fingerprint")
    return first.unionByName(links_in_groups(rows, ring))


def near_duplicates(docs: DataFrame, shingle: int = 3, ring: Ring | None = None) -> DataFrame:
    """(doc_id, key, fingerprint, root, component_id) of each row of docs(doc_id, text); component_id is the smallest doc_id of its component, root one of the component's fingerprints.

    Null or empty text: fingerprint zero, linked like any other. Null doc_ids take
    part but never name a component unless all of it is null. Repeated rows are in
    one component. Very long texts are read whole. With a ring that has a ratio, a
    link also needs that Jaccard similarity of the distinct shingles. An empty table
    gives an empty table. Other columns are ignored, whatever their names.
    """
    ring = ring or Ring(64, 3, 16, True)
    prints = checkpointed(fingerprints(docs, shingle, ring.bits, bool(ring.ratio)))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = connected_components(verified_links(docs, prints, ring, shingle) if ring.ratio else links(least, ring))
    rooted = checkpointed(least.join(roots, least["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = checkpointed(rooted.join(named, "root").select("fingerprint", "root", "component_id"))  # a plain table, so that Spark may split the copies of one fingerprint
    return prints.join(classes, "fingerprint").select("doc_id", "key", "fingerprint", "root", "component_id")


#: Candidates on five-word shingles: 256 bits of which at most 64 differ, and numbers of distinct shingles of a ratio of at least 0.8, as the Jaccard similarity of 0.8 needs that links are then held against. At that similarity 39 bits differ on average with a deviation of 6, so about one link in 100,000 has more than 64. The 25 segments of 10 bits find nearly all, as the tests measure, not provably all.
WIDE = Ring(256, 64, 10, False, 0.8)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, ring: Ring = WIDE) -> DataFrame:
    """docs with one row of each group of near duplicates, that with the smallest doc_id (a null one first), all columns as they are.

    Rows with the same doc_id and text are one row; cases as in near_duplicates.
    Other columns pass, whatever their names.
    """
    found, row = near_duplicates(docs, shingle, ring), fresh("row", docs)
    first = checkpointed(found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias(row)).select(row))
    return docs.withColumn(row, row_id()).join(first, row, "left_semi").dropDuplicates([row]).drop(row)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their SimHash and the smallest doc_id linked to it: doc_id, fingerprint, component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, Ring(64, 3, 16, True))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
