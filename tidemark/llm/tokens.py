"""Operator 5: token ids in a Simple-8b file format.

File (little-endian): blocks of 64-bit words, then a table of exceptions, then the
footer's sections and a fixed trailer.

    words        uint64 each: selector in the low 4 bits, values above it
    exceptions   uint64 each: values of more than 60 bits, named by selector 0
    offsets      uint64 for each block: its first word
    doc ids      int64 for each document
    doc nulls    uint8 for each document: 1 if its id is null
    doc lengths  uint64 for each document: its ids
    trailer      magic, block size, numbers of ids, documents, words, exceptions

No value crosses a block, so any range of blocks decodes alone, in whole arrays.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, column_slices
from tidemark.session import shared_path, table

#: Fixed values of the coding: by selector, how many values a word holds and the bits of each. Selector 0 names an exception.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
BLOCK = 4096
#: Blocks that are coded or decoded at once.
STRIDE = 192
TRAILER = struct.Struct("<8sQQQQQ")
MAGIC = b"TIDES8B1"
#: Distinct chunks whose ids a task keeps; of more, the newer half stays.
MEMO = 1_000_000
END_ID = 2

_loaded: dict = {}


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 64 if over 60."""
    if not values.size or values.max() < len(_WIDTHS):
        return _WIDTHS[values.astype(np.int64)]
    halves = np.where(values >> np.uint64(32) > 0, np.frexp((values >> np.uint64(32)).astype(np.float64))[1] + 32, np.frexp(values.astype(np.float64))[1])
    return np.where(halves > 60, 64, halves).astype(np.uint8)


_WIDTHS = np.frexp(np.arange(1 << 18, dtype=np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, and exceptions of ids (uint64), block by block."""
    n_blocks = -(-len(ids) // block)
    reach = int(COUNTS.max())
    grid = np.zeros((n_blocks, block + reach), dtype=np.uint64)
    filled = np.zeros(n_blocks * block, dtype=np.uint64)
    filled[: len(ids)] = ids
    grid[:, :block] = filled.reshape(n_blocks, block)
    widths = _widths(grid)
    choice = np.where(widths[:, :block] > 60, 0, 15).astype(np.uint8)
    widest = widths.copy()
    by_count = {int(c): s for s, c in enumerate(COUNTS) if s and c > 1}
    for n in range(2, reach + 1):
        widest[:, : block + reach - n + 1] = np.maximum(widest[:, : block + reach - n + 1], widths[:, n - 1 :])
        if n in by_count:
            fits = widest[:, :block] <= BITS[by_count[n]]
            if n > 8 and not fits[:, : block - n].any():
                break  # longer runs don't fit either, but where a block ends
            choice[fits] = by_count[n]
    left = np.full(n_blocks, block, dtype=np.int64)
    if n_blocks:
        left[-1] = len(ids) - (n_blocks - 1) * block
    at = np.zeros(n_blocks, dtype=np.int64)
    rows, starts, selectors = [], [], []
    live = np.arange(n_blocks)
    while len(live):  # a word of every block at a time
        chosen = choice[live, at[live]]
        rows.append(live)
        starts.append(at[live])
        selectors.append(chosen)
        at[live] += COUNTS[chosen]
        live = live[at[live] < left[live]]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    step = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row = np.concatenate(rows)
    per_block = np.bincount(row, minlength=n_blocks)
    order = np.empty(len(row), dtype=np.int64)
    order[(np.cumsum(per_block) - per_block)[row] + step] = np.arange(len(row))
    row, start, selector = row[order], np.concatenate(starts)[order], np.concatenate(selectors)[order]
    words = selector.astype(np.uint64)
    exceptions = np.zeros(0, np.uint64)
    for s in range(16):
        own = np.flatnonzero(selector == s)
        if not len(own) or s == 1:
            continue
        values = grid[row[own, None], start[own, None] + np.arange(COUNTS[s])]
        if s == 0:
            exceptions, values = values[:, 0], np.arange(len(own), dtype=np.uint64)[:, None]
        shifts = (4 + np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        words[own] |= np.bitwise_or.reduce(values << shifts, axis=1)
    return words, per_block, exceptions


def decode_blocks(words: np.ndarray, per_block: np.ndarray, n_ids: int, exceptions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids (uint64) of whole blocks; exceptions is the file's table."""
    if not n_ids:
        return np.zeros(0, dtype=np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    row = block + int(COUNTS.max())  # a block's last word may hold more values than are left
    out = np.zeros(len(per_block) * row, dtype=np.uint64)
    of = np.repeat(np.arange(len(per_block)), per_block)
    first = np.concatenate([[0], np.cumsum(per_block)[:-1]])
    start = ends - counts - (ends - counts)[first][of] + of * row
    for s in range(16):
        own = np.flatnonzero(selector == s)
        if not len(own) or s == 1:
            continue
        shifts = (4 + np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        values = (words[own, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
        out[start[own, None] + np.arange(COUNTS[s])] = exceptions[values.astype(np.int64)] if s == 0 else values
    return out.reshape(-1, row)[:, :block].ravel()[:n_ids]


class FileWriter:
    """Writes one file; documents may span blocks. The file takes its name only once it is whole."""

    def __init__(self, uri: str, block: int = BLOCK):
        self.system, self.path = pafs.FileSystem.from_uri(uri)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}.part"
        self.stream = self.system.open_output_stream(self.part)
        self.block, self.rest, self.held = block, [], 0
        self.offsets, self.exceptions = [], []
        self.doc_ids, self.lengths = [], []
        self.n_words = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.rest.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block * STRIDE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), dtype="<u4").astype(np.uint64)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, whole, self.block * STRIDE):
            words, per_block, exceptions = encode_blocks(ids[at : min(whole, at + self.block * STRIDE)], self.block)
            if len(exceptions):
                own = (words & np.uint64(15)) == 0
                words[own] += np.uint64(sum(map(len, self.exceptions)) << 4)
                self.exceptions.append(exceptions)
            self.offsets.append(self.n_words + np.concatenate([[0], np.cumsum(per_block)[:-1]]))
            self.n_words += len(words)
            self.stream.write(words.astype("<u8").tobytes())
        self.n_ids += whole
        self.rest = [ids[whole:].astype("<u4").tobytes()]
        self.held = len(ids) - whole

    def close(self) -> dict:
        self._flush(True)
        exceptions = np.concatenate(self.exceptions) if self.exceptions else np.zeros(0, np.uint64)
        offsets = np.concatenate(self.offsets) if self.offsets else np.zeros(0)
        nulls = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        for section in (exceptions.astype("<u8"), offsets.astype("<u8"), np.array([d or 0 for d in self.doc_ids], dtype="<i8"), nulls, np.array(self.lengths, dtype="<u8")):
            self.stream.write(section.tobytes())
        self.stream.write(TRAILER.pack(MAGIC, self.block, self.n_ids, len(self.doc_ids), self.n_words, len(exceptions)))
        self.stream.close()
        self.system.move(self.part, self.path)
        return {"n_docs": len(self.doc_ids), "n_ids": self.n_ids}


def read_documents(content: bytes | memoryview) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids as uint32) of every document of a file, some blocks at a time."""
    magic, block, n_ids, n_docs, n_words, n_exceptions = TRAILER.unpack_from(content, len(content) - TRAILER.size)
    if magic != MAGIC:
        raise ValueError("not a token file")
    n_blocks = -(-n_ids // block)
    at = 0

    def section(kind: str, n: int) -> np.ndarray:
        nonlocal at
        array = np.frombuffer(content, dtype=kind, count=n, offset=at)
        at += array.nbytes
        return array

    words, exceptions, offsets = section("<u8", n_words), section("<u8", n_exceptions), section("<u8", n_blocks).astype(np.int64)
    doc_ids, nulls, lengths = section("<i8", n_docs), section("u1", n_docs), section("<u8", n_docs).astype(np.int64)
    bounds = np.append(offsets, n_words)
    held, held_from, next_block = np.zeros(0, np.uint32), 0, 0
    start = 0
    for doc_id, null, length in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist()):
        while next_block < n_blocks and held_from + len(held) < start + length:
            until = min(n_blocks, next_block + STRIDE)
            some = decode_blocks(words[bounds[next_block] : bounds[until]], np.diff(bounds[next_block : until + 1]), min(n_ids, until * block) - next_block * block, exceptions, block)
            held = np.concatenate([held[start - held_from :], some.astype(np.uint32)])
            held_from, next_block = start, until
        yield (None if null else doc_id), start, held[start - held_from : start - held_from + length]
        start += length


def splits_at_blanks(path: str) -> bool:
    """Whether a tokenizer file's texts may be encoded in chunks: byte-level pairs behind the usual splitting pattern, and nothing before it or matched across it."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and all(token.get("special") for token in spec.get("added_tokens") or [])
    )


def _byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes that begin a character which is surely no white space; those that begin some white space beyond ASCII are left out with all their like.
_BEGINS = _byte_table((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
#: ASCII letters and digits, letters, and marks that no contraction begins with; a word is split from the marks beside it.
_ALNUM, _LETTER, _MARK = _byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)), _byte_table((0x41, 0x5A), (0x61, 0x7A)), _byte_table((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ASCII, _MORE, _TWO, _THREE, _FOUR = _byte_table((0x21, 0x7E)), _byte_table((0x80, 0xBF)), _byte_table((0xC3, 0xDF)), _byte_table((0xE0, 0xE0), (0xE4, 0xEF)), _byte_table((0xF0, 0xF4))


#: Bytes that begin letters of two bytes; but two of those with the first of them, which aren't letters.
_LATIN = _byte_table((0xC3, 0xC8))


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in the UTF-8 bytes of texts that begin at starts: at each text, at each single space between two characters that are surely no white space, before and behind each of one or two line ends between such, and between a letter and a mark other than an apostrophe, or a digit and a mark behind it."""
    n = len(data)
    edge = np.zeros(n + 3, dtype=bool)
    edge[starts] = edge[n:] = True
    kind = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(2, np.uint8)])
    one, two, three, four = kind[3 : n + 3], kind[2 : n + 2], kind[1 : n + 1], kind[:n]  # the bytes before each place
    ended = _ASCII[one] | (_MORE[one] & (_TWO[two] | (_MORE[two] & (_THREE[three] | (_MORE[three] & _FOUR[four])))))
    inside = ended & ~edge[:n] & ~edge[1 : n + 1]
    following, second = kind[5 : n + 5], kind[6 : n + 6]
    breaks = inside & (data == 0x0A)
    single = breaks & _BEGINS[following]
    double = breaks & (following == 0x0A) & ~edge[2 : n + 2] & _BEGINS[second]
    cut = edge[:n] | inside & (data == 0x20) & _BEGINS[following] | single | double
    cut[1:] |= single[:-1] | double[:-1]
    cut[2:] |= double[:-2]
    mark = _MARK[data]
    cut |= mark & (_ALNUM[one] | _MORE[one] & _LATIN[two] & (one != 0x97) & (one != 0xB7)) | _LETTER[data] & _MARK[one]
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, each distinct chunk encoded once while it is remembered.

    Chunks are cut as chunk_starts() says. The usual splitting pattern never carries
    a match over such a place, so chunks encode to the same ids as the whole text,
    and a word shares its ids with the same word beside marks. Whole texts are encoded with any
    tokenizer that splits otherwise, and where a text holds the string of one of the
    tokenizer's added tokens, which the library takes for that token wherever it
    stands; plain_specials encodes the strings of special ones as ordinary text instead.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.chunked = splits_at_blanks(path) and not any("\n" in a for a in self.added)
        if self.chunked:
            (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # what is remembered: chunks, where their ids begin among all ids, and these
        self.keys, self.bounds, self.ids = pa.array([], pa.string()), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def ids_of(self, strings: list[str]) -> list[bytes]:
        """Ids of each string. Those that no blank begins (but for one space) or ends and that have no line end are encoded as the lines of one text, in which an end of line is a token of its own."""

        def alone(s: str) -> bool:
            body = s[1:] if s[:1] == " " else s
            return "\n" not in s and body[:1].strip() != "" and not body[-1].isspace()

        fits = [s.isprintable() and s > " " and " " not in s[1:] or alone(s) for s in strings]  # the first part is the common case
        lines = [i for i, fit in enumerate(fits) if fit]
        out: list[bytes] = [b""] * len(strings)
        if lines:
            ids = np.array(self._batch(["\n".join([strings[i] for i in lines])])[0], dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids)).tolist()
            data, at = ids.tobytes(), 0
            for i, end in zip(lines, ends, strict=True):
                out[i] = data[4 * at : 4 * end]
                at = end + 1
        rest = [i for i, fit in enumerate(fits) if not fit]
        for i, ids in zip(rest, self._batch([strings[i] for i in rest])):
            out[i] = array("I", ids).tobytes()  # little-endian, as on any machine that Spark runs on
        return out

    def _batch(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _remember(self, chunks: list[str], ids: list[bytes]) -> None:
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        self.keys = pa.concat_arrays([self.keys, pa.array(chunks, pa.string())])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(lengths))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), dtype="<u4"))

    def _forget(self) -> None:
        """Keep the newer half."""
        at = len(self.keys) // 2
        self.keys = pa.concat_arrays([self.keys[at:]])
        self.ids, self.bounds = self.ids[self.bounds[at] :].copy(), self.bounds[at:] - self.bounds[at]

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where distinct chunks are among those remembered; the ones that aren't are encoded and remembered first."""
        found = pc.index_in(chunks, value_set=self.keys)
        unknown = pc.is_null(found)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        strings = chunks.filter(unknown).to_pylist()
        if not strings:
            return out
        place = np.arange(len(self.keys), len(self.keys) + len(strings))
        self._remember(strings, self.ids_of(strings))
        out[unknown.to_numpy(zero_copy_only=False)] = place
        return out

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null: none. Chunks are told apart, looked up and put together as arrays; only those that aren't known become strings."""
        if not self.chunked:
            return [array("I", ids).tobytes() for ids in self._batch([t or "" for t in texts.to_pylist()])]
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.added:
            whole = reduce(pc.or_, [pc.match_substring(texts, a) for a in self.added])
            if pc.any(whole).as_py():
                out, self.added, added = [], [], self.added
                try:
                    out = self.encode_column(pc.if_else(whole, "", texts))
                finally:
                    self.added = added
                at = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
                for i, ids in zip(at, self._batch(texts.filter(whole).to_pylist())):
                    out[i] = array("I", ids).tobytes()
                return out
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds.astype(np.int64) - bounds[0]
        if not len(data):
            return [b""] * len(texts)
        starts = chunk_starts(data, bounds[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        places = self.places(chunks.dictionary)
        begins, lengths, which = self.bounds[places], np.diff(self.bounds)[places], chunks.indices.to_numpy()
        sizes = lengths[which]
        ends = np.cumsum(sizes)
        at = np.repeat(begins[which] - (ends - sizes), sizes)
        at += np.arange(len(at))
        flat = self.ids[at].tobytes()
        cuts = 4 * np.append(0, ends)[np.searchsorted(starts, bounds)]
        if len(self.keys) > MEMO:
            self._forget()
        return [flat[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


def _encoder(path: str, plain_specials: bool = False) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, plain_specials) not in _loaded:
        _loaded[path, plain_specials] = ChunkEncoder(path, plain_specials)
    return _loaded[path, plain_specials]


MANIFEST = "manifest.parquet"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, max_ids: int = 16_000_000, block: int = BLOCK, plain_specials: bool = False) -> None:
    """Write the ids of docs(doc_id, text) in ascending doc_id order, and beside the files their manifest (part, file, n_docs, n_ids) as a table.

    Null text: empty, so only end_id. Null doc_ids come first; repeated ids are in
    order of their text's hash, equal rows each count. A very long text is encoded
    whole, and its ids may span blocks. An empty table writes no file. Other columns
    are ignored, whatever their names. A special token's string in a text becomes that
    token, as in the library, or ordinary text with plain_specials. A file is renamed into place once whole, and
    a task that runs again writes the same bytes, so a lost executor leaves no
    half-written file. Nothing passes the driver.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer, plain_specials), struct.pack("<I", end_id)
        partition, writer, found = TaskContext.get().partitionId(), None, []

        def finish() -> None:
            made = writer.close()
            found.append((partition, name, made["n_docs"], made["n_ids"]))

        for batch in batches:
            for part in column_slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_column(part.column("text"))):
                    if writer is None:
                        name = f"part-{partition:06d}-{len(found):06d}.s8b"
                        writer = FileWriter(f"{folder}/{name}", block)
                    writer.add(doc_id, ids + end)
                    if writer.n_ids >= max_ids:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        columns = list(zip(*found)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    arrow_map(ordered, write, "part int, file string, n_docs long, n_ids long").write.parquet(f"{folder}/{MANIFEST}")


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, base): the ids of all files before each. Files are summed up by writing task first, so that what is summed in one order is a row for each task."""
    files = spark.read.schema("part int, file string, n_docs long, n_ids long").parquet(f"{folder}/{MANIFEST}")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inside", inside).join(parts, "part").select("file", (F.col("before") + F.col("inside")).alias("base"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a folder's files, start counted over all files in order. A folder without files gives an empty table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name, rows = path.rpartition("/")[2], []
                for doc_id, start, ids in read_documents(memoryview(content.as_buffer())):
                    rows.append((name, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")
    rows = arrow_map(content, read, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(file_starts(spark, folder), "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through the id files and back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = shared_path(spark, "op5-token-ids")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
