"""Operator 7: passages that repeat across documents, by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, checkpointed, drop_unused, text_slices
from tidemark.llm.leaks import shingle_codes, word_hashes, words_of
from tidemark.session import delete_path, shared_path, table

#: Words of the shortest passage that is always found whole.
MIN_WORDS = 50
#: Words of a run that is hashed, and runs of a window of which the least is a minimiser.
RUN, RUNS = 10, 30
#: Words that a passage of MIN_WORDS has from its first minimiser on, at least.
LEAST = MIN_WORDS - RUNS + 1
#: Words of a suffix that are sorted. Minimisers are at most RUNS words apart, so longer matches go on in the next suffix.
DEPTH = LEAST + RUNS + 1
#: Odd factors of the two halves of a window's code.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
#: Stands for a null doc_id: all such rows are one document.
NO_ID = -(1 << 63)
#: A run that is one in so many of the repeated ones, or commoner, is dealt to SALTS tasks; so there are at most HOT_SHARE of them.
HOT_SHARE, SALTS = 1000, 64


def minimisers(codes: np.ndarray) -> np.ndarray:
    """Positions of the least run code of each window of RUNS runs, the leftmost of equals."""
    if len(codes) < RUNS:
        return np.zeros(0, dtype=np.int64)
    found = []
    for at in range(0, len(codes) - RUNS + 1, 50_000):
        part = np.lib.stride_tricks.sliding_window_view(codes[at : at + 50_000 + RUNS - 1], RUNS)
        found.append(np.unique(part.argmin(axis=1) + np.arange(at, at + len(part))))
    return np.unique(np.concatenate(found))


def suffixes(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place the words from it on as big-endian 32-bit codes; zero beyond the text."""
    codes = (hashes >> np.uint64(32)).astype(np.uint32)
    codes[codes == 0] = 1
    padded = np.concatenate([codes, np.zeros(DEPTH, np.uint32)])
    return padded[places[:, None] + np.arange(DEPTH)].astype(">u4")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))


def _written(frame: DataFrame, name: str, done: str | None = None) -> tuple[DataFrame, str]:
    """frame, written to the shared folder and read back, and its path there. What was read for it goes from the disk: the path done, and shuffles, which would stay until the driver happens to collect its garbage."""
    spark, folder = frame.sparkSession, shared_path(frame.sparkSession, name)
    frame.write.parquet(folder)
    if done:
        delete_path(spark, done)
    drop_unused(spark, 0)
    return spark.read.schema(frame.schema).parquet(folder), folder


def anchors(rows: DataFrame) -> DataFrame:
    """(doc, key, place, code) of the minimisers of each text of at least MIN_WORDS words."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                owners, places, values = [], [], []
                for i, text in enumerate(texts):
                    words = words_of(text)
                    if len(words) < MIN_WORDS:
                        continue
                    codes = shingle_codes(word_hashes(words), RUN)
                    own = minimisers(codes)
                    owners.append(np.full(len(own), i))
                    places.append(own)
                    values.append(codes[own])
                if owners:
                    owner = pa.array(np.concatenate(owners))
                    yield pa.RecordBatch.from_arrays([part.column("doc").take(owner), part.column("key").take(owner), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(values).view(np.int64))], names=["doc", "key", "place", "code"])

    return arrow_map(rows, select, "doc long, key long, place int, code long")


def _salted(frame: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """The rows of frame whose column is in counts(column, n), n the rows that have it. Values that one in HOT_SHARE of all counted rows have, or more, are dealt to SALTS tasks."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col(column).isin([bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in counts.where(F.col("n") * HOT_SHARE >= total).select(column).collect()])
    salted = frame.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc", "place"), F.lit(SALTS)).cast("int")).otherwise(0))
    wanted = counts.select(column, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(wanted, [column, "salt"], "left_semi").drop("salt")


def repeated_places(found: DataFrame) -> DataFrame:
    """(doc, key, place) of the minimisers in found whose run is found in two documents at least."""
    shared = checkpointed(found.groupBy("code").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("code", "n"))
    drop_unused(found.sparkSession, 0)
    return _salted(found, shared, "code").select("doc", "key", "place")


def repeated_suffixes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(suffix, doc, key, place, room) of the places(doc, key, place) in texts; room is the words of the text from there on."""
    listed = places.groupBy("doc", "key").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                for i, (text, own) in enumerate(zip(texts, part.column("places"))):
                    hashes, own = word_hashes(words_of(text)), own.values.to_numpy().astype(np.int64)
                    n = len(own)
                    same = [pa.array(np.full(n, part.column(c)[i].as_py()), pa.int64()) for c in ("doc", "key")]
                    yield pa.RecordBatch.from_arrays([_binary(suffixes(hashes, own)), *same, pa.array(own, pa.int32()), pa.array(len(hashes) - own, pa.int32())], names=["suffix", "doc", "key", "place", "room"])

    return arrow_map(rows.join(listed, ["doc", "key"]), cut, "suffix binary, doc long, key long, place int, room int")


def window_codes(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(n, 2): 128 bits of the MIN_WORDS words from each place on."""
    out = np.zeros((len(places), 2), dtype=np.uint64)
    for i in range(MIN_WORDS):
        out = out * FACTORS + hashes[places + i, None]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _pieces_of(column: pa.Array, *names: str) -> Iterator[list[np.ndarray]]:
    """For each row of a column of lists of structs the arrays of their fields."""
    flat = column.flatten()
    fields = [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield [f[start:end] for f in fields]


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading codes that the rows of a and b share."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


_COLUMNS = ("doc", "key", "place", "room")


FIRST, LAST, IN_FIRST, IN_LAST, AFTER_FIRST, BEFORE_LAST = range(6)


def matched_pieces(sorted_rows: DataFrame) -> DataFrame:
    """Pieces (doc, key, start, end, run) of texts that a neighbour in suffix order from another document shares, run a hash of their first RUN words; and what may have one in another task (suffix not null, start says which): a task's first and last row, the rows of its first and of its last run of a document, and the rows beyond those runs."""
    schema = "part int, suffix binary, doc long, key long, place int, room int, start int, end int"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, codes, done, begun = TaskContext.get().partitionId(), None, None, 0, False
        for batch in batches:
            fresh = {c: batch.column(c).to_numpy() for c in _COLUMNS}
            data = np.frombuffer(b"".join(batch.column("suffix").to_pylist()), dtype=">u4").reshape(-1, DEPTH)
            held = fresh if held is None else {c: np.concatenate([held[c], fresh[c]]) for c in _COLUMNS}
            codes = data if codes is None else np.concatenate([codes, data])
            last = run_starts(held)[-1] if len(codes) else 0
            if len(codes) < 20_000 or last <= done:
                continue
            if not begun:
                yield from first_run(part, held, codes)
                begun = True
            yield matches(part, held, codes, done, last)
            keep = max(0, last - 1)  # the row before the last run, for comparing with it
            held, codes, done = {c: v[keep:] for c, v in held.items()}, codes[keep:], last - keep
        if codes is not None and len(codes):
            if not begun:
                yield from first_run(part, held, codes)
            yield matches(part, held, codes, done, len(codes))
            last = int(run_starts(held)[-1])
            yield rows(part, held, codes, range(len(codes) - 1, len(codes)), LAST)
            yield rows(part, held, codes, range(last, len(codes)), IN_LAST)
            yield rows(part, held, codes, range(max(0, last - 1), last), BEFORE_LAST)

    def first_run(part: int, held: dict, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        end = int(np.append(run_starts(held), len(codes))[1])
        yield rows(part, held, codes, range(1), FIRST)
        yield rows(part, held, codes, range(end), IN_FIRST)
        yield rows(part, held, codes, range(end, min(end + 1, len(codes))), AFTER_FIRST)

    def run_starts(held: dict) -> np.ndarray:
        """Where the document changes."""
        return np.concatenate([[0], np.flatnonzero(held["doc"][1:] != held["doc"][:-1]) + 1])

    def matches(part: int, held: dict, codes: np.ndarray, a: int, b: int) -> pa.RecordBatch:
        starts = run_starts(held)
        run = np.searchsorted(starts, np.arange(a, b), "right") - 1
        own = np.arange(a, b)
        best = np.zeros(b - a, dtype=np.int64)
        for other, there in ((starts[run] - 1, run > 0), (np.append(starts, len(codes))[run + 1], run + 1 < len(starts))):
            i = np.flatnonzero(there)
            for at in range(0, len(i), 5000):
                j = i[at : at + 5000]
                best[j] = np.maximum(best[j], common_words(codes[own[j]], codes[other[j]]))
        best = np.minimum(best, held["room"][a:b])
        hit = np.flatnonzero(best >= LEAST)
        n, start = len(hit), held["place"][own[hit]]
        columns = [np.full(n, part), _binary(codes[own[hit], :RUN]), held["doc"][own[hit]], held["key"][own[hit]], [None] * n, [None] * n, start, start + best[hit]]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, kinds)], names=names)

    def rows(part: int, held: dict, codes: np.ndarray, own: range, which: int) -> pa.RecordBatch:
        n, i = len(own), slice(own.start, own.stop)
        values = [np.full(n, part), [x.tobytes() for x in codes[i]], *[held[c][i] for c in _COLUMNS], np.full(n, which), [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

    names = ["part", "suffix", "doc", "key", "place", "room", "start", "end"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return arrow_map(sorted_rows, compare, schema)


def _neighbours(edges: list) -> dict[tuple[int, int], bytes]:
    """The suffix of the nearest row of another document in another task, by part and run (IN_FIRST or IN_LAST), where there is one."""
    ends = {(e.part, e.start): e for e in edges}
    parts, found = sorted({e.part for e in edges}), {}
    for run, edge, near, beyond, order in ((IN_FIRST, FIRST, LAST, BEFORE_LAST, parts), (IN_LAST, LAST, FIRST, AFTER_FIRST, parts[::-1])):
        nearest: list = []  # of the tasks so far: the last row, and the last one of another document
        for part in order:
            own, other = ends[part, edge], None
            for e in nearest:
                if e.doc != own.doc:
                    other = e
                    break
            if other is not None:
                found[part, run] = bytes(other.suffix)
            mine = [e for e in (ends[part, near], ends.get((part, beyond))) if e]
            if len(mine) == 1:  # one run: what lies beyond it is in the tasks before
                mine += [e for e in nearest if e.doc != mine[0].doc][:1]
            nearest = mine
    return found


def all_pieces(sorted_rows: DataFrame) -> DataFrame:
    """Pieces (doc, key, start, end, run) of texts that the nearest rows of other documents share, in the same task or beyond its edges."""
    matched = checkpointed(matched_pieces(sorted_rows))
    edges = matched.where("end is null")
    near = _neighbours(edges.where(~F.col("start").isin(IN_FIRST, IN_LAST)).collect())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                other = near.get((e["part"], e["start"]))
                if other is None:
                    continue
                length = min(e["room"], int(common_words(*[np.frombuffer(x, dtype=">u4")[None] for x in (e["suffix"], other)])[0]))
                if length >= LEAST:
                    out.append((e["suffix"][: 4 * RUN], e["doc"], e["key"], e["place"], e["place"] + length))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["suffix", "doc", "key", "start", "end"])

    beyond = arrow_map(edges.where(F.col("start").isin(IN_FIRST, IN_LAST)), compare, "suffix binary, doc long, key long, start int, end int")
    found = matched.where("end is not null").select("suffix", "doc", "key", "start", "end").unionByName(beyond)
    return found.select("doc", "key", "start", "end", F.xxhash64("suffix").alias("run"))


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that touch or overlap, given in order of their starts, as one each."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


def open_windows(starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each piece the starts of the windows of MIN_WORDS that hold its first word among their first RUNS, end with it at the latest, and have a word that no piece of MIN_WORDS covers."""
    whole = ends - starts >= MIN_WORDS
    a, b = _covered(starts[whole], ends[whole])
    out = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        own = np.arange(max(start - RUNS + 1, 0), min(start, end - MIN_WORDS) + 1)
        if len(a) and len(own):
            at = np.searchsorted(a, own, "right") - 1
            own = own[(at < 0) | (b[at] < own + MIN_WORDS)]
        out.append(own)
    return out


def extended(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc, key, start, end): runs of at least MIN_WORDS words that another document has too, which together cover all such runs.

    Pieces of MIN_WORDS are such runs. What a passage has left of its first minimiser,
    and right of what one neighbour shares, is found by extending pieces word by word
    to windows of MIN_WORDS, against all documents at once: a window counts if another
    document has the same words. Only windows at minimisers where some document needs
    one are made, and they are told apart by 128 bits of all their words.
    """
    listed = pieces.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "run"))).alias("pieces"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for starts, ends, runs in _pieces_of(batch.column("pieces"), "start", "end", "run"):
                found += [r for r, w in zip(runs.tolist(), open_windows(starts, ends)) if len(w)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["run"])

    runs = arrow_map(listed.select("pieces"), needed, "run long").distinct()
    counted = checkpointed(pieces.groupBy("run").agg(F.count(F.lit(1)).alias("n")).join(runs, "run"))
    wanted = _salted(pieces.withColumn("place", F.col("start")), counted, "run").groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                for i, (text, (starts, ends)) in enumerate(zip(texts, _pieces_of(part.column("pieces"), "start", "end"))):
                    first, last = np.maximum(starts - RUNS + 1, 0), np.minimum(starts, ends - MIN_WORDS)
                    counts = np.maximum(last - first + 1, 0)
                    places = np.unique(np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()))
                    if not len(places):
                        continue
                    codes = window_codes(word_hashes(words_of(text)), places)
                    same = [pa.array(np.full(len(places), part.column(c)[i].as_py()), pa.int64()) for c in ("doc", "key")]
                    yield pa.RecordBatch.from_arrays([_binary(codes), *same, pa.array(places, pa.int32())], names=["window", "doc", "key", "place"])

    windows, folder = _written(arrow_map(rows.join(wanted, ["doc", "key"]), cut, "window binary, doc long, key long, place int"), "windows")  # read twice
    shared = checkpointed(windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("window", "n"))
    drop_unused(rows.sparkSession, 0)
    found = checkpointed(_salted(windows, shared, "window").select("doc", "key", F.col("place").alias("start"), (F.col("place") + MIN_WORDS).alias("end")))
    delete_path(rows.sparkSession, folder)
    drop_unused(rows.sparkSession, 0)
    return pieces.where(F.col("end") - F.col("start") >= MIN_WORDS).select("doc", "key", "start", "end").unionByName(found)


def repeated_regions(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): regions of at least MIN_WORDS words, counted from 0, end exclusive, that repeat across documents: together the words of all runs of MIN_WORDS words that another document has too.

    Suffixes are kept at minimisers: of every RUNS neighbouring runs of RUN words,
    the one with the least hash. They are sorted, and each is compared with its
    neighbours from other documents; a passage of MIN_WORDS that two documents share
    has a minimiser from which it goes on for LEAST words at least, so both have a
    piece there. Pieces are then extended (see extended()): what is found is what a
    comparison with all other documents finds, not with the neighbours alone, as those
    with the longest passage to the right of a minimiser needn't have that to its left.

    Words are compared with A-Z lower-cased, by hash: 32 bits of each in suffixes, 128
    of all words in windows. Matches go on to the right by the suffix of the next
    minimiser, at most RUNS words on. Null or empty texts, and those of
    fewer than MIN_WORDS words, have no region; very long texts are read whole.
    Runs that touch or overlap are one region; neighbours of equal length are equals, and
    which is compared changes nothing. Repeated rows of one doc_id, and
    all rows without one, are one document. An empty table gives an empty table;
    other columns are ignored. A passage's copies are rows that sort next to each
    other, however many there are, and sorted order is dealt out evenly; the driver
    gets at most four rows for each task.
    """
    rows = _rows(docs)
    found, folder = _written(anchors(rows), "anchors")  # read twice: for the runs that repeat, and for where they are
    places, folder = _written(repeated_places(found), "places", folder)
    suffixed, folder = _written(repeated_suffixes(rows, places), "suffixes", folder)  # read twice: for the range of each task, and to be sorted
    pieces = all_pieces(suffixed.repartitionByRange("suffix", "doc", "place").sortWithinPartitions("suffix", "doc", "place"))
    delete_path(docs.sparkSession, folder)
    drop_unused(docs.sparkSession, 0)
    pieces = extended(rows, pieces)
    ordered = Window.partitionBy("doc", "key").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("apart", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    regions = islands.groupBy("doc", "key", "island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end")).where(F.col("end") - F.col("start") >= MIN_WORDS)
    return regions.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "start", "end").distinct()


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of documents that repeat across documents: doc_id, start, end in words."""
    return repeated_regions(table(spark, sf_dir, "documents").select("doc_id", "text"))
