"""Operator 2: SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model file: the normaliser's rules (its character map's, and blanks
as U+2581 with one in front), the pieces as a trie whose final states carry a
piece's weight, its negated score, and byte fallback as an arc from the first state
for each character that no piece has, weighted as the sum of its bytes' pieces. A
normalised input is composed with it from left to right, and the path of least
weight in the tropical semiring (min, +) is its encoding.

For a byte-pair model the transducer's states also remember the last piece: two
pieces may only follow each other if merging their own characters gives just the
two back; other transitions weigh infinity. That holds for every neighbouring pair
of the model's encoding of a text, and for one path only, so each position keeps one
state of finite weight and the least path is what the merges would make.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, text_slices
from tidemark.session import table

BLANK = "▁"
INFINITY = float("inf")
#: Words and neighbouring pairs that a task remembers, each in two generations; longer words aren't remembered.
MEMO = 100_000
MEMO_CHARS = 48
#: Words whose paths are found side by side, and the bits of a pair's place among the pairs that they remember.
BATCH_WORDS, PAIR_BITS = 8000, 19
#: Bytes of texts whose words are held at once.
SLICE = 2_000_000
#: Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BYTE_PAIR = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What a piece for unknown characters decodes to.
UNKNOWN_TEXT = " ⁇ "


class Memo(dict):
    """A map of bounded size: when full, the older half is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a model's compiled character map: a double array of the sources' bytes, whose leaves give where each target starts among the texts behind it."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, targets = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)

    def child(at: int) -> int:
        unit = int(units[at])
        return at ^ (unit >> 10) << ((unit & 1 << 9) >> 6)

    rules, open_ = {}, [(child(0), b"")]
    while open_:
        base, source = open_.pop()
        near = base ^ labels
        near = np.where(near < len(units), near, 0)
        for label in labels[(units[near] & 0x800000FF) == labels].tolist():
            at, text = base ^ label, source + bytes([label])
            below = child(at)
            if units[at] >> 8 & 1:
                start = int(units[below] & 0x7FFFFFFF)
                rules[text.decode()] = targets[start : targets.index(b"\0", start)].decode()
            open_.append((below, text))
    return rules


class Normaliser:
    """Rewrites a text from left to right by the longest rule at each place, then treats its blanks as the model does."""

    def __init__(self, rules: dict[str, str] | None = None, prefix: bool = True, collapse: bool = False):
        self.rules, self.prefix, self.collapse = rules or {}, prefix, collapse
        self.longest: dict[str, int] = {}
        for source in self.rules:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))

    def rewritten(self, text: str) -> str:
        longest, rules = self.longest, self.rules
        if not longest or longest.keys().isdisjoint(text):
            return text
        out, at = [], 0
        while at < len(text):
            for size in range(longest.get(text[at], 0), 0, -1):
                if (target := rules.get(text[at : at + size])) is not None:
                    out.append(target)
                    at += size
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK)


class Transducer:
    """Pieces (text, score, kind) and a normaliser, ready to compose with inputs.

    A symbol is a piece's number, or for a character without a piece the number of
    pieces and its code point.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BYTE_PAIR, normalise: Normaliser | None = None):
        if kind not in (UNIGRAM, BYTE_PAIR):
            raise ValueError(f"model kind {kind} is not supported")
        self.kind, self.normalise = kind, normalise or Normaliser()
        self.texts = [p for p, _, _ in pieces]
        self.weights = [-w for _, w, _ in pieces]
        self.score_of = {p: -w for p, w, k in pieces if k in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.penalty = 10.0 + max(self.score_of.values(), default=0.0)
        self.spelled = [(i, p) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)]
        self.arcs: list[dict[str, int]] = []  # compiled when first needed: decoding goes without
        # an input is cut where no piece can lie across: before a run of blanks, and around line ends; the parts' paths join to the whole one
        split = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.score_of)
        self.cut = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" if split else "(?s).+")
        self.output = [self._decoded(p, k) for p, _, k in pieces]
        self.pairs = Memo(MEMO)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        """The transducer of a model file, its normaliser's character map included."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model's treatment of white space is not supported")
        if rules.precompiled_charsmap and any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("a character map beside user-defined pieces, which it must leave alone, is not supported")
        normalise = Normaliser(character_map(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces)
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, normalise)

    @staticmethod
    def _decoded(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind in (CONTROL, UNKNOWN):
            return UNKNOWN_TEXT.encode() if kind == UNKNOWN else b""
        return piece.replace(BLANK, " ").encode()

    def text(self, symbol: int) -> str:
        """The characters of a symbol."""
        return self.texts[symbol] if symbol < len(self.texts) else chr(symbol - len(self.texts))

    def fallback(self, char: str) -> tuple[float, list[int]]:
        """Weight and ids of the arc of a character without a piece: its bytes', or the unknown piece's."""
        ids = [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]
        return (self.penalty if self.kind == UNIGRAM or not self.bytes else sum(self.weights[i] for i in ids)), ids

    def merged(self, symbols: list[str]) -> list[str]:
        """What merging neighbours makes of symbols: the best scored pair first, the leftmost of equals."""
        while (at := self._next_merge(symbols)) >= 0:
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _next_merge(self, symbols: list[str]) -> int:
        score_of, best, found = self.score_of, INFINITY, -1
        for i in range(len(symbols) - 1):
            weight = score_of.get(symbols[i] + symbols[i + 1])
            if weight is not None and weight < best:
                best, found = weight, i
        return found

    def _edges(self, symbol: int) -> tuple[list, list] | None:
        """The parts (text, from, until) that stand at a symbol's left and right edge while its characters merge, by the largest weight merged so far; None if they don't merge to it."""
        if symbol not in self.edges:
            parts, now = list(self.text(symbol)), 0.0
            left, right = [[parts[0], now, INFINITY]], [[parts[-1], now, INFINITY]]
            since = [now] * len(parts)
            while (at := self._next_merge(parts)) >= 0:
                made = parts[at] + parts[at + 1]
                now = max(self.score_of[made], since[at], since[at + 1])
                for edge, here in ((left, at == 0), (right, at == len(parts) - 2)):
                    if here:
                        edge[-1][2] = now
                        edge.append([made, now, INFINITY])
                parts[at : at + 2], since[at : at + 2] = [made], [now]
            self.edges[symbol] = (left, right) if len(parts) == 1 else None
        return self.edges[symbol]

    def follow(self, left: int, right: int) -> bool:
        """Whether symbol right has a finite weight after symbol left, or at the start (left -1): no merge crosses their border while the parts beside it stand."""
        key = left << 22 | right
        known = self.pairs.get(key)
        if known is None and (known := self.pairs.old.get(key)) is None:
            known = self._apart(left, right)
            self.pairs.keep(key, known)
        return known

    def _apart(self, left: int, right: int) -> bool:
        own = self._edges(right)
        if left < 0 or own is None:
            return own is not None
        for a, a_from, a_until in self._edges(left)[1]:
            for b, b_from, b_until in own[0]:
                weight = self.score_of.get(a + b)
                if weight is not None:
                    at, until = max(weight, a_from, b_from), min(a_until, b_until)
                    if at < until:
                        return False
                    if at == until:  # which of equals comes first depends on more than the parts at the edges
                        both = [self.text(left), self.text(right)]
                        return self.merged(list("".join(both))) == both
        return True

    def shortest_path(self, word: str) -> list[int]:
        """Symbols along the path of least weight of a part of an input, found by min and + over its positions from left to right."""
        if not self.arcs:
            self._compile()
        n = len(word)
        weight, came, last = [0.0] + [INFINITY] * n, [0] * (n + 1), [-1] * (n + 1)
        arcs, ends, weights, pairs = self.arcs, self.ends, self.weights, self.pairs
        paired = self.kind == BYTE_PAIR
        for at in range(n):
            here, before = weight[at], last[at]
            state, end, alone = 0, at, True
            while end < n:
                state = arcs[state].get(word[end])
                if state is None:
                    break
                end += 1
                symbol = ends[state]
                if symbol >= 0:
                    if end == at + 1:
                        alone = False
                    if paired:
                        if last[end] >= 0:  # its one finite state is known; the longest arcs come first
                            continue
                        known = pairs.get(before << 22 | symbol)
                        if known is None:
                            known = self.follow(before, symbol)
                        if not known:
                            continue
                    total = here + weights[symbol]
                    if total < weight[end]:
                        weight[end], came[end], last[end] = total, at, symbol
            if alone:
                total = here + self.fallback(word[at])[0]
                if total < weight[at + 1]:
                    weight[at + 1], came[at + 1], last[at + 1] = total, at, len(self.texts) + ord(word[at])
        path = []
        while n:
            path.append(last[n])
            n = came[n]
        return path[::-1]

    def _compile(self) -> None:
        """The trie of the pieces: arcs of each state by character and the piece that ends in it, or -1; and the arcs again as sorted keys of state and character class with their targets, for taking a step in many words at once."""
        self.arcs, self.ends = [{}], [-1]
        for i, p in self.spelled:
            state = 0
            for c in p:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(-1)
                state = self.arcs[state][c]
            self.ends[state] = i
        chars = sorted({c for arcs in self.arcs for c in arcs})
        points = [ord(c) for c in chars]
        self.class_table = np.zeros(max(points, default=0) + 2, dtype=np.int32)  # the last for all beyond
        self.class_table[points] = np.arange(1, len(chars) + 1)
        found = sorted((state << 20 | int(self.class_table[ord(c)]), target) for state, arcs in enumerate(self.arcs) for c, target in arcs.items())
        self.arc_keys, self.arc_targets = (np.array(x, dtype=np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        self.end_array, self.weight_array = np.array(self.ends, dtype=np.int64), np.array([*self.weights, self.penalty])
        self.pair_keys, self.pair_values = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)

    def _step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The state after each state's character; -1 if there is no arc."""
        keys = states << 20 | classes
        at = np.minimum(np.searchsorted(self.arc_keys, keys), len(self.arc_keys) - 1)
        return np.where(self.arc_keys[at] == keys, self.arc_targets[at], -1)

    def _follow_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """follow() of many pairs; each remembered in the one place that its key hashes to."""
        keys = left + 1 << 22 | right
        place = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, known = self.pair_values[place], self.pair_keys[place] == keys
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            values = np.array([self._apart((k >> 22) - 1, k & 0x3FFFFF) for k in new.tolist()], dtype=bool)[back]
            out[~known] = values
            self.pair_keys[place[~known]], self.pair_values[place[~known]] = keys[~known], values
        return out

    def shortest_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """shortest_path() of words of up to MEMO_CHARS characters, side by side: the symbols of all, and where each word's begin."""
        if not self.arcs:
            self._compile()
        lengths = np.array([len(w) for w in words])
        n, longest = len(words), int(lengths.max())
        points = np.zeros((n, longest), dtype=np.int64)
        points[np.arange(longest) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        classes = self.class_table[np.minimum(points, len(self.class_table) - 1)].astype(np.int64)
        weight = np.full((n, longest + 1), INFINITY)
        weight[:, 0] = 0.0
        came, last = np.zeros((n, longest + 1), dtype=np.int64), np.full((n, longest + 1), -1, dtype=np.int64)
        for at in range(longest):
            rows = np.flatnonzero(lengths > at)
            states, alone = np.zeros(len(rows), dtype=np.int64), rows
            for end in range(at + 1, longest + 1):
                inside = lengths[rows] >= end
                rows, states = rows[inside], states[inside]
                states = self._step(states, classes[rows, end - 1])
                rows, states = rows[states >= 0], states[states >= 0]
                if not len(rows):
                    break
                symbols = self.end_array[states]
                own = symbols >= 0
                if end == at + 1:
                    alone = np.setdiff1d(alone, rows[own], assume_unique=True)
                self._settle(weight, came, last, rows[own], at, end, symbols[own])
            if len(alone):  # characters without a piece; those of a byte-pair model are settled alike, whatever their bytes weigh
                symbols = len(self.texts) + points[alone, at]
                totals = weight[alone, at] + np.array([self.fallback(chr(c))[0] for c in points[alone, at].tolist()])
                better = totals < weight[alone, at + 1]
                alone = alone[better]
                weight[alone, at + 1], came[alone, at + 1], last[alone, at + 1] = totals[better], at, symbols[better]
        place, found, owners = lengths.copy(), [], []
        live = np.arange(n)
        while len(live):
            found.append(last[live, place[live]])
            owners.append(live)
            place[live] = came[live, place[live]]
            live = live[place[live] > 0]
        owner, symbol = np.concatenate(owners)[::-1], np.concatenate(found)[::-1]
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.searchsorted(owner[order], np.arange(n + 1))

    def _settle(self, weight: np.ndarray, came: np.ndarray, last: np.ndarray, rows: np.ndarray, at: int, end: int, symbols: np.ndarray) -> None:
        """Take an arc from at to end in each row where its weight is finite and the sum is less than what is known."""
        if self.kind == BYTE_PAIR:
            fresh = last[rows, end] < 0  # where its one finite state isn't known yet; the longest arcs come first
            rows, symbols = rows[fresh], symbols[fresh]
            if not len(rows):
                return
            fits = self._follow_all(last[rows, at], symbols)
            rows, symbols = rows[fits], symbols[fits]
        totals = weight[rows, at] + self.weight_array[symbols]
        better = totals < weight[rows, end]
        rows = rows[better]
        weight[rows, end], came[rows, end], last[rows, end] = totals[better], at, symbols[better]

    def ids_of(self, symbols: list[int]) -> bytes:
        """Ids of a path's symbols as little-endian 32-bit integers."""
        ids: list[int] = []
        for symbol in symbols:
            if symbol < len(self.texts):
                ids.append(symbol)
            else:
                ids += self.fallback(self.text(symbol))[1]
        return array("i", ids).tobytes()  # little-endian, as on any machine that Spark runs on

    def learn(self, words: set[str]) -> None:
        """Make words known, those of like length side by side."""
        young, old = self.young, self.old
        fresh = []
        for word in words:
            if word not in young:
                ids = old.get(word)
                if ids is not None:
                    young[word] = ids
                elif len(word) <= MEMO_CHARS:
                    fresh.append(word)
        fresh.sort(key=len)
        for at in range(0, len(fresh), BATCH_WORDS):
            batch = fresh[at : at + BATCH_WORDS]
            symbols, bounds = self.shortest_paths(batch)
            plain, data = symbols < len(self.texts), symbols.astype("<i4").tobytes()
            odd = np.add.reduceat(~plain, bounds[:-1]) > 0
            for word, a, b, is_odd in zip(batch, bounds[:-1].tolist(), bounds[1:].tolist(), odd.tolist()):
                young[word] = self.ids_of(symbols[a:b].tolist()) if is_odd else data[4 * a : 4 * b]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        split = [self.cut.findall(self.normalise(text)) for text in texts]
        self.learn(set().union(*split))
        young, out = self.young, []
        for words in split:
            try:
                out.append(b"".join(map(young.__getitem__, words)))
            except KeyError:  # words too long to be remembered
                out.append(b"".join([young[w] if w in young else self.ids_of(self.shortest_path(w)) for w in words]))
        if len(young) > MEMO:
            self.old, self.young = young, {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the inverse transducer, without the blank that was put in front; bytes that aren't UTF-8 become U+FFFD, and so does an id that no piece has."""
        output, n = self.output, len(self.output)
        text = b"".join([output[i] if 0 <= i < n else b"\xff" for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text[:1] == " " else text


_loaded: dict[str, Transducer] = {}


def _transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer.load(path)
    return _loaded[path]


def _passed(frame: DataFrame, drop: str, name: str, kind: T.DataType) -> T.StructType:
    fields = [f for f in frame.schema if f.name not in (drop, name)]
    return T.StructType([*fields, T.StructField(name, kind)])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids array<int> added: the encoding of the whole text.

    Null or empty text: no ids. A very long text is encoded whole, word by word; a
    word of any length is one part. Ties between paths can't be, or go to the
    shortest first piece. A column named ids is replaced; all others pass, whatever
    their names. Repeated rows and null ids each get theirs; an empty table gives an
    empty table.
    """
    schema = _passed(docs, "", "ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model)
        for batch in batches:
            for part, texts in text_slices(batch, limit=SLICE):
                encoded = transducer.encode_all(texts)
                offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in schema.fields[:-1]], ids], names=schema.names)

    return arrow_map(docs.withColumn("text", F.col("text").cast("string")), run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded(ids) with text string added, from the ids alone; null ids: empty; an id that no piece has, or a null one, is U+FFFD. A column named text is replaced."""
    schema = _passed(encoded, "", "text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model)
        for batch in batches:
            ids = batch.column("ids")
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [transducer.decode(pc.fill_null(x.values, -1).to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in ids.slice(at, 500)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in schema.fields[:-1]], pa.array(texts, pa.string())], names=schema.names)

    return arrow_map(encoded, run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded and decoded again: doc_id, n_tokens, ids, decoded_sha256."""
    model = default_model()
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = decode(encoded.select("doc_id", "ids"), model)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
