"""Thousands of replacement rules in one pass: an automaton over the rules' literals tells which of them can act on a text, and only those are applied."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.words import _pattern, replaced
from tidemark.session import ship

#: Kinds with literals, in the order in which they act; rules of one kind act in the order given.
ORDER = ("whole", "begin", "end", "partial", "literal", "word", "word_start", "word_end")
#: Kinds of rule files as kinds of rules; the word stages act on lines here.
FILE_KINDS = {"whole_line": "whole", "begin_line": "begin", "end_line": "end", "partial_line_always": "partial", "partial_line": "partial", "partial_word_always": "literal", "partial_word": "literal", "whole_word": "word", "regex": "regex"}
#: Cells of the automaton's table at most (4 bytes each), the size up to which it is sent to every task; and bytes of texts that are scanned at once.
CELLS, SCANNED = 32_000_000, 4_000_000
#: Bytes of a table's literals from which whole words go by joins.
SENT = 500_000
_STRIPS = 4096


class Automaton:
    """An automaton over byte strings as arrays: a row of next states for each state, a column for each byte that occurs in any string and one for all others."""

    def __init__(self, literals: list[bytes]):
        used = sorted({b for literal in literals for b in literal})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width, self.longest = len(used) + 1, max(map(len, literals), default=0)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, literal in enumerate(literals):
            state = 0
            for b in literal:
                state = children[state].setdefault(int(self.classes[b]), len(children))
                if state == len(children):
                    children.append({})
                    ends.append([])
            ends[state].append(number)
            if len(children) * self.width > CELLS:
                raise ValueError(f"rules of more than {CELLS} table cells are too large to be sent to every task")
        self.next = np.zeros((len(children), self.width), np.int32)
        fall = np.zeros(len(children), np.int32)
        self.longer = np.zeros(len(children), np.int32)  # the longest shorter end, 0 for none
        order = deque([0])
        while order:
            state = order.popleft()
            row = self.next[fall[state]].copy() if state else np.zeros(self.width, np.int32)
            for c, child in children[state].items():
                fall[child] = row[c] if state else 0
                self.longer[child] = fall[child] if ends[fall[child]] else self.longer[fall[child]]
                row[c] = child
                order.append(child)
            self.next[state] = row
        self.ends = ends
        self.ending = np.array([bool(e) for e in ends]) | (self.longer > 0)

    def numbers(self, state: int) -> set[int]:
        """The strings that end in a state."""
        found = set()
        while state:
            found.update(self.ends[state])
            state = int(self.longer[state])
        return found

    def scan(self, texts: list[bytes]) -> list[set[int]]:
        """The strings that occur in each text. The texts are laid end to end and cut into strips that are read side by side, each into the next by a string's length."""
        found: list[set[int]] = [set() for _ in texts]
        if not self.longest or not texts:
            return found
        sizes = np.array([len(t) + 1 for t in texts])
        classes = self.classes[np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)]
        bounds = np.cumsum(sizes)
        classes[bounds - 1] = 0  # what parts texts is in no string
        step = -(-len(classes) // _STRIPS)
        starts = np.arange(0, len(classes), step)
        state, flat = np.zeros(len(starts), np.int32), self.next.ravel()
        padded = np.concatenate([classes, np.zeros(step + self.longest, np.int32)])
        states = {}
        for t in range(step + self.longest - 1):
            state = flat[state * self.width + padded[starts + t]]
            for i in np.flatnonzero(self.ending[state]):
                states.setdefault(int(state[i]), set()).add(int(np.searchsorted(bounds, starts[i] + t, "right")))
        for s, owners in states.items():
            numbers = self.numbers(s)
            for i in owners:
                found[i] |= numbers
        return found

    def scan_one(self, text: bytes) -> set[int]:
        """The strings that occur in a short text."""
        found, state = set(), 0
        for c in self.classes[np.frombuffer(text, np.uint8)].tolist():
            state = self.next.item(state, c)
            if self.ending[state]:
                found |= self.numbers(state)
        return found


class Rulebook:
    """Ordered rules (kind, old, new) with literals. A rule can only act where its literal stands, so a text is scanned once, and after each change only what lies around it."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = sorted((r for r in rules if r[1]), key=lambda r: ORDER.index(r[0]))
        self.automaton = Automaton([r[1].encode() for r in self.rules])
        self.reach = max((len(r[1]) for r in self.rules), default=0)
        self.patterns: dict[int, regex.Pattern] = {}
        unused = np.flatnonzero(self.automaton.classes[:128] == 0)
        self.parted = chr(unused[0]) if len(unused) else None  # in no literal, so what lies around several changes can be scanned at once

    def key(self, i: int) -> str:
        """What a rule is counted under."""
        kind, old, new = self.rules[i]
        return f"{old}>{new}" if kind == "literal" else f"{kind}:{old}"

    def spans(self, i: int, text: str) -> list[tuple[int, int]]:
        """Where a rule acts on a text."""
        kind, old, _ = self.rules[i]
        if kind == "whole":
            return [(0, len(text))] if text.strip(" ") == old else []
        if kind in ("begin", "end"):
            return ([(0, len(old))] if text.startswith(old) else []) if kind == "begin" else [(len(text) - len(old), len(text))] if text.endswith(old) else []
        if i not in self.patterns:
            self.patterns[i] = regex.compile(_pattern("literal" if kind == "partial" else kind, old))
        return [m.span() for m in self.patterns[i].finditer(text)]

    def apply(self, text: str, found: set[int]) -> tuple[str, dict[str, int]]:
        """The text after all rules and how often each acted; found are the rules whose literals the text has."""
        waiting, known, counts, whole = list(found), set(found), {}, False
        heapq.heapify(waiting)
        while waiting:
            i = heapq.heappop(waiting)
            kind, _, new = self.rules[i]
            spans = [] if kind == "whole" and whole else self.spans(i, text)
            if not spans:
                continue
            whole |= kind == "whole"
            counts[self.key(i)] = counts.get(self.key(i), 0) + len(spans)
            parts, around, at, size = [], [], 0, 0
            for start, end in spans:
                parts += [text[at:start], new]
                size += start - at
                around.append((max(size - self.reach, 0), size + len(new) + self.reach))
                size, at = size + len(new), end
            text = "".join([*parts, text[at:]])
            merged = []
            for start, end in around:
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = end
                else:
                    merged.append([start, end])
            joined = text if self.parted is None else self.parted.join(text[start:end] for start, end in merged)
            for j in self.automaton.scan_one(joined.encode()):
                if j > i and j not in known:
                    known.add(j)
                    heapq.heappush(waiting, j)
        return text, counts


def words_applied(rows: DataFrame, column: str, rules: DataFrame, fixes: str = "fixes") -> DataFrame:
    """rows with a text after rules(old, new), and fixes, by joins: any number of rules, of which a task holds those of its texts.

    For rules of whole words whose literals are words and whose replacements hold none
    they may act in any order, since none makes or breaks another's word. Each text's
    words meet the rules, and the rules that it needs come back to it; texts are told
    apart by 128 bits. Spark splits the joins of common words and texts.
    """
    ship(rows.sparkSession)
    words = regex.compile(r"[\p{L}\p{N}_]+")
    key = (F.xxhash64(column).alias("__k1"), F.xxhash64(F.lit(1), column).alias("__k2"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [sorted(set(words.findall(t or ""))) for t in part.column("text").to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
                yield pa.RecordBatch.from_arrays([part.column("__k1").take(owner), part.column("__k2").take(owner), pa.array([w for o in own for w in o], pa.string())], names=["__k1", "__k2", "old"])

    names = [f.name for f in rows.schema.fields if f.name != fixes]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField(fixes, T.MapType(T.StringType(), T.IntegerType()))])
    kind = pa.map_(pa.string(), pa.int32())

    def apply(text: str, own: list[dict]) -> tuple[str, list[tuple[str, int]]]:
        news, counts = {r["old"]: r["new"] for r in own}, {}

        def put(match: regex.Match) -> str:
            word = match.group()
            if word not in news:
                return word
            counts[f"word:{word}"] = counts.get(f"word:{word}", 0) + 1
            return news[word]

        return words.sub(put, text), list(counts.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [apply(t, own) if own else (t, []) for t, own in zip(part.column(column).to_pylist(), part.column("__rules").to_pylist())]
                columns = [part.column(n) if n != column else pa.array([d[0] for d in done], pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], kind)], names=[*names, fixes])

    met = rows.select(*key, F.col(column).cast("string").alias("text")).mapInArrow(tokens, "__k1 long, __k2 long, old string").join(rules.select("old", "new"), "old")
    needed = met.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("old", "new")).alias("__rules"))  # at most one text's words
    return rows.select(*names, *key).join(needed, ["__k1", "__k2"], "left").select(*names, "__rules").mapInArrow(run, schema)


def rules_applied(rows: DataFrame, column: str, rules: list[tuple[str, str, str]] | DataFrame, fixes: str = "fixes", sent: int = SENT) -> DataFrame:
    """rows with a text after rules(kind, old, new), and fixes, a map of each rule that acted to how often.

    The result is that of the rules one after the other, kinds in ORDER, then regular
    expressions. One of the whole kind, the first that fits, acts at most. Rules with an
    empty literal are left out. A table of rules needs a column at for their order, or
    is taken by kind and literal. A null text stays null.

    The automaton over all literals is built once, must keep within CELLS, and goes to
    every task. In a table whose literals have more than sent bytes, whole words that
    words_applied can take go by joins instead, if no other rule acts among or between
    words, and only the rest goes to the automaton.
    """
    ship(rows.sparkSession)
    if isinstance(rules, DataFrame):
        order = ["file", "at"] if {"file", "at"} <= set(rules.columns) else ["at"] if "at" in rules.columns else ["kind", "old", "new"]
        size = lambda part: part.agg(F.sum(F.octet_length("old") + 1)).first()[0] or 0
        if size(rules) > sent:
            whole = F.col("kind").isin("whole_word", "word")
            plain = F.col("old").rlike(r"^[\p{L}\p{N}_]+\z") & ~F.coalesce("new", F.lit("")).rlike(r"[\p{L}\p{N}_]")
            among = rules.where(F.coalesce(F.col("old") != "", F.lit(False)) & ((whole & ~plain) | F.col("kind").isin("word_start", "word_end", "regex")))
            if among.isEmpty():
                first = rules.where(whole & plain).groupBy("old").agg(F.min_by(F.coalesce("new", F.lit("")), F.struct(*order)).alias("new"))
                made = rules_applied(rows, column, rules.where(~whole), "__others", CELLS)
                return words_applied(made, column, first, "__words").withColumn(fixes, F.map_concat("__others", "__words")).drop("__others", "__words")
        if size(rules) > CELLS:
            raise ValueError("rules are too large to be sent to every task")
        rules = [(r.kind, r.old, r.new or "") for r in rules.orderBy(*order).collect()]
    rules = [(FILE_KINDS.get(kind, kind), old, new) for kind, old, new in rules]
    book = rows.sparkSession.sparkContext.broadcast(Rulebook([r for r in rules if r[0] != "regex"]))
    names = [f.name for f in rows.schema.fields if f.name != fixes]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField(fixes, T.MapType(T.StringType(), T.IntegerType()))])
    kind = pa.map_(pa.string(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held < SCANNED):
                    held += len(texts[end] or "")
                    end += 1
                some = texts[start:end]
                found = book.value.automaton.scan([(t or "").encode() for t in some])
                done = [(t, {}) if not f else book.value.apply(t, f) for t, f in zip(some, found)]
                part = batch.slice(start, end - start)
                columns = [part.column(n) if n != column else pa.array([d[0] for d in done], pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([list(d[1].items()) for d in done], kind)], names=[*names, fixes])
                start = end

    made = rows.select(*names).mapInArrow(run, schema)
    patterns = [r for r in rules if r[0] == "regex"]
    if patterns:
        made = replaced(made, column, patterns, "__patterns").withColumn(fixes, F.map_concat(fixes, "__patterns")).drop("__patterns")
    return made
