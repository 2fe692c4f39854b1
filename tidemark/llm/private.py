"""Operator 9: personal data, by fixed patterns and by a tagger that reads overlapping windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, text_slices
from tidemark.llm.tagger import KINDS, PAD, Tagger, classes, first_tag
from tidemark.session import table

EMAIL, IP, CARD, PHONE = range(4)
#: Windows of code points and how far apart they start.
WINDOW, STRIDE = 96, 48
#: Windows that are decoded at once.
DECODED = 1024
#: Labelled windows that the tagger is trained on, and passes over them.
TRAINED, EPOCHS = 3000, 12
#: The weights that training gave.
WEIGHTS = files("tidemark.llm") / "tagger.npz"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*")
_TELLING = re.compile(r"[0-9@]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def holds(kind: int, text: str) -> bool:
    """Whether a span's text can be of its kind: the contract's checks, and an email's or address's own shape."""
    digits = "".join(_DIGITS.findall(text))
    if kind == CARD:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == PHONE:
        return 10 <= len(digits) <= 15
    parts = text.split(".")
    if kind == IP:
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    return "@" in text and "." in text.rpartition("@")[2]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the contract's patterns, each kind leftmost and non-overlapping, failing matches dropped. Linear in the text: a run of digits or of name characters is read once for each kind."""
    found: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, EMAIL, done))
        else:
            done = at + 1  # no name runs across it
        at = text.find("@", max(done, at + 1))
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b - a == 1 and text[a] == "." for (_, a), (b, _) in zip(four, four[1:])):
            if holds(IP, text[four[0][0] : four[3][1]]):
                found.append((four[0][0], IP, four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
        size = sum(b - a for a, b in runs[i : j + 1])
        if 14 <= size <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            found.append((runs[i][0], CARD, runs[j][1]))
        i = j + 1
    if runs:
        for match in _PHONE.finditer(text):
            whole = match.group()
            end = len(whole)
            while not "0" <= whole[end - 1] <= "9":
                end -= 1
            if end >= 4 and holds(PHONE, whole[:end]):
                found.append((match.start(), PHONE, match.start() + end))
    return sorted(found)


def window_starts(n: int) -> range:
    """Starts of the windows that cover n code points, each overlapping the next by half."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans (start, kind, end) that the tagger finds in each whole text, reconciled over all its windows.

    Windows overlap by half. A span must pass holds(), so it has a digit or an @:
    windows with either are decoded, then those beyond an edge that a span touches,
    until none is left. So a span of any length is met whole, in pieces.
    """
    codes, pieces, asked = [], [], []
    for i, text in enumerate(texts):
        pieces.append({})
        last = len(window_starts(len(text))) - 1
        telling = {k for m in _TELLING.finditer(text) for k in ((m.start() // STRIDE - 1), m.start() // STRIDE)}
        codes.append(classes(text) if telling else None)
        asked += [(i, k) for k in sorted({min(max(k, 0), last) for k in telling})]
    while asked:
        beyond = set()
        for at in range(0, len(asked), DECODED):
            some = asked[at : at + DECODED]
            windows = np.full((len(some), WINDOW), PAD, dtype=np.uint8)
            for window, (i, k) in zip(windows, some):
                part = codes[i][k * STRIDE : k * STRIDE + WINDOW]
                window[: len(part)] = part
            for (i, k), tags in zip(some, tagger.decode(windows)):
                spans = [(k * STRIDE + a, kind, min(k * STRIDE + b, len(texts[i]))) for a, kind, b in spans_of_tags(tags) if k * STRIDE + a < len(texts[i])]
                pieces[i][k] = spans
                if spans and spans[0][0] == k * STRIDE and k:
                    beyond.add((i, k - 1))
                if spans and spans[-1][2] == k * STRIDE + WINDOW < len(texts[i]):
                    beyond.add((i, k + 1))
        asked = sorted((i, k) for i, k in beyond if k not in pieces[i])
    return [reconciled(text, own) if own else [] for text, own in zip(texts, pieces)]


def reconciled(text: str, pieces: dict[int, list[Span]]) -> list[Span]:
    """One set of spans from what each window says (its number: its spans).

    A span that touches a window's edge inside the text is a piece: it is joined to
    the piece of the same kind that the next window starts with, however many
    windows follow, and the later window says where it ends. A piece that its
    neighbour, which sees the place from its middle, doesn't go on with is no span.
    Each window that has a span whole, or joined, gives it the depth in the window
    as a weight, and of all sets of spans that don't overlap the one of most weight
    is the result, the leftmost of equals.
    """
    weights: dict[Span, int] = {}
    running: list[Span] = []
    for k in sorted(pieces):
        left, right = k * STRIDE, k * STRIDE + WINDOW
        running = running if k - 1 in pieces else []
        on: list[Span] = []
        for a, kind, b in pieces[k]:
            depth = min(a - left if k else WINDOW, right - b if right < len(text) else WINDOW)
            if k and a == left:
                before = [r for r in running if r[1] == kind and r[0] < a < r[2]]
                if not before:
                    continue
                a, depth = before[0][0], WINDOW
            if b == right < len(text):
                on.append((a, kind, b))
            elif holds(kind, text[a:b]):
                weights[a, kind, b] = weights.get((a, kind, b), 0) + 1 + depth
        running = on
    return heaviest_apart(weights)


def heaviest_apart(weights: dict[Span, int]) -> list[Span]:
    """Of the sets of spans that don't overlap the one with the greatest sum of weights, in order."""
    spans = sorted(weights, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    total, before = [0], []
    for i, span in enumerate(spans):
        before.append(bisect_right(ends, span[0], 0, i))
        total.append(max(total[i], total[before[i]] + weights[span]))
    kept, i = [], len(spans)
    while i:
        if total[i] == total[i - 1]:
            i -= 1
        else:
            kept.append(spans[i - 1])
            i = before[i - 1]
    return kept[::-1]


def spans_of_tags(tags: np.ndarray) -> list[Span]:
    spans = []
    firsts = np.flatnonzero((tags > 0) & (tags % 2 == 1))
    for a in firsts.tolist():
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        spans.append((a, (int(tags[a]) - 1) // 2, b))
    return spans


def labelled_windows(n: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Invented windows with their tags: words of random syllables with data of each kind between them, often side by side, and with numbers, versions, keys and dates that are none."""
    rng = np.random.default_rng(seed)

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def word() -> str:
        w = "".join(rng.choice(list("abcdeghilmnoprstuéäñ"), rng.integers(1, 9)))
        return (w.capitalize() if rng.random() < 0.15 else w) + ("", "", "", "", ".", ",")[rng.integers(6)]

    def card() -> str:
        body = digits(int(rng.integers(13, 19)))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = ("", "", " ", "-")[rng.integers(4)]
        return mark.join(body[i : i + 4] for i in range(0, len(body), 4)) if mark else body

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return (f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{rng.integers(1, 99)}-{a}-{b}-{c}", f"+{digits(11)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")[rng.integers(7)]

    def email() -> str:
        letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
        return f"{letters}{('', '.', '_')[rng.integers(3)]}{digits(int(rng.integers(0, 3)))}@mail{digits(int(rng.integers(0, 2)))}.{('example', 'post', 'firm-x')[rng.integers(3)]}.{('com', 'org', 'de', 'fr')[rng.integers(4)]}"

    def ip() -> str:
        return ".".join(map(str, rng.integers(0, 256, 4)))

    def neither() -> str:
        hexes = "".join(rng.choice(list("0123456789abcdef"), rng.integers(12, 41)))
        capitals = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
        return (f"{rng.integers(0, 20)}.{rng.integers(0, 10)}", digits(int(rng.integers(1, 8))), f"password={hexes}", f'token = "{hexes}"', f"AKIA{capitals}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"v{rng.integers(0, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 9)}", f"@{word()}", f"{digits(2)}:{digits(2)}", f"{rng.integers(1, 99)}%")[rng.integers(10)]

    makers = (email, ip, card, phone)
    x, y = np.full((n, WINDOW), PAD, dtype=np.uint8), np.zeros((n, WINDOW), dtype=np.int8)
    for row in range(n):
        text, tags = "", []
        while len(text) < WINDOW + STRIDE:
            kind = int(rng.choice([-2, -1, 0, 1, 2, 3], p=[0.62, 0.1, 0.07, 0.07, 0.07, 0.07]))
            piece = word() if kind == -2 else neither() if kind == -1 else makers[kind]()
            text += piece
            tags += [0] * len(piece) if kind < 0 else [first_tag(kind)] + [first_tag(kind) + 1] * (len(piece) - 1)
            text += "\n" if rng.random() < 0.04 else " "
            tags.append(0)
        at = int(rng.integers(0, STRIDE))
        x[row] = classes(text)[at : at + WINDOW]
        own = np.array(tags[at : at + WINDOW], dtype=np.int8)
        if own[0] and own[0] % 2 == 0:  # a span that began before the window begins with it
            own[0] -= 1
        y[row] = own
    return x, y


def train() -> Tagger:
    """The tagger, trained on TRAINED invented windows; about half a minute."""
    tagger = Tagger.fresh().single()
    tagger.fit(*labelled_windows(TRAINED), EPOCHS)
    return tagger


@cache
def trained_tagger() -> Tagger:
    """What train() gave when this module was last run as a script, which writes the weights beside it; a test trains anew and compares."""
    with WEIGHTS.open("rb") as file:
        weights = dict(np.load(file))
    return Tagger(weights, weights["re"].shape[1])


def find_private(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, base, added): spans of each row's whole text as arrays of (start, kind, end), by start and then kind.

    base has the contract's patterns. added has the tagger's spans that overlap no
    base span. Null or empty text: no spans. A very long text is read whole, its
    windows some at a time. Of overlapping added spans the heaviest set stays, the
    leftmost of ties. Repeated rows and null ids each get theirs; an empty table
    gives an empty table; other columns, whatever their names, are ignored.
    """
    tagger = tagger or trained_tagger()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                base = [base_spans(t) if _TELLING.search(t) else [] for t in texts]
                added = []
                for own, more in zip(base, tagged_spans(tagger, texts)):
                    added.append(apart(more, own))
                rows = [[[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans] for spans in column] for column in (base, added)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows[0], span), pa.array(rows[1], span)], names=["doc_id", "base", "added"])

    kind = "array<struct<start: long, kind: string, end: long>>"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, base {kind}, added {kind}")


def apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of spans that overlap none of others; both are sorted."""
    if not spans or not others:
        return spans
    starts = np.array([a for a, _, _ in others])
    ends = np.maximum.accumulate(np.array([b for _, _, b in others]))
    out = []
    for a, kind, b in spans:
        before = int(np.searchsorted(starts, b))  # others that start before this one's end
        if not before or ends[before - 1] <= a:
            out.append((a, kind, b))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """A text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, done = [], 0
    for a, kind, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind]}>"]
            done = b
    return "".join([*out, text[done:]])


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans."""
    found = find_private(table(spark, sf_dir, "documents"))
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)])

    def written(spans):
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))


if __name__ == "__main__":
    np.savez(str(WEIGHTS), **train().weights)
