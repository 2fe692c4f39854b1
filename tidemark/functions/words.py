"""Word-level functions: kana to Latin letters, rules that replace one after another, word validity, fixes and splits."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Syllables that are not spelled as their letters' names, and pairs for foreign words.
SPELLED = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
FOREIGN = {
    "ファ": "fa", "フィ": "fi", "フェ": "fe", "フォ": "fo", "ティ": "ti", "ディ": "di", "トゥ": "tu", "ドゥ": "du", "ウィ": "wi", "ウェ": "we", "ウォ": "wo", "ヴァ": "va", "ヴィ": "vi", "ヴェ": "ve", "ヴォ": "vo",
    "シェ": "she", "ジェ": "je", "チェ": "che", "ツァ": "tsa", "ツィ": "tsi", "ツェ": "tse", "ツォ": "tso",
}
STOPS, LONG = "っッ", "ー"


@cache
def kana() -> dict[str, str]:
    """The Latin spelling of each kana and pair of kana, from the letters' names: those on i with a small ya, yu or yo lose their i."""
    single = {}
    for point in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)):
        name = unicodedata.name(chr(point), "")
        if " LETTER " in name and chr(point) not in STOPS:
            letter = name.rsplit(" ", 1)[1].lower()
            single[chr(point)] = SPELLED.get(letter, letter)
    pairs = {}
    for first, spelled in single.items():
        for small, vowel in zip("ゃゅょ" if first < "゠" else "ャュョ", "auo"):
            if len(spelled) > 1 and spelled.endswith("i") and spelled[0] not in "wv":
                stem = spelled[:-1]
                pairs[first + small] = stem + vowel if stem in ("sh", "ch", "j") else f"{stem}y{vowel}"
    return {**single, **pairs, **FOREIGN, **dict.fromkeys(STOPS, ""), LONG: ""}


@cache
def _kana_pattern() -> re.Pattern:
    return re.compile("|".join(sorted(kana(), key=len, reverse=True)))


def latin(text: str) -> str:
    """kana of a text in Latin letters, the longest first; a stop doubles the next syllable's first letter, a long mark the vowel before it; all else stays."""
    table, pattern = kana(), _kana_pattern()
    out: list[str] = []
    at = 0
    while at < len(text):
        match = pattern.match(text, at)
        if not match:
            out.append(text[at])
            at += 1
            continue
        own, at = match.group(), match.end()
        if own in STOPS:
            following = pattern.match(text, at)
            if following and table[following.group()]:
                out.append(table[following.group()][0])
        elif own == LONG:
            if out and out[-1][-1:] in tuple("aeiou"):
                out.append(out[-1][-1])
        else:
            out.append(table[own])
    return "".join(out)


def romanised(text: Column) -> Column:
    """F43 in Arrow batches, as syllables look at what was written before them."""

    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else latin(t))

    return convert(text)


def romanised_words(lines: DataFrame) -> DataFrame:
    """(word): the distinct Latin spellings of the kana readings in lines(line) of a dictionary, marked as reb elements."""
    readings = lines.select(F.explode(F.regexp_extract_all("line", F.lit("<reb>([^<]+)</reb>"), 1)).alias("kana")).distinct()
    return readings.select(F.lower(romanised(F.col("kana"))).alias("word")).where("word <> ''").distinct()


#: Rules are (kind, from, to). The order of kinds.
KINDS = ("literal", "word", "word_start", "word_end", "regex")


def _pattern(kind: str, text: str) -> str:
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
    before, after = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"  # borders of words in any script
    return {"literal": quoted, "word": f"{before}{quoted}{after}", "word_start": f"{before}{quoted}", "word_end": f"{quoted}{after}", "regex": text}[kind]


def replaced(rows: DataFrame, column: str, rules: list[tuple[str, str, str]], fixes: str = "fixes") -> DataFrame:
    """rows with a text after rules, kind by kind, each applied to what those before it left, and fixes, a map of each rule that met something to how often."""
    counts = []
    for i, (kind, old, new) in enumerate(sorted(rules, key=lambda r: KINDS.index(r[0]))):
        name, pattern = f"__n{i}", _pattern(kind, old)
        rows = rows.withColumn(name, F.regexp_count(F.col(column), F.lit(pattern)))
        rows = rows.withColumn(column, F.regexp_replace(column, pattern, new.replace("\\", "\\\\").replace("$", "\\$") if kind != "regex" else new))
        counts.append(F.struct(F.lit(f"{old}>{new}" if kind == "literal" else f"{kind}:{old}").alias("key"), F.col(name).alias("value")))
    listed = F.map_from_entries(F.filter(F.array(*counts), lambda e: e["value"] > 0)) if counts else F.create_map().cast("map<string,int>")
    return rows.withColumn(fixes, listed).drop(*[f"__n{i}" for i in range(len(rules))])


def confidence_replaced(rows: DataFrame, column: str, confidence: Column, rules: list[tuple[str, str, str]], below: float = 60.0) -> DataFrame:
    """rules that are applied only to texts read with little confidence."""
    fixed = replaced(rows.withColumn("__was", F.col(column)), column, rules, "__fixes")
    return fixed.withColumn(column, F.when(confidence < below, F.col(column)).otherwise(F.col("__was"))).drop("__was", "__fixes")


def fixed_lines(rows: DataFrame, column: str, whole: dict[str, str], begin: dict[str, str], end: dict[str, str], partial: dict[str, str], patterns: dict[str, str]) -> DataFrame:
    """a line after its rules in order: as a whole (the first that is it, blanks at its ends aside), at its begin, at its end, anywhere, by regular expressions; each stage and rule on what is left by those before."""
    text = F.col(column)
    out = text
    for old, new in reversed(whole.items()):
        out = F.when(F.trim(text) == old, new).otherwise(out)
    rows = rows.withColumn(column, out)
    for old, new in begin.items():
        rows = rows.withColumn(column, F.when(F.col(column).startswith(old), F.concat(F.lit(new), F.substring(F.col(column), F.lit(len(old) + 1), F.length(column)))).otherwise(F.col(column)))
    for old, new in end.items():
        rows = rows.withColumn(column, F.when(F.col(column).endswith(old), F.concat(F.substring(F.col(column), F.lit(1), F.length(column) - len(old)), F.lit(new))).otherwise(F.col(column)))
    for old, new in partial.items():
        rows = rows.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))
    for pattern, new in patterns.items():
        rows = rows.withColumn(column, F.regexp_replace(column, pattern, new))
    return rows


_SHORT_RUN = r"(\b[A-Z]{1,2}\b\s*){3,}"


def is_garbage(line: Column, confidence: Column, below: float = 40.0) -> Column:
    """Whether a line is no text: of three bytes at least, and mostly short words where it was read with little confidence, or a run of short words in capitals that make up over half of it, or nearly all capitals with many blanks."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    short = F.size(F.filter(words, lambda w: F.octet_length(w) <= 2))
    capital = F.size(F.filter(words, lambda w: (F.octet_length(w) <= 2) & w.rlike(r"^\p{Lu}+$")))
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    blanks = F.regexp_count(text, F.lit(" "))
    unsure = (confidence < below) & (n >= 3) & (short / n > 0.6)
    run = text.rlike(_SHORT_RUN) & (capital >= 3) & (capital / n > 0.5)
    shouted = (letters > 0) & (F.coalesce(F.try_divide(upper, letters), F.lit(0.0)) > 0.8) & (F.coalesce(F.try_divide(blanks, F.octet_length(text)), F.lit(0.0)) > 0.3)
    return (F.octet_length(text) >= 3) & (unsure | run | shouted)


def cleaned(text: Column) -> Column:
    """A text of lines parted by \\N without garbage lines, and lines without a leading run of short words in capitals where what follows is text; a text of one line is kept or emptied."""
    lines = F.split(text, r"\\N")
    sure = F.lit(100.0)

    def line(x: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(x, f"^{_SHORT_RUN}", ""), r"^\s+|\s+$", "")
        return F.when(x.rlike(f"^{_SHORT_RUN}") & (rest != "") & ~is_garbage(rest, sure), rest).otherwise(x)

    kept = F.filter(F.transform(F.filter(lines, lambda x: ~is_garbage(x, sure)), line), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) == 1, F.when(is_garbage(text, sure), "").otherwise(text)).otherwise(F.array_join(kept, "\\N"))


def dictionary(lists: DataFrame) -> DataFrame:
    """(word): the distinct words of lists(list_name, word, ...), in lower case."""
    return lists.select(F.lower("word").alias("word")).distinct()


def known_words(words: DataFrame, lists: DataFrame) -> DataFrame:
    """words(word) with known_by, the first of lists(ord, list_name, word) that has it in any case, Compound where all its parts between hyphens are known, or null; and whether a list protects it.

    lists(protects) says which words mustn't be changed. A compound is protected if a part is.
    """
    distinct = words.select("word").distinct()
    parts = distinct.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), F.split("word", "-")))).alias("part"))
    own = lists.groupBy(F.lower("word").alias("__key")).agg(F.min_by("list_name", "ord").alias("list_name"), F.bool_or("protects").alias("protects"))
    found = parts.join(own, F.lower("part") == F.col("__key"), "left")
    whole, piece = F.col("part") == F.col("word"), F.col("word").contains("-") & (F.col("part") != F.col("word"))
    judged = found.groupBy("word").agg(
        F.max(F.when(whole, F.col("list_name"))).alias("own"), F.bool_or(F.when(whole, F.coalesce("protects", F.lit(False)))).alias("own_protects"),
        F.every(F.when(piece, F.col("list_name").isNotNull() & (F.col("part") != ""))).alias("all_parts"), F.bool_or(F.when(piece, F.coalesce("protects", F.lit(False)))).alias("part_protects"),
    )
    compound = F.col("own").isNull() & F.coalesce("all_parts", F.lit(False))
    known = F.coalesce("own", F.when(compound, "Compound"))
    return judged.select("word", known.alias("known_by"), F.when(F.col("own").isNotNull(), F.col("own_protects")).when(compound, F.col("part_protects")).otherwise(False).alias("protected"))


def split_merged(words: DataFrame, valid: DataFrame) -> DataFrame:
    """(word, split): distinct words(word) of three bytes at least that aren't valid(word) but fall into two that are, parted at the first place where they do."""
    distinct = words.select("word").distinct().where(F.octet_length("word") >= 3).join(valid.select(F.col("word").alias("__v")), F.lower("word") == F.col("__v"), "left_anti")
    cut = distinct.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).where("length(word) > 1")
    cut = cut.select("word", "at", F.lower(F.substring("word", F.lit(1), F.col("at"))).alias("left"), F.lower(F.substring("word", F.col("at") + 1, F.length("word"))).alias("right"))
    fits = cut.join(valid.select(F.col("word").alias("left")), "left", "left_semi").join(valid.select(F.col("word").alias("right")), "right", "left_semi")
    first = fits.groupBy("word").agg(F.min("at").alias("at"))
    return first.select("word", F.concat_ws(" ", F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 1, F.length("word"))).alias("split"))


def fix_words(words: DataFrame, whole: dict[str, str], partial: dict[str, str], protected: DataFrame, valid: DataFrame) -> DataFrame:
    """(word, fixed, rule) of distinct words(word): by a whole-word rule as it stands; else, punctuation at its ends aside and unless protected, by a whole-word rule or the first partial one. Only results that are valid count; without any the word stays and rule is null."""
    lookup = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair]) if whole else F.create_map().cast("map<string,string>")
    strip = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    parts = words.select("word").distinct().select("word", *[F.regexp_extract("word", strip, i + 1).alias(n) for i, n in enumerate(("before", "body", "after"))])
    guarded = parts.join(protected.select(F.col("word").alias("__p"), F.lit(True).alias("guarded")), F.lower("body") == F.col("__p"), "left")
    free = (F.col("body") != "") & F.col("guarded").isNull()

    def candidate(order: int, name: str, value: Column, when: Column, around: bool) -> Column:
        text = F.concat("before", value, "after") if around else value
        return F.when(when & value.isNotNull(), F.struct(F.lit(order).alias("ord"), F.lit(name).alias("rule"), value.alias("core"), text.alias("fixed")))

    own, bare = F.try_element_at(lookup, F.col("word")), F.try_element_at(lookup, F.col("body"))
    options = [candidate(0, "whole_word", own, F.lit(True), False), candidate(1, "whole_word", bare, free, True)]
    options += [candidate(2 + i, f"partial_word: {old} -> {new}", F.replace(F.col("body"), F.lit(old), F.lit(new)), free & F.col("body").contains(old), True) for i, (old, new) in enumerate(partial.items())]
    tried = guarded.select("word", F.explode(F.filter(F.array(*options), lambda c: c.isNotNull())).alias("c"))
    fitting = tried.join(valid.select(F.col("word").alias("__v")), F.lower("c.core") == F.col("__v"), "left_semi")
    best = fitting.groupBy("word").agg(F.min_by(F.struct("c.fixed", "c.rule"), "c.ord").alias("b"))
    return parts.select("word").join(best, "word", "left").select("word", F.coalesce("b.fixed", "word").alias("fixed"), F.col("b.rule").alias("rule"))


def tokens(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, word): the words of texts and the blanks between them, in order."""
    return rows.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(r"(\S+|\s+)"), 1)).alias("at", "word"))


def reassembled(words: DataFrame, key: str) -> DataFrame:
    """(key, text): words (key, at, word) in order, as one text again."""
    return words.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "").alias("text"))


def reading_report(lines: DataFrame, unknown: DataFrame, low: float = 60.0, top: int = 20) -> DataFrame:
    """(kind, key, n): counts of lines(confidence, fixes map), their confidence over 0 in hundredths, how often each rule met something, and the unknown words, most frequent first."""
    sure = F.col("confidence") > 0
    counts = lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.size("fixes") > 0).alias("fixed lines"), F.count_if(sure & (F.col("confidence") < low)).alias("low lines"),
        *[F.round(f(F.when(sure, F.col("confidence"))) * 100).cast("long").alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"))],
    )
    totals = counts.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("key"), F.col(c).cast("long").alias("n")) for c in counts.columns])).alias("r")).select("r.*")
    fixes = lines.select(F.explode("fixes").alias("key", "k")).groupBy("key").agg(F.sum("k").cast("long").alias("n")).select(F.lit("fix").alias("kind"), "key", "n")
    common = unknown.groupBy(F.col("word").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return totals.unionByName(fixes).unionByName(common.select(F.lit("unknown").alias("kind"), "key", "n"))
