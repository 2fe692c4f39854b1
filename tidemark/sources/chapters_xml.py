"""Chapter lists as XML texts: reading them into atoms with displays, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import chapter_tag
from tidemark.operators.chapters import format_ns, parse_ns

_ATOM = r"(?s)<(?:[\w.-]+:)?ChapterAtom\b[^>]*>(.*?)</(?:[\w.-]+:)?ChapterAtom>"
_DISPLAY = r"(?s)<(?:[\w.-]+:)?ChapterDisplay\b[^>]*>(.*?)</(?:[\w.-]+:)?ChapterDisplay>"
#: Entities of the five characters, the ampersand's last when reading.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _element(text: Column, name: str) -> Column:
    """What an element holds, null without it; a prefix is passed over."""
    pattern = rf"(?s)<(?:[\w.-]+:)?{name}\b[^>]*>(.*?)</(?:[\w.-]+:)?{name}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escaped(text: Column) -> Column:
    for entity, char in reversed(ENTITIES.items()):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def read_chapters(documents: DataFrame) -> DataFrame:
    """(doc, id, start_ns, end_ns, displays array of (name, lang, tag)) of XML documents(doc, content); atoms without a start fall out.

    id counts a document's atoms with a start from 1 in the order they stand. One
    without a display gets the name Chapter and its number. A language that is
    missing is und, and a missing tag is the language's.
    """
    atoms = documents.select("doc", F.posexplode(F.regexp_extract_all("content", F.lit(_ATOM), 1)).alias("at", "atom"))
    start = _element(F.col("atom"), "ChapterTimeStart")
    timed = atoms.select("doc", "at", "atom", start.alias("start"), _element(F.col("atom"), "ChapterTimeEnd").alias("end")).where("start is not null")

    def display(d: Column) -> Column:
        lang = F.trim(F.coalesce(_element(d, "ChapterLanguage"), F.lit("")))
        lang = F.when(lang == "", "und").otherwise(lang)
        tag = F.trim(F.coalesce(_element(d, "ChapLanguageIETF"), F.lit("")))
        return F.struct(unescaped(F.coalesce(_element(d, "ChapterString"), F.lit(""))).alias("name"), lang.alias("lang"), F.when(tag == "", chapter_tag(lang)).otherwise(tag).alias("tag"))

    id_ = F.row_number().over(Window.partitionBy("doc").orderBy("at"))
    found = timed.select("doc", id_.cast("int").alias("id"), parse_ns(F.trim("start")).alias("start_ns"), parse_ns(F.trim("end")).alias("end_ns"), F.transform(F.regexp_extract_all("atom", F.lit(_DISPLAY), 1), display).alias("displays"))
    own = F.array(F.struct(F.concat(F.lit("Chapter "), F.col("id").cast("string")).alias("name"), F.lit("und").alias("lang"), F.lit("und").alias("tag")))
    return found.withColumn("displays", F.when(F.size("displays") == 0, own).otherwise(F.col("displays")))


def write_chapters(rows: DataFrame) -> DataFrame:
    """(doc, content): chapters (doc, start_ns, end_ns, displays) as XML documents, by start, ends only where there are any, names escaped, indented by two."""
    def leaf(depth: int, name: str, value: Column) -> Column:
        return F.concat(F.lit(" " * depth + f"<{name}>"), value, F.lit(f"</{name}>\n"))

    def display(d: Column) -> Column:
        return F.concat(F.lit("      <ChapterDisplay>\n"), leaf(8, "ChapterString", escaped(d["name"])), leaf(8, "ChapterLanguage", escaped(d["lang"])), leaf(8, "ChapLanguageIETF", escaped(d["tag"])), F.lit("      </ChapterDisplay>\n"))

    atom = F.concat(
        F.lit("    <ChapterAtom>\n"), leaf(6, "ChapterTimeStart", format_ns(F.col("start_ns"))), F.when(F.col("end_ns").isNotNull(), leaf(6, "ChapterTimeEnd", format_ns(F.col("end_ns")))).otherwise(""),
        F.array_join(F.transform("displays", display), ""), F.lit("    </ChapterAtom>\n"),
    )
    joined = rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ns", atom.alias("a")))), lambda x: x["a"]), "").alias("atoms"))
    return joined.select("doc", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Chapters>\n  <EditionEntry>\n'), F.col("atoms"), F.lit("  </EditionEntry>\n</Chapters>")).alias("content"))
