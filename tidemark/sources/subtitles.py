"""Subtitle documents as tables: reading ASS, SSA, SubRip and WebVTT texts, and writing ASS, SubRip and JSON.

A document is a row (doc, content); all of them are read at once. Sections, blocks
and fields come from arrays of lines inside a row, so documents of any number are
read in parallel and nothing is gathered but what becomes one document again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import cue_to_overrides, from_overrides, to_overrides
from tidemark.operators.events import format_centis, format_millis, parse_centis

#: Encodings that bytes are tried in after UTF-8, in order.
FALLBACKS = ("shift_jis", "gbk", "gb2312", "big5", "windows-1252", "iso-8859-1")
_SRT_TIME = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})\s*-->\s*([0-9]{1,2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})"
_VTT_TIME = r"(?:([0-9]{1,2}):)?([0-9]{2}):([0-9]{2})[.]([0-9]{3})\s*-->\s*(?:([0-9]{1,2}):)?([0-9]{2}):([0-9]{2})[.]([0-9]{3})"


def detect_encoding(content: Column) -> Column:
    """(name, has_bom) of bytes: by their mark, else UTF-8 if they are, else the first fallback that all of them decode in."""
    head = F.substring(content, 1, 3)

    def starts(*marks: int) -> Column:
        return F.substring(head, 1, len(marks)) == F.lit(bytearray(marks))

    utf8 = F.is_valid_utf8(content)
    legacy = F.lit(FALLBACKS[-1])
    for name in FALLBACKS[-2::-1]:
        legacy = F.when(decodes(content, name), name).otherwise(legacy)
    name = F.when(starts(0xEF, 0xBB, 0xBF), "utf-8-sig").when(starts(0xFF, 0xFE), "utf-16-le").when(starts(0xFE, 0xFF), "utf-16-be").when(utf8, "utf-8").otherwise(legacy)
    return F.struct(name.alias("name"), (starts(0xEF, 0xBB, 0xBF) | starts(0xFF, 0xFE) | starts(0xFE, 0xFF)).alias("has_bom"))


def decodes(content: Column, name: str) -> Column:
    """Whether all bytes decode in an encoding, in Arrow batches, as the engine knows only some encodings."""
    @F.pandas_udf("boolean")
    def check(batch: pd.Series) -> pd.Series:
        def fine(data) -> bool:
            try:
                bytes(data).decode(name)
            except UnicodeDecodeError:
                return False
            return True

        return batch.map(lambda d: d is not None and fine(d))

    return check(content)


def _lines(content: Column) -> Column:
    """Lines of a text without their ends, none for an end at the text's end."""
    return F.split(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), r"\r?\n$", ""), r"\r?\n")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ass_lines(documents: DataFrame) -> DataFrame:
    """(doc, line_no, section_no, section, line) of every line of documents(doc, content); the lines before the first section have section_no 0 and no section."""
    rows = documents.select("doc", F.posexplode(_lines(F.col("content"))).alias("line_no", "line"))
    bare = _trimmed(F.col("line"))
    heading = bare.startswith("[") & bare.endswith("]")
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select("*", F.when(heading, bare).alias("__head"))
    return marked.select("doc", "line_no", F.count("__head").over(order).cast("int").alias("section_no"), F.last("__head", ignorenulls=True).over(order).alias("section"), "line").where(~heading)


def script_info(lines: DataFrame) -> DataFrame:
    """(doc, line_no, key, value) of the script's settings; comments have the key __comment__."""
    own = lines.where(F.lower("section") == "[script info]").select("doc", "line_no", _trimmed(F.col("line")).alias("s")).where("s <> ''")
    comment, at = F.col("s").startswith(";"), F.instr("s", ":")
    key = F.when(comment, "__comment__").otherwise(_trimmed(F.substring(F.col("s"), F.lit(1), at - 1)))
    value = F.when(comment, F.col("s")).otherwise(_trimmed(F.substring(F.col("s"), at + 1, F.length("s"))))
    return own.where(comment | (at > 0)).select("doc", "line_no", key.alias("key"), value.alias("value"))


def _formatted(lines: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """Lines of sections with the fields of the last Format: line before them in their section, in lower case."""
    own = lines.where(F.lower("section").isin(*sections)).withColumn("s", _trimmed(F.col("line"))).where("s <> '' AND NOT startswith(s, ';')")
    is_format = F.lower("s").startswith("format:")
    fields = F.when(is_format, F.transform(F.split(F.substring(F.col("s"), F.lit(8), F.length("s")), ","), lambda f: F.lower(_trimmed(f))))
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("fields", F.last(fields, ignorenulls=True).over(order)).where(~is_format & F.col("fields").isNotNull())


def styles(lines: DataFrame) -> DataFrame:
    """(doc, line_no, name, attributes map) of the style lines, by the format in force."""
    own = _formatted(lines, ("[v4+ styles]", "[v4 styles]")).where(F.lower("s").startswith("style:"))
    values = F.transform(F.split(F.substring(F.col("s"), F.lit(7), F.length("s")), ","), _trimmed)
    n = F.least(F.size("fields"), F.size(values))
    attributes = F.map_from_arrays(F.slice("fields", F.lit(1), n), F.slice(values, F.lit(1), n))
    return own.select("doc", "line_no", F.try_element_at(attributes, F.lit("name")).alias("name"), attributes.alias("attributes"))


def events(lines: DataFrame) -> DataFrame:
    """(doc, idx, start_ms, end_ms, text, style, layer, name, margin_l, margin_r, margin_v, effect, is_comment) of the event lines.

    Fields come in the order of the format in force; text takes what is left of the
    line, commas and all. Missing fields have their defaults, and numbers that are
    none are 0.
    """
    own = _formatted(lines, ("[events]",))
    low = F.lower("s")
    own = own.where(low.startswith("dialogue:") | low.startswith("comment:")).withColumn("is_comment", low.startswith("comment:"))
    body = F.when(F.col("is_comment"), F.substring(F.col("s"), F.lit(9), F.length("s"))).otherwise(F.substring(F.col("s"), F.lit(10), F.length("s")))
    own = own.select("*", F.split(body, ",").alias("parts"), F.array_position("fields", "text").cast("int").alias("text_at"))
    before = F.least(F.when(F.col("text_at") > 0, F.col("text_at") - 1).otherwise(F.size("fields")), F.size("parts"))
    values = F.map_from_arrays(F.slice("fields", F.lit(1), before), F.transform(F.slice("parts", F.lit(1), before), _trimmed))
    text = F.when(F.col("text_at") > 0, F.array_join(F.slice("parts", F.col("text_at"), F.size("parts")), ",")).otherwise("")
    own = own.select("doc", "line_no", "is_comment", values.alias("v"), text.alias("text"))

    def value(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at("v", F.lit(key)), F.lit(default))

    def number(key: str) -> Column:
        return F.coalesce(value(key, "0").try_cast("int"), F.lit(0))

    def time(key: str) -> Column:
        return F.coalesce(parse_centis(value(key, "0:00:00.00")), F.lit(0.0))

    idx = F.row_number().over(Window.partitionBy("doc").orderBy("line_no")) - 1
    name = F.coalesce(F.try_element_at("v", F.lit("name")), F.try_element_at("v", F.lit("actor")), F.lit(""))
    return own.select(
        "doc", idx.cast("int").alias("idx"), time("start").alias("start_ms"), time("end").alias("end_ms"), "text", value("style", "Default").alias("style"), number("layer").alias("layer"), name.alias("name"),
        number("marginl").alias("margin_l"), number("marginr").alias("margin_r"), number("marginv").alias("margin_v"), value("effect", "").alias("effect"), "is_comment",
    )


def _blocks(content: Column) -> Column:
    """Blocks of a text between blank lines, each trimmed."""
    return F.transform(F.split(_trimmed(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), r"\r\n", "\n")), r"\n\s*\n"), _trimmed)


def _ms(line: Column, pattern: str, first: int) -> Column:
    h, m, s, ms = (F.coalesce(F.regexp_extract(line, pattern, first + i).try_cast("long"), F.lit(0)) for i in range(4))
    return (h * 3_600_000 + m * 60_000 + s * 1000 + ms).cast("double")


def _timed(rows: DataFrame, at: Column, pattern: str, to_text, index: Column) -> DataFrame:
    """Events of blocks whose lines have their time at a place (from 0); others fall out."""
    timed = rows.withColumn("at", at).withColumn("t", _trimmed(F.get("lines", F.col("at")))).where(F.col("at").isNotNull() & F.col("t").rlike(pattern))
    rest = F.array_join(F.slice("lines", F.col("at") + 2, F.greatest(F.size("lines") - F.col("at") - 1, F.lit(0))), "\n")
    return timed.select("doc", "block_no", index.alias("srt_index"), _ms(F.col("t"), pattern, 1).alias("start_ms"), _ms(F.col("t"), pattern, 5).alias("end_ms"), to_text(rest).alias("text"))


def srt_events(documents: DataFrame) -> DataFrame:
    """(doc, block_no, srt_index, start_ms, end_ms, text) of SubRip documents(doc, content): blocks of a number, which may be missing, a time and lines of text, whose markup becomes overrides."""
    rows = documents.select("doc", F.posexplode(_blocks(F.col("content"))).alias("block_no", "block")).where("block <> ''").withColumn("lines", F.split("block", "\n")).where(F.size("lines") >= 2)
    first = _trimmed(F.get("lines", F.lit(0)))
    numbered = first.rlike("^[0-9]+$")
    return _timed(rows, F.when(numbered, 1).otherwise(0), _SRT_TIME, to_overrides, F.when(F.regexp_like(_trimmed(F.get("lines", F.lit(0))), F.lit("^[0-9]+$")), _trimmed(F.get("lines", F.lit(0))).try_cast("int")))


def vtt_events(documents: DataFrame) -> DataFrame:
    """The same of WebVTT documents: what precedes their heading is skipped, hours may be missing, and a cue's time is its first line that has one."""
    bare = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), r"\r\n", "\n")
    lines = F.split(bare, "\n")
    head = F.array_position(F.transform(lines, lambda x: F.upper(_trimmed(x)).startswith("WEBVTT")), True)
    body = F.array_join(F.slice(lines, head.cast("int") + 1, F.size(lines)), "\n")
    rows = documents.select("doc", F.posexplode(_blocks(body)).alias("block_no", "block")).where("block <> ''").withColumn("lines", F.split("block", "\n"))
    found = F.array_position(F.transform("lines", lambda x: _trimmed(x).rlike(_VTT_TIME)), True).cast("int")
    return _timed(rows, F.when(found > 0, found - 1), _VTT_TIME, cue_to_overrides, F.lit(None).cast("int"))


def to_srt(rows: DataFrame, rounding: str = "round", bom: Column | None = None) -> DataFrame:
    """(doc, content): events (doc, idx, srt_index, start_ms, end_ms, text, is_comment) as SubRip documents: comments left out, each with its own number or its place, overrides as markup."""
    own = rows.where(~F.col("is_comment")).withColumn("n", F.coalesce("srt_index", F.row_number().over(Window.partitionBy("doc").orderBy("idx"))))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(format_millis(F.col("start_ms"), rounding), F.lit(" --> "), format_millis(F.col("end_ms"), rounding)), from_overrides(F.col("text")), F.lit(""))
    joined = own.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]), "\n").alias("content"))
    return joined.withColumn("content", F.concat(F.when(bom if bom is not None else F.lit(False), "﻿").otherwise(""), F.col("content")))


EVENT_FORMAT = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")


def event_line(fields: tuple[str, ...] = EVENT_FORMAT, rounding: str = "floor") -> Column:
    """A Dialogue or Comment line with an event's fields in the format's order; times are rounded here alone."""
    known = {
        "layer": F.col("layer").cast("string"), "start": format_centis(F.col("start_ms"), rounding), "end": format_centis(F.col("end_ms"), rounding), "style": F.col("style"), "name": F.col("name"), "actor": F.col("name"),
        "marginl": F.col("margin_l").cast("string"), "marginr": F.col("margin_r").cast("string"), "marginv": F.col("margin_v").cast("string"), "effect": F.col("effect"), "text": F.col("text"),
    }
    values = [known.get(f.lower(), F.lit("")) for f in fields]
    return F.concat(F.when(F.col("is_comment"), "Comment: ").otherwise("Dialogue: "), F.concat_ws(",", *values))


def to_ass(rows: DataFrame, head: DataFrame | None = None, fields: tuple[str, ...] = EVENT_FORMAT, rounding: str = "floor") -> DataFrame:
    """(doc, content): events as ASS documents behind their other sections, head(doc, head), with line ends of two characters."""
    lines = rows.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", event_line(fields, rounding).alias("l")))), lambda x: x["l"]).alias("l"))
    if head is not None:
        lines = lines.join(head, "doc", "left")
    before = F.coalesce(F.col("head"), F.lit("")) if head is not None else F.lit("")
    body = F.concat(F.array(F.lit("[Events]"), F.lit("Format: " + ", ".join(fields))), F.col("l"), F.array(F.lit("")))
    return lines.select("doc", F.concat(F.when(before == "", "").otherwise(F.concat(before, F.lit("\r\n"))), F.array_join(body, "\r\n")).alias("content"))


def section_text(lines: DataFrame, skip: tuple[str, ...] = ("[events]",)) -> DataFrame:
    """(doc, head): all sections but some as they were, in their order, for to_ass()."""
    own = lines.where(F.col("section").isNull() | ~F.lower("section").isin(*skip))
    sections = own.groupBy("doc", "section_no", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\r\n").alias("body"))
    text = F.concat_ws("\r\n", "section", "body")
    return sections.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", text.alias("t")))), lambda x: x["t"]), "\r\n").alias("head"))


def to_json(rows: DataFrame) -> DataFrame:
    """(doc, content): a document's events as one JSON array, every column of them in it."""
    others = [c for c in rows.columns if c != "doc"]
    return rows.groupBy("doc").agg(F.to_json(F.sort_array(F.collect_list(F.struct("idx", *[c for c in others if c != "idx"])))).alias("content"))


def from_json(documents: DataFrame, schema: str) -> DataFrame:
    """The events of to_json() again; schema names their columns."""
    return documents.select("doc", F.explode(F.from_json("content", f"array<struct<{schema}>>")).alias("e")).select("doc", "e.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, content) of the text files under a path, one row for each, in UTF-8 or another encoding that detect_encoding() tells."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content", detect_encoding(F.col("content")).alias("e"))

    @F.pandas_udf("string")
    def decode(content: pd.Series, name: pd.Series) -> pd.Series:
        return content.combine(name, lambda data, encoding: bytes(data).decode({"utf-16-le": "utf-16", "utf-16-be": "utf-16"}.get(encoding, encoding), "replace"))

    return files.select("doc", decode("content", "e.name").alias("content"))
