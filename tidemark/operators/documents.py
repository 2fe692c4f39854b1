"""Queries of the text functions, and of subtitle and chapter documents written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators.events import format_millis
from tidemark.plans.fixtures import chapters, oracle, subs
from tidemark.plans.registry import query
from tidemark.session import ensure_checkpoint_dir, table
from tidemark.sources import chapters_xml, subtitles

#: Texts on one line without the characters that documents give a meaning.
_PLAIN = "trim(regexp_replace({text}, '[^A-Za-z0-9.,!? äöüßéèñçáíóú-]+', ' '{all}))"
_DOCS = f""", ev AS (SELECT track_id AS doc, idx, start_ms, end_ms, {_PLAIN.format(text="text", all=", 'g'")} AS text, style, layer, is_comment FROM subs),
nd AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n FROM ev WHERE NOT is_comment)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = subs(spark, sf).select(F.col("track_id").alias("doc"), "idx", "start_ms", "end_ms", F.expr(_PLAIN.format(text="text", all="")).alias("text"), "style", "layer", "is_comment")
    return rows.withColumns({"srt_index": F.lit(None).cast("int"), "name": F.lit(""), "margin_l": F.lit(0), "margin_r": F.lit(0), "margin_v": F.lit(0), "effect": F.lit("")})


_SRT = "printf('%02d:%02d:%02d,%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"
_ASS = "printf('%d:%02d:%02d.%02d', {t} // 360000, {t} // 6000 % 60, {t} // 100 % 60, {t} % 100)"
_S, _E = _SRT.format(t="round(start_ms)::BIGINT"), _SRT.format(t="round(end_ms)::BIGINT")


@query("srt_documents", oracle("subs", body=_DOCS + f" SELECT doc, md5(string_agg(n || chr(10) || {_S} || ' --> ' || {_E} || chr(10) || text || chr(10), chr(10) ORDER BY n)) AS content_md5 FROM nd GROUP BY 1"))
def q_srt(spark: SparkSession, sf: str) -> DataFrame:
    """K02, F26, F37."""
    return subtitles.to_srt(_events(spark, sf)).select("doc", F.md5("content").alias("content_md5"))


@query("srt_events", oracle("subs", body=_DOCS + " SELECT doc, n::INT AS srt_index, round(start_ms)::DOUBLE AS start_ms, round(end_ms)::DOUBLE AS end_ms, text FROM nd"))
def q_srt_events(spark: SparkSession, sf: str) -> DataFrame:
    """What was written, read back."""
    return subtitles.srt_events(subtitles.to_srt(_events(spark, sf))).select("doc", "srt_index", "start_ms", "end_ms", "text")


@query("vtt_events", oracle("subs", body=_DOCS + " SELECT doc, round(start_ms)::DOUBLE AS start_ms, round(end_ms)::DOUBLE AS end_ms, '{\\b1}' || text || '{\\b0}' AS text FROM nd"))
def q_vtt_events(spark: SparkSession, sf: str) -> DataFrame:
    """Cues with identifiers, and hours only where there are any."""
    own = _events(spark, sf).where(~F.col("is_comment"))

    def clock(column: str) -> Column:
        full = F.replace(format_millis(F.col(column)), F.lit(","), F.lit("."))
        return F.when(full.startswith("00:"), F.substring(full, 4, 99)).otherwise(full)

    block = F.concat_ws("\n", F.concat(F.lit("cue "), F.col("idx").cast("string")), F.concat(clock("start_ms"), F.lit(" --> "), clock("end_ms"), F.lit(" align:start")), F.concat(F.lit("<v Anna><c.loud><b>"), F.col("text"), F.lit("</b></c></v>")))
    whole = own.groupBy("doc").agg(F.concat(F.lit("WEBVTT - x\nkind: y\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]), "\n\n")).alias("content"))
    return subtitles.vtt_events(whole).select("doc", "start_ms", "end_ms", "text")


_HEAD = "[Script Info]\r\n; made for tests\r\nTitle: a, b: c\r\nPlayResX: 640\r\n\r\n[V4+ Styles]\r\nFormat: Name, Fontname, Fontsize\r\nStyle: Default,Arial,20\r\nStyle: user, Serif ,31.5\r\n\r\n[Odd Section]\r\nkept as it is\r\n"
_ASS_LINE = f"CASE WHEN is_comment THEN 'Comment: ' ELSE 'Dialogue: ' END || layer || ',' || {_ASS.format(t='floor(start_ms / 10)::BIGINT')} || ',' || {_ASS.format(t='floor(end_ms / 10)::BIGINT')} || ',' || style || ',,0,0,0,,' || text"
_HEAD_SQL = "'" + _HEAD.replace("\r\n", "' || chr(13) || chr(10) || '") + "'"
_ASS_BODY = f"{_HEAD_SQL} || chr(13) || chr(10) || '[Events]' || chr(13) || chr(10) || 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text' || chr(13) || chr(10) || string_agg({_ASS_LINE}, chr(13) || chr(10) ORDER BY idx) || chr(13) || chr(10)"


def _ass(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf)
    return subtitles.to_ass(rows, rows.select("doc").distinct().withColumn("head", F.lit(_HEAD)))


@query("ass_documents", oracle("subs", body=_DOCS + f" SELECT doc, md5({_ASS_BODY}) AS content_md5 FROM ev GROUP BY 1"))
def q_ass(spark: SparkSession, sf: str) -> DataFrame:
    """K01, F25."""
    return _ass(spark, sf).select("doc", F.md5("content").alias("content_md5"))


@query("ass_events", oracle("subs", body=_DOCS + " SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY idx) - 1)::INT AS idx, floor(start_ms / 10) * 10.0::DOUBLE AS start_ms, floor(end_ms / 10) * 10.0::DOUBLE AS end_ms, text, style, layer, is_comment FROM ev"))
def q_ass_events(spark: SparkSession, sf: str) -> DataFrame:
    """S10, S26."""
    return subtitles.events(subtitles.ass_lines(_ass(spark, sf))).select("doc", "idx", "start_ms", "end_ms", "text", "style", "layer", "is_comment")


@query("ass_styles", oracle("subs", body=""", d AS (SELECT DISTINCT track_id AS doc FROM subs) SELECT doc, unnest(['Default', 'user']) AS name, unnest(['Arial', 'Serif']) AS font, unnest(['20', '31.5']) AS size FROM d"""))
def q_ass_styles(spark: SparkSession, sf: str) -> DataFrame:
    read = subtitles.styles(subtitles.ass_lines(_ass(spark, sf)))
    return read.select("doc", "name", F.col("attributes")["fontname"].alias("font"), F.col("attributes")["fontsize"].alias("size"))


@query("ass_info", oracle("subs", body=""", d AS (SELECT DISTINCT track_id AS doc FROM subs) SELECT doc, unnest(['__comment__', 'Title', 'PlayResX']) AS key, unnest(['; made for tests', 'a, b: c', '640']) AS value FROM d"""))
def q_ass_info(spark: SparkSession, sf: str) -> DataFrame:
    return subtitles.script_info(subtitles.ass_lines(_ass(spark, sf))).select("doc", "key", "value")


@query("ass_rewritten", oracle("subs", body=_DOCS + f" SELECT doc, md5({_ASS_BODY}) AS content_md5 FROM ev GROUP BY 1"))
def q_ass_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Read and written again, a document is what it was, unknown sections too."""
    lines = subtitles.ass_lines(_ass(spark, sf))
    return subtitles.to_ass(subtitles.events(lines), subtitles.section_text(lines)).select("doc", F.md5("content").alias("content_md5"))


@query("json_events", oracle("subs", body=_DOCS + " SELECT doc, idx, round(start_ms, 6) + 0.0 AS start_ms, text, is_comment FROM ev"))
def q_json(spark: SparkSession, sf: str) -> DataFrame:
    """Through JSON and back."""
    read = subtitles.from_json(subtitles.to_json(_events(spark, sf)), "idx long, start_ms double, text string, is_comment boolean")
    return read.select("doc", "idx", (F.round("start_ms", 6) + F.lit(0.0)).alias("start_ms"), "text", "is_comment")


@query("encodings", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'utf-16-be' END AS name, doc_id % 4 <> 0 AS has_bom FROM documents")
def q_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in encodings that a mark or their bytes tell; the tests have the others."""
    docs, text = table(spark, sf, "documents"), F.coalesce("text", F.lit(""))
    kinds = [F.encode(text, "UTF-8"), F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode(text, "UTF-8")), F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(text, "UTF-16LE")), F.concat(F.lit(bytearray(b"\xfe\xff")), F.encode(text, "UTF-16BE"))]
    content = F.when(F.col("doc_id") % 4 == 0, kinds[0]).when(F.col("doc_id") % 4 == 1, kinds[1]).when(F.col("doc_id") % 4 == 2, kinds[2]).otherwise(kinds[3])
    return docs.select("doc_id", subtitles.detect_encoding(content).alias("e")).select("doc_id", "e.name", "e.has_bom")


_CH = """, f AS (SELECT track AS doc, id, greatest(start_ns, 0) AS start_ns, CASE WHEN id % 3 > 0 THEN greatest(start_ns, 0) + 1500000000 END AS end_ns, 'Part <' || id || '> & "x"' AS name, CASE id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'jpn' ELSE 'xyz' END AS lang, CASE id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE 'und' END AS tag FROM chapters)"""


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("id") % 3 == 0, "eng").when(F.col("id") % 3 == 1, "jpn").otherwise("xyz")
    start = F.greatest("start_ns", F.lit(0))
    name = F.concat(F.lit("Part <"), F.col("id").cast("string"), F.lit('> & "x"'))
    display = F.array(F.struct(name.alias("name"), lang.alias("lang"), texts.chapter_tag(lang).alias("tag")))
    return chapters(spark, sf).select(F.col("track").alias("doc"), start.alias("start_ns"), F.when(F.col("id") % 3 > 0, start + 1_500_000_000).alias("end_ns"), display.alias("displays"))


@query("chapter_documents", oracle("chapters", body=_CH + """, t AS (SELECT *, printf('%02d:%02d:%02d.%09d', start_ns // 3600000000000, start_ns // 60000000000 % 60, start_ns // 1000000000 % 60, start_ns % 1000000000) AS s, printf('%02d:%02d:%02d.%09d', end_ns // 3600000000000, end_ns // 60000000000 % 60, end_ns // 1000000000 % 60, end_ns % 1000000000) AS e FROM f),
a AS (SELECT *, '    <ChapterAtom>' || chr(10) || '      <ChapterTimeStart>' || s || '</ChapterTimeStart>' || chr(10) || coalesce('      <ChapterTimeEnd>' || CASE WHEN end_ns IS NOT NULL THEN e END || '</ChapterTimeEnd>' || chr(10), '') || '      <ChapterDisplay>' || chr(10) || '        <ChapterString>Part &lt;' || id || '&gt; &amp; &quot;x&quot;</ChapterString>' || chr(10)
  || '        <ChapterLanguage>' || lang || '</ChapterLanguage>' || chr(10) || '        <ChapLanguageIETF>' || tag || '</ChapLanguageIETF>' || chr(10) || '      </ChapterDisplay>' || chr(10) || '    </ChapterAtom>' || chr(10) AS atom FROM t)
SELECT doc, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Chapters>' || chr(10) || '  <EditionEntry>' || chr(10) || string_agg(atom, '' ORDER BY start_ns, atom) || '  </EditionEntry>' || chr(10) || '</Chapters>') AS content_md5 FROM a GROUP BY 1"""))
def q_chapter_documents(spark: SparkSession, sf: str) -> DataFrame:
    """K05, F22, F23."""
    return chapters_xml.write_chapters(_chapters(spark, sf)).select("doc", F.md5("content").alias("content_md5"))


@query("chapter_atoms", oracle("chapters", body=_CH + " SELECT doc, start_ns, end_ns, name, lang, tag FROM f"))
def q_chapter_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """What was written, read back."""
    read = chapters_xml.read_chapters(chapters_xml.write_chapters(_chapters(spark, sf)))
    return read.select("doc", "start_ns", "end_ns", F.explode("displays").alias("d")).select("doc", "start_ns", "end_ns", "d.name", "d.lang", "d.tag")


_CODES = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in texts.LANGUAGES.items())
_TAGS = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in texts.CHAPTER_TAGS.items())


@query("language_codes", f"""WITH c(a, b) AS ({_CODES}), g(a, b) AS ({_TAGS}), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT ' ' || b || ' ' FROM c UNION SELECT ''),
n AS (SELECT word, CASE WHEN lower(trim(word)) NOT IN ('', 'und') THEN coalesce(c.b, lower(trim(word))) END AS code FROM w LEFT JOIN c ON c.a = lower(trim(word)) WHERE length(word) <= 5) SELECT word, code, coalesce(g.b, 'und') AS tag FROM n LEFT JOIN g ON g.a = code""")
def q_languages(spark: SparkSession, sf: str) -> DataFrame:
    """the short words and the languages of documents, and the known codes, as names of languages."""
    docs = table(spark, sf, "documents")
    known = spark.createDataFrame([(f" {c} ",) for c in texts.LANGUAGES.values()] + [("",)], "word string")
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).unionByName(docs.select(F.col("lang").alias("word"))).unionByName(known).where(F.length("word") <= 5).distinct()
    code = texts.normal_language(F.col("word"))
    return found.select("word", code.alias("code"), texts.chapter_tag(F.coalesce(code, F.lit("und"))).alias("tag"))


@query("markup", r"""WITH p AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(html, '[{}\\]', '', 'g'), '</?[biu]>', '', 'gi'), '<[^>]+>', '', 'g'), chr(10), '\N') AS r FROM pages)
SELECT page_id, md5('{\b1}a{\b0} {\i1}b{\i0}{x}{\u1}c{\u0}{\c&Hc3B2a1&}d{\c}e{\c}\N' || r) AS overrides_md5, md5('<b>a</b> <i>b</i><u>c</u>de' || chr(10) || replace(r, '\N', chr(10))) AS back_md5 FROM p""")
def q_markup(spark: SparkSession, sf: str) -> DataFrame:
    """pages, behind a line of every kind of markup, as overrides and back; the pages' own b, i and u elements are taken out first."""
    plain = F.regexp_replace(F.regexp_replace(F.col("html"), r"[{}\\]", ""), "(?i)</?[biu]>", "")
    text = F.concat(F.lit('<B>a</b> <i>b</I>{x}<u>c</u><font color="#a1B2c3">d</font><font color=red>e</font>\n'), plain)
    made = table(spark, sf, "pages").select("page_id", texts.to_overrides(text).alias("o"))
    return made.select("page_id", F.md5("o").alias("overrides_md5"), F.md5(texts.from_overrides(F.col("o"))).alias("back_md5"))


@query("colours", """WITH c AS (SELECT l_orderkey AS job, l_linenumber AS id, l_partkey, l_suppkey, printf('%08X', (l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296) AS x FROM lineitem),
d AS (SELECT job, id, '&H' || x AS colour, '#' || printf('%02X', 255 - ('0x' || x[1:2])::INT) || x[7:8] || x[5:6] || x[3:4] AS hex FROM c) SELECT job, id, colour, hex, colour AS back FROM d""")
def q_colours(spark: SparkSession, sf: str) -> DataFrame:
    """There and back."""
    x = F.format_string("%08X", F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 40503, F.lit(4294967296)))
    made = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("id"), F.concat(F.lit("&H"), x).alias("colour")).withColumn("hex", texts.colour_to_hex(F.col("colour")))
    return made.withColumn("back", texts.hex_to_colour(F.col("hex")))


@query("natural_order", """WITH p AS (SELECT p_partkey, p_name || ' Ep' || p_size || 'v' || p_partkey % 12 AS name FROM part), k AS (SELECT *, list_transform(regexp_extract_all(name, '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN lpad(x, 20, '0') ELSE lower(x) END) AS key FROM p)
SELECT p_partkey, array_to_string(key, '|') AS key, row_number() OVER (ORDER BY key, p_partkey) AS place FROM k""")
def q_natural(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in natural order; places by a sorted numbering over ranges of keys."""
    name = F.concat("p_name", F.lit(" Ep"), F.col("p_size").cast("string"), F.lit("v"), (F.col("p_partkey") % 12).cast("string"))
    keyed = table(spark, sf, "part").select("p_partkey", texts.natural_key(name).alias("key"))
    return numbered_by(keyed, "key", "p_partkey").select("p_partkey", F.array_join("key", "|").alias("key"), "place")


def numbered_by(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place in an order, from 1: sorted ranges are numbered on their own, and the ranges' counts added up."""
    ensure_checkpoint_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).checkpoint()  # read twice, so the ranges' numbers must be kept
    own = placed.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    return own.join(counts.select("__part", before.alias("__before")), "__part").withColumn("place", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


_NAMES = """n AS (SELECT page_id, 'url' AS kind, url AS name FROM pages UNION ALL SELECT page_id, 'title', regexp_extract(html, '<title>(.*?)</title>', 1) FROM pages UNION ALL SELECT page_id, 'fragment', regexp_extract(url, '#(.*)$', 1) FROM pages UNION ALL SELECT page_id, 'both', url || ' ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) || ' .' FROM pages)"""


@query("file_names", rf"""WITH {_NAMES}, f AS (SELECT *, trim(regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g'), '_{{2,}}', '_', 'g'), '_. ') AS bare FROM n)
SELECT page_id, kind, CASE WHEN bare = '' THEN 'unnamed' ELSE substr(bare, 1, 100) END AS file_name, CASE WHEN name = '' THEN chr(39) || chr(39) WHEN regexp_matches(name, '[\s"''\\$`!#&|;(){{}}\[\]<>?*~]') THEN chr(39) || replace(name, chr(39), chr(39) || '\' || chr(39) || chr(39)) || chr(39) ELSE name END AS quoted FROM f""")
def q_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """addresses, titles and fragments of pages as names of files and words of a shell."""
    title, fragment = F.regexp_extract("html", "<title>(.*?)</title>", 1), F.regexp_extract("url", "#(.*)$", 1)
    named = {"url": F.col("url"), "title": title, "fragment": fragment, "both": F.concat("url", F.lit(" "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit(" ."))}
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in named.items()])).alias("n")).select("page_id", "n.*")
    return rows.select("page_id", "kind", texts.file_name(F.col("name")).alias("file_name"), texts.shell_quoted(F.col("name")).alias("quoted"))


@query("small_formats", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN value = floor(value) THEN floor(value)::BIGINT::VARCHAR ELSE value::VARCHAR END AS number, floor(value)::BIGINT::VARCHAR AS whole, CASE user_id % 3 WHEN 0 THEN CASE WHEN k = 0 THEN 0 ELSE round(user_id / k, 9) END WHEN 1 THEN k ELSE 0 END::DOUBLE AS rate, CASE WHEN user_id % 2 = 0 THEN k END AS percent,
  CASE WHEN user_id % 2 = 0 THEN length(value::VARCHAR) - position('.' IN value::VARCHAR) ELSE 2 END::INT AS digits, round(CASE WHEN k = 0 THEN 100.0 ELSE (k * 10 + user_id / 2.0) / 1080.0 * 100 END::DOUBLE, 6) AS y_percent,
  CASE WHEN k = 0 OR k * 20 + user_id >= 1620 THEN 'bottom' WHEN k * 20 + user_id <= 864 THEN 'top' ELSE 'middle' END AS region FROM e""")
def q_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, rates, progress lines, clocks and boxes made of what events say."""
    k, user, number = F.get_json_object("props", "$.k").cast("int"), F.col("user_id"), F.col("value").cast("string")
    rate = F.when(user % 3 == 0, F.concat(user.cast("string"), F.lit("/"), k.cast("string"))).when(user % 3 == 1, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.col("event_type"))
    line = F.when(user % 2 == 0, F.concat("event_type", F.lit(": "), k.cast("string"), F.lit("% "))).otherwise(F.col("props"))
    stamp = F.concat(F.lit("0:00:"), F.when(user % 2 == 0, number).otherwise(user.cast("string")))
    y = texts.position_percent(k * 10, user, F.when(k == 0, 0).otherwise(1080))
    return table(spark, sf, "events").select(
        "event_id", texts.format_number(F.col("value")).alias("number"), texts.format_number(F.floor("value").cast("double")).alias("whole"), F.round(texts.fraction(rate, 0.0), 9).alias("rate"),
        texts.progress_percent(line).alias("percent"), texts.timestamp_digits(stamp).alias("digits"), F.round(y, 6).alias("y_percent"), texts.screen_region(y).alias("region"),
    )


#: What attachments are made of: a word of a page, in types and endings that some fonts have.
_MIMES = ("'font/' || w", "'application/' || w", "w || '/x-TrueType'", "'application/x-font-' || w", "'application/octet-stream'", "'Binary/Octet-Stream'", "'text/' || w", "'application/postscript'", "'image/' || w || 'opentype'", "'application/vnd.ms-opentype'")
_ENDS = ("'.TTF'", "'.otf'", "'.woff2'", "'.bin'", "'.eot'", "'.pfb'", "'.' || w", "'ttf'", "'.ttf2'", "''", "'.fon.txt'")
_PICK = "CASE {n} " + "{whens} END"


def _picked(key: str, choices: tuple[str, ...]) -> str:
    return _PICK.format(n=f"{key} % {len(choices)}", whens=" ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)))


@query("font_attachments", f"""WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[A-Za-z0-9]+')) AS w FROM pages), a AS (SELECT {_picked("length(w)", _MIMES)} AS mime, w || {_picked("ascii(w)", _ENDS)} AS name FROM p),
f AS (SELECT *, lower(mime) AS kind, CASE WHEN contains(name, '.') THEN string_split(lower(name), '.')[-1] ELSE '' END AS ending FROM a)
SELECT mime, name, kind LIKE '%font%' OR kind LIKE '%truetype%' OR kind LIKE '%opentype%' OR kind = 'application/postscript' OR ending IN ('ttf', 'otf', 'ttc', 'woff', 'woff2', 'eot', 'fon', 'fnt', 'pfb', 'pfa') AS is_font FROM f""")
def q_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments named and typed by the words of pages."""
    words = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("([A-Za-z0-9]+)"), 1)).alias("w")).distinct()
    made = words.select(F.expr(_picked("length(w)", _MIMES)).alias("mime"), F.concat("w", F.expr(_picked("ascii(w)", _ENDS))).alias("name"))
    return made.select("mime", "name", texts.is_font(F.col("mime"), F.col("name")).alias("is_font"))


_NUMBER = "CASE WHEN {v} = floor({v}) THEN floor({v})::BIGINT::VARCHAR ELSE ({v})::DECIMAL(18, 1)::VARCHAR END"


@query("scaled_tags", oracle("subs", body=rf""", w AS (SELECT track_id, idx, unnest(string_split(translate(text, '{{}}\', ''), ' ')) AS w, unnest(range(1, len(string_split(translate(text, '{{}}\', ''), ' ')) + 1)) AS i FROM subs)
SELECT track_id, idx, md5(string_agg('{{\fs' || {_NUMBER.format(v="length(w) * 2.5")} || '\pos(' || {_NUMBER.format(v="(i * 1.5 + 3)")} || ',' || {_NUMBER.format(v="(i * length(w) * 1.5 + 4)")} || ')\bord' || {_NUMBER.format(v="(length(w) % 3 * 2.5)")} || '\t(0,' || i || ',\fscx50\fs' || {_NUMBER.format(v="i * 2.5")} || '\t(\blur' || {_NUMBER.format(v="length(w) * 2.5")} || '))\c&H' || i || '&}}' || w, ' ' ORDER BY i)) AS text_md5 FROM w GROUP BY 1, 2"""))
def q_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """P20: every word of the texts behind tags with its length and place as numbers, transforms inside transforms among them."""
    words = F.split(F.translate("text", "{}\\", ""), " ")

    def tagged(w: Column, i: Column) -> Column:
        n, at = F.length(w).cast("string"), (i + 1).cast("string")
        return F.concat(F.lit("{\\fs"), n, F.lit("\\pos("), at, F.lit(","), ((i + 1) * F.length(w)).cast("string"), F.lit(")\\bord"), (F.length(w) % 3).cast("string"), F.lit("\\t(0,"), at, F.lit(",\\fscx50\\fs"), at, F.lit("\\t(\\blur"), n, F.lit("))\\c&H"), at, F.lit("&}"), w)

    text = F.array_join(F.transform(words, tagged), " ")
    return subs(spark, sf).select("track_id", "idx", F.md5(texts.scaled_tags(text, 1.5, 2.5, (3.0, 4.0))).alias("text_md5"))
