"""Queries of the word functions over texts and a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.operators.documents import numbered_by
from tidemark.plans.registry import query
from tidemark.session import table

_WORDS = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark"


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct words of benchmark, in lower case."""
    return table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).select(F.lower("word").alias("word")).distinct()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents: (line_id, line, confidence)."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("at").cast("string")).alias("line_id"), "line", ((F.col("doc_id") * 7 + F.col("at")) % 101).cast("double").alias("confidence"))


_LINES = "SELECT doc_id || ':' || (i - 1) AS line_id, l[i] AS line, ((doc_id * 7 + i - 1) % 101)::DOUBLE AS confidence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
RULES = [("regex", "(e)n", "$1m"), ("literal", "an", "AN"), ("word", "de", "DE"), ("word_start", "th", "TH"), ("word_end", "er", "ER")]


@query("replacement_rules", f"""WITH l AS (SELECT line_id, regexp_replace(line, '[^\\x00-\\x7F]', 'z', 'g') AS line FROM ({_LINES})), a AS (SELECT *, replace(line, 'an', 'AN') AS a FROM l), b AS (SELECT *, regexp_replace(a, '\\bde\\b', 'DE', 'g') AS b FROM a), c AS (SELECT *, regexp_replace(b, '\\bth', 'TH', 'g') AS c FROM b), d AS (SELECT *, regexp_replace(c, 'er\\b', 'ER', 'g') AS d FROM c),
e AS (SELECT *, regexp_replace(d, '(e)n', '\\1m', 'g') AS e FROM d) SELECT line_id, md5(e) AS text_md5, (length(line) - length(replace(line, 'an', ''))) // 2 AS n_literal, len(regexp_extract_all(a, '\\bde\\b'))::BIGINT AS n_word, len(regexp_extract_all(d, '(e)n'))::BIGINT AS n_regex FROM e""")
def q_rules(spark: SparkSession, sf: str) -> DataFrame:
    """F44. What is a border beside letters beyond ASCII differs between engines, so these are made z first."""
    made = words.replaced(_lines(spark, sf).withColumn("line", F.regexp_replace("line", r"[^\x00-\x7F]", "z")), "line", RULES)

    def n(key: str) -> Column:
        return F.coalesce(F.try_element_at("fixes", F.lit(key)), F.lit(0)).cast("long")

    return made.select("line_id", F.md5("line").alias("text_md5"), n("an>AN").alias("n_literal"), n("word:de").alias("n_word"), n("regex:(e)n").alias("n_regex"))


@query("confidence_rules", f"WITH l AS ({_LINES}) SELECT line_id, md5(CASE WHEN confidence < 60 THEN replace(line, 'e', '3') ELSE line END) AS text_md5 FROM l")
def q_gated(spark: SparkSession, sf: str) -> DataFrame:
    """rules for texts of little confidence."""
    return words.confidence_replaced(_lines(spark, sf), "line", F.col("confidence"), [("literal", "e", "3")]).select("line_id", F.md5("line").alias("text_md5"))


@query("line_fixes", f"""WITH l AS ({_LINES}), a AS (SELECT line_id, CASE WHEN trim(line) = '' THEN '(none)' ELSE line END AS x FROM l), b AS (SELECT line_id, CASE WHEN starts_with(x, 'A') THEN '@' || substr(x, 2) ELSE x END AS x FROM a), c AS (SELECT line_id, CASE WHEN ends_with(x, '.') THEN substr(x, 1, length(x) - 1) || '!' ELSE x END AS x FROM b),
d AS (SELECT line_id, replace(replace(x, 'nd', 'n d'), 'n d', 'N') AS x FROM c) SELECT line_id, md5(regexp_replace(x, '[0-9]+', '#', 'g')) AS text_md5 FROM d""")
def q_line_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """F45, the line stages: each on what the one before left."""
    made = words.fixed_lines(_lines(spark, sf), "line", {"": "(none)"}, {"A": "@"}, {".": "!"}, {"nd": "n d", "n d": "N"}, {"[0-9]+": "#"})
    return made.select("line_id", F.md5("line").alias("text_md5"))


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_GARBAGE = r"""(strlen(t) >= 3 AND ((confidence < 40 AND len(w) >= 3 AND len(list_filter(w, lambda x: strlen(x) <= 2)) / len(w) > 0.6)
  OR (regexp_matches(t, '(\b[A-Z]{1,2}\b\s*){3,}') AND len(cw) >= 3 AND len(cw) / len(w) > 0.5)
  OR (len(regexp_extract_all(t, '\p{L}')) > 0 AND len(regexp_extract_all(t, '\p{Lu}')) / greatest(len(regexp_extract_all(t, '\p{L}')), 1) > 0.8 AND len(regexp_extract_all(t, ' ')) / greatest(strlen(t), 1) > 0.3)))"""


@query("garbage_lines", f"""WITH l AS ({_LINES}), m AS (SELECT line_id, confidence, CASE confidence::INT % 9 WHEN 0 THEN 'AB C DE F ' || line WHEN 1 THEN ' A  B  C  D  E ' WHEN 2 THEN 'it is so I am' ELSE line END AS line FROM l), t AS (SELECT *, {_STRIP.format(x='line')} AS t FROM m),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM t), c AS (SELECT *, list_filter(w, lambda x: strlen(x) <= 2 AND regexp_matches(x, '^\\p{{Lu}}+$')) AS cw FROM w)
SELECT line_id, {_GARBAGE} AS garbage FROM c""")
def q_garbage(spark: SparkSession, sf: str) -> DataFrame:
    """W14."""
    k = F.col("confidence").cast("int") % 9
    line = F.when(k == 0, F.concat(F.lit("AB C DE F "), "line")).when(k == 1, " A  B  C  D  E ").when(k == 2, "it is so I am").otherwise(F.col("line"))
    return _lines(spark, sf).withColumn("line", line).select("line_id", words.is_garbage(F.col("line"), F.col("confidence")).alias("garbage"))


_SPOILT = "CASE (doc_id * 7 + {at}) % 9 WHEN 0 THEN 'AB C DE F ' || {line} WHEN 1 THEN ' A  B  C  D  E ' WHEN 2 THEN 'AB C DE F ' || upper({line}) ELSE {line} END"


@query("garbage_removed", rf"""WITH l AS (SELECT doc_id, len(l) AS n, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'z', 'g'), chr(10)) AS l FROM documents)), s AS (SELECT doc_id, n, i, {_SPOILT.format(at="i", line="line")} AS x FROM l),
b AS (SELECT doc_id, n, i, 0 AS part, x FROM s UNION ALL SELECT doc_id, n, i, 1, {_STRIP.format(x=r"regexp_replace(x, '^(\b[A-Z]{1,2}\b\s*){3,}', '')")} FROM s WHERE regexp_matches(x, '^(\b[A-Z]{{1,2}}\b\s*){{3,}}')),
t AS (SELECT *, 100 AS confidence, {_STRIP.format(x="x")} AS t FROM b), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM t), c AS (SELECT *, list_filter(w, lambda x: strlen(x) <= 2 AND regexp_matches(x, '^\p{{Lu}}+$')) AS cw FROM w),
g AS (SELECT doc_id, n, i, part, x, {_GARBAGE} AS bad FROM c),
k AS (SELECT a.doc_id, a.n, a.i, a.bad, CASE WHEN a.n > 1 AND r.x <> '' AND NOT r.bad THEN r.x ELSE a.x END AS x FROM g a LEFT JOIN g r ON r.doc_id = a.doc_id AND r.i = a.i AND r.part = 1 WHERE a.part = 0)
SELECT doc_id, md5(coalesce(string_agg(x, '\N' ORDER BY i) FILTER (NOT bad AND (n = 1 OR trim(x) <> '')), '')) AS text_md5 FROM k GROUP BY 1""")
def q_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents without their garbage lines and leading runs, some lines spoilt first. Letters beyond ASCII, beside which borders differ between engines, are made z before."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "z"), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    spoilt = F.transform(lines, lambda s: _spoilt(s["line"], s["i"]))
    return table(spark, sf, "documents").select("doc_id", F.md5(words.cleaned(F.array_join(spoilt, "\\N"))).alias("text_md5"))


def _spoilt(line: Column, at: Column) -> Column:
    k = (F.col("doc_id") * 7 + at) % 9
    return F.when(k == 0, F.concat(F.lit("AB C DE F "), line)).when(k == 1, " A  B  C  D  E ").when(k == 2, F.concat(F.lit("AB C DE F "), F.upper(line))).otherwise(line)


_TOKENS = "SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM conversations"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word"))


@query("known_words", f"""WITH d AS ({_WORDS}), li AS (SELECT 0 AS ord, 'names' AS list_name, word, true AS protects FROM d WHERE length(word) % 3 = 0 UNION ALL SELECT 1, 'common', word, false FROM d WHERE length(word) % 2 = 0),
o AS (SELECT word, arg_min(list_name, ord) AS list_name, bool_or(protects) AS protects FROM li GROUP BY 1), t AS ({_TOKENS}), c AS (SELECT DISTINCT word FROM t UNION SELECT DISTINCT word || '-' || lead FROM (SELECT word, lead(word) OVER (PARTITION BY conv_id ORDER BY turn, word) AS lead FROM t) WHERE lead IS NOT NULL),
p AS (SELECT c.word, own.list_name AS own, own.protects AS op, l.list_name AS a, l.protects AS ap, r.list_name AS b, r.protects AS bp FROM c LEFT JOIN o own ON own.word = lower(c.word) LEFT JOIN o l ON contains(c.word, '-') AND l.word = lower(string_split(c.word, '-')[1]) LEFT JOIN o r ON contains(c.word, '-') AND r.word = lower(string_split(c.word, '-')[2]))
SELECT word, coalesce(own, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'Compound' END) AS known_by, CASE WHEN own IS NOT NULL THEN op WHEN a IS NOT NULL AND b IS NOT NULL THEN ap OR bp ELSE false END AS protected FROM p""")
def q_known(spark: SparkSession, sf: str) -> DataFrame:
    """Words of conversations, and compounds of neighbours, by two lists."""
    own, found = _dictionary(spark, sf), _tokens(spark, sf)
    lists = own.where("length(word) % 3 = 0").select(F.lit(0).alias("ord"), F.lit("names").alias("list_name"), "word", F.lit(True).alias("protects"))
    lists = lists.unionByName(own.where("length(word) % 2 = 0").select(F.lit(1).alias("ord"), F.lit("common").alias("list_name"), "word", F.lit(False).alias("protects")))
    lead = F.lead("word").over(Window.partitionBy("conv_id").orderBy("turn", "word"))
    pairs = found.select("word", lead.alias("next")).where("next is not null").select(F.concat_ws("-", "word", "next").alias("word"))
    return words.known_words(found.select("word").unionByName(pairs), lists)


@query("merged_words", f"""WITH d AS ({_WORDS}), t AS (SELECT DISTINCT w || n AS word FROM (SELECT word AS w, lead(word) OVER (ORDER BY word) AS n FROM d) WHERE n IS NOT NULL UNION SELECT DISTINCT word FROM ({_TOKENS})),
c AS (SELECT word, unnest(range(1, length(word))) AS at_ FROM t WHERE length(word) >= 3 AND lower(word) NOT IN (SELECT word FROM d)), f AS (SELECT word, min(at_) AS at_ FROM c WHERE lower(substr(word, 1, at_)) IN (SELECT word FROM d) AND lower(substr(word, at_ + 1)) IN (SELECT word FROM d) GROUP BY 1)
SELECT word, substr(word, 1, at_) || ' ' || substr(word, at_ + 1) AS split FROM f""")
def q_merged(spark: SparkSession, sf: str) -> DataFrame:
    """neighbours of the dictionary run together, and words of conversations."""
    own = _dictionary(spark, sf)
    placed = numbered_by(own, "word")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("word").alias("n"))
    joined = placed.join(after, "place").select(F.concat("word", "n").alias("word"))
    return words.split_merged(joined.unionByName(_tokens(spark, sf).select("word")), own)


_FIX_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS word FROM conversations)"


@query("word_fixes", f"""WITH d AS ({_WORDS}), v AS (SELECT word FROM d UNION SELECT 'whole' UNION SELECT 'a' || word FROM d), p AS (SELECT word FROM d WHERE length(word) = 4), w AS ({_FIX_WORDS}),
s AS (SELECT word, regexp_extract(word, '^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 1) AS pre, regexp_extract(word, '^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 2) AS body, regexp_extract(word, '^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 3) AS post FROM w),
c AS (SELECT word, 0 AS ord, 'whole_word' AS rule, 'whole' AS core, 'whole' AS fixed FROM s WHERE word = 'en' UNION ALL SELECT word, 1, 'whole_word', 'whole', pre || 'whole' || post FROM s WHERE body = 'en' AND lower(body) NOT IN (SELECT word FROM p)
  UNION ALL SELECT word, 2, 'partial_word: th -> ath', replace(body, 'th', 'ath'), pre || replace(body, 'th', 'ath') || post FROM s WHERE body <> '' AND contains(body, 'th') AND lower(body) NOT IN (SELECT word FROM p)
  UNION ALL SELECT word, 3, 'partial_word: e -> ', replace(body, 'e', ''), pre || replace(body, 'e', '') || post FROM s WHERE body <> '' AND contains(body, 'e') AND lower(body) NOT IN (SELECT word FROM p)),
b AS (SELECT word, arg_min(fixed, ord) AS fixed, arg_min(rule, ord) AS rule FROM c WHERE lower(core) IN (SELECT word FROM v) GROUP BY 1) SELECT s.word, coalesce(fixed, s.word) AS fixed, rule FROM s LEFT JOIN b USING (word)""")
def q_word_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """words of conversations; some are valid, some protected."""
    own = _dictionary(spark, sf)
    valid = own.unionByName(spark.createDataFrame([("whole",)], "word string")).unionByName(own.select(F.concat(F.lit("a"), "word").alias("word"))).distinct()
    found = words.tokens(table(spark, sf, "conversations"), "conv_id", "text").where(r"word rlike '^\\S'").select("word")
    return words.fix_words(found, {"en": "whole"}, {"th": "ath", "e": ""}, own.where("length(word) = 4"), valid)


@query("reading_report", f"""WITH l AS ({_LINES}), f AS (SELECT *, (length(line) - length(replace(line, 'an', ''))) // 2 AS k FROM l), t AS ({_TOKENS}), d AS ({_WORDS}),
u AS (SELECT word AS key, count(*) AS n FROM t WHERE lower(word) NOT IN (SELECT word FROM d) GROUP BY 1 ORDER BY n DESC, key LIMIT 20)
SELECT 'total' AS kind, unnest(['lines', 'fixed lines', 'low lines', 'least', 'most', 'mean']) AS key, unnest([count(*), count(*) FILTER (k > 0), count(*) FILTER (confidence > 0 AND confidence < 60), round(min(confidence) FILTER (confidence > 0) * 100)::BIGINT, round(max(confidence) FILTER (confidence > 0) * 100)::BIGINT, round(avg(confidence) FILTER (confidence > 0) * 100)::BIGINT]) AS n FROM f
UNION ALL SELECT 'fix', 'an>AN', sum(k)::BIGINT FROM f UNION ALL SELECT 'unknown', key, n FROM u""")
def q_report(spark: SparkSession, sf: str) -> DataFrame:
    """A28, T09."""
    lines = words.replaced(_lines(spark, sf), "line", [("literal", "an", "AN")])
    own = _dictionary(spark, sf)
    unknown = _tokens(spark, sf).join(own.select(F.col("word").alias("__v")), F.lower("word") == F.col("__v"), "left_anti")
    return words.reading_report(lines, unknown)


@query("word_lists", f"WITH d AS ({_WORDS}) SELECT length(word)::INT AS list_no, count(*) AS n, min(word) AS first, max(word) AS last FROM d GROUP BY 1")
def q_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of word lists, here words by length."""
    return _dictionary(spark, sf).groupBy(F.length("word").alias("list_no")).agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("first"), F.max("word").alias("last"))


#: Kana for the letters of the tables' words, as the tables have no kana of their own; and how the oracle spells them.
_LETTERS, _KANA = "abcdefghijklmnopqrstuvwxyz", "アカサタナハマヤラワガザダバパキシチニヒャュョッーン"
_SPELLED = {
    "ア": "a", "カ": "ka", "サ": "sa", "タ": "ta", "ナ": "na", "ハ": "ha", "マ": "ma", "ヤ": "ya", "ラ": "ra", "ワ": "wa", "ガ": "ga", "ザ": "za", "ダ": "da", "バ": "ba", "パ": "pa", "キ": "ki", "シ": "shi", "チ": "chi", "ニ": "ni", "ヒ": "hi",
    "ャ": "ya", "ュ": "yu", "ョ": "yo", "ン": "n", "キャ": "kya", "キュ": "kyu", "キョ": "kyo", "シャ": "sha", "シュ": "shu", "ショ": "sho", "チャ": "cha", "チュ": "chu", "チョ": "cho", "ニャ": "nya", "ニュ": "nyu", "ニョ": "nyo", "ヒャ": "hya", "ヒュ": "hyu", "ヒョ": "hyo",
}
_LATIN = f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents), m AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in _SPELLED.items())}}} AS m),
s AS (SELECT word, regexp_extract_all(translate(word, '{_LETTERS}', '{_KANA}'), '[キシチニヒ][ャュョ]|.') AS s FROM w),
p AS (SELECT word, list_transform(range(1, len(s) + 1), lambda i: CASE s[i] WHEN 'ッ' THEN 'T' || coalesce(left(m[s[i + 1]], 1), '') WHEN 'ー' THEN 'L' ELSE 'T' || m[s[i]] END) AS p FROM s, m),
l AS (SELECT word, list_reduce(list_prepend('', p), lambda a, x: a || CASE WHEN x = 'L' THEN CASE WHEN right(a, 1) IN ('a', 'e', 'i', 'o', 'u') THEN right(a, 1) ELSE '' END ELSE substr(x, 2) END) AS latin FROM p)"""


def _in_kana(word: Column) -> Column:
    return F.translate(F.lower(word), _LETTERS, _KANA)


@query("romanised", _LATIN + " SELECT word, latin FROM l")
def q_romanised(spark: SparkSession, sf: str) -> DataFrame:
    """the words of documents in kana, letter by letter, and back in Latin letters as they then sound."""
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).select(F.lower("word").alias("word")).distinct()
    return found.select("word", words.romanised(_in_kana(F.col("word"))).alias("latin"))


@query("kana_dictionary", _LATIN + " SELECT DISTINCT latin AS word FROM l WHERE latin <> ''")
def q_kana_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary's entries, one to a word of documents, each with its reading."""
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).select(F.lower("word").alias("word")).distinct()
    return words.romanised_words(found.select(F.concat(F.lit("<entry><r_ele><reb>"), _in_kana(F.col("word")), F.lit("</reb></r_ele></entry>")).alias("line")))
