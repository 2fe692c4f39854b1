"""Functions of text columns: markup, colours, languages, names, numbers and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter language codes by two-letter ones.
LANGUAGES = {
    "en": "eng", "ja": "jpn", "jp": "jpn", "zh": "zho", "cn": "zho", "es": "spa", "de": "deu", "fr": "fra", "it": "ita", "pt": "por", "ru": "rus", "ko": "kor", "ar": "ara", "tr": "tur",
    "pl": "pol", "nl": "nld", "sv": "swe", "no": "nor", "fi": "fin", "da": "dan", "cs": "ces", "sk": "slk", "sl": "slv", "hu": "hun", "el": "ell", "he": "heb", "id": "ind", "vi": "vie",
    "th": "tha", "hi": "hin", "ur": "urd", "fa": "fas", "uk": "ukr", "ro": "ron", "bg": "bul", "sr": "srp", "hr": "hrv", "ms": "msa", "bn": "ben", "ta": "tam", "te": "tel",
}
#: Tags of chapter languages by three-letter codes.
CHAPTER_TAGS = {"eng": "en", "jpn": "ja", "spa": "es", "fra": "fr", "deu": "de", "ita": "it", "por": "pt", "rus": "ru", "kor": "ko", "zho": "zh"}


def looked_up(key: Column, known: dict[str, str]) -> Column:
    """What a stated map gives for a key; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key) if known else F.lit(None)


def normal_language(lang: Column) -> Column:
    """a language's three-letter code; null if it is none or undetermined, unknown codes as they are."""
    code = F.lower(F.trim(lang))
    return F.when((code == "") | (code == "und"), None).when(F.length(code) == 2, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), code), code)).otherwise(code)


def chapter_tag(code: Column) -> Column:
    """the tag of a three-letter code; und for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CHAPTER_TAGS.items() for x in pair]), code), F.lit("und"))


def to_overrides(markup: Column) -> Column:
    """b, i and u elements as overrides, six-digit font colours with their bytes turned round, other colours and tags dropped, line ends as \\N."""
    text = markup
    for tag in "biu":
        text = F.regexp_replace(F.regexp_replace(text, f"(?i)<{tag}>", f"{{\\\\{tag}1}}"), f"(?i)</{tag}>", f"{{\\\\{tag}0}}")
    text = F.regexp_replace(text, "(?i)<font\\s+color=[\"']?#([^\"'>\\s]{2})([^\"'>\\s]{2})([^\"'>\\s]{2})[\"']?\\s*>", r"{\\c&H$3$2$1&}")
    text = F.regexp_replace(text, "(?i)<font\\s+color=[\"']?[^\"'>\\s]+[\"']?\\s*>", "")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)</font>", r"{\\c}"), "<[^>]+>", "")
    return F.replace(text, F.lit("\n"), F.lit("\\N"))


def cue_to_overrides(markup: Column) -> Column:
    """the same for cues, whose class and voice spans go like other tags."""
    return F.regexp_replace(F.regexp_replace(to_overrides(markup), "</?c[^>]*>", ""), "</?v[^>]*>", "")


def from_overrides(text: Column) -> Column:
    """line breaks and overrides of b, i and u back to markup, all other blocks dropped, an unclosed one to the end."""
    text = F.replace(F.replace(text, F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    for tag in "biu":
        text = F.replace(F.replace(text, F.lit(f"{{\\{tag}1}}"), F.lit(f"<{tag}>")), F.lit(f"{{\\{tag}0}}"), F.lit(f"</{tag}>"))
    return F.replace(F.regexp_replace(text, r"\{[^}]*(\}|$)", ""), F.lit("}"), F.lit(""))


def format_number(v: Column) -> Column:
    """whole numbers without decimals."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def fraction(text: Column, default: float) -> Column:
    """The value of a text such as 24000/1001 or 25; the default where it is none or its denominator is zero."""
    part = F.split(F.trim(text), "/")
    top, bottom = F.get(part, F.lit(0)).try_cast("double"), F.when(F.size(part) > 1, F.get(part, F.lit(1)).try_cast("double")).otherwise(1.0)
    return F.coalesce(F.try_divide(top, bottom), F.lit(float(default)))


def file_name(text: Column) -> Column:
    """a text as a file's name: reserved characters as underscores, runs of these as one, none of them nor dots or blanks at the ends, a hundred characters at most; unnamed if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), "_{2,}", "_"), "^[_. ]+|[_. ]+$", "")
    return F.when(bare == "", "unnamed").otherwise(F.substring(bare, 1, 100))


def status_summary(status: Column, issues: Column) -> Column:
    """Failed, Warning with the number of issues, or Success."""
    return F.when(status == "Failed", "Failed").when(issues > 0, F.concat(F.lit("Warning ("), issues.cast("string"), F.when(issues != 1, " issues)").otherwise(" issue)"))).otherwise("Success")


def delays_summary(delays: Column) -> Column:
    """an array of (source, ms) as text, S for Source, signed, in order; a dash without any."""
    parts = F.array_sort(F.transform(delays, lambda d: F.format_string("%s: %+dms", F.replace(d["source"], F.lit("Source "), F.lit("S")), d["ms"])))
    return F.when(F.size(delays) > 0, F.array_join(parts, ", ")).otherwise("-")


def job_id(sources: Column) -> Column:
    """16 hex digits of the hash of an array of (key, path): each as key:file name, by key, those without a path left out."""
    named = F.transform(F.filter(F.array_sort(sources), lambda s: s["path"] != ""), lambda s: F.concat_ws(":", s["key"], F.regexp_extract(s["path"], r"([^/]*)$", 1)))
    return F.substring(F.sha2(F.array_join(named, "|"), 256), 1, 16)


def natural_key(text: Column) -> Column:
    """What sorts texts as people do: runs of digits filled up to twenty places, the rest lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(F.lower(x)))


def shell_quoted(text: Column) -> Column:
    """a text as one word of a shell: in single quotes if it has blanks or characters that a shell reads."""
    unsafe = text.rlike(r"""[\s"'\\$`!#&|;(){}\[\]<>?*~]""")
    return F.when(text == "", "''").when(unsafe, F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))).otherwise(text)


def progress_percent(line: Column) -> Column:
    """the number that a line's last word is, per cent signs aside; null if it is none."""
    return F.rtrim(F.regexp_extract(line, r"(\S+)\s*$", 1), F.lit("%")).try_cast("int")


def timestamp_digits(text: Column) -> Column:
    """the digits behind a timestamp's last dot; two where there is none."""
    return F.when(text.contains("."), F.length(F.regexp_extract(text, r"\.([^.]*)$", 1))).otherwise(2)


def position_percent(y: Column, height: Column, frame: Column) -> Column:
    """how far down a frame the middle of a box lies; at the bottom of one without height."""
    return F.when(frame == 0, 100.0).otherwise((y + height / 2.0) / frame * 100.0)


def screen_region(percent: Column, bottom: float = 75.0, top: float = 40.0) -> Column:
    """bottom from 75 percent on, top up to 40, middle between."""
    return F.when(percent >= bottom, "bottom").when(percent <= top, "top").otherwise("middle")


def _turned(digits: Column, unknown: int) -> Column:
    """Eight hex digits with the alpha inverted and the last three bytes turned round."""
    alpha = F.coalesce(F.when(F.substring(digits, 1, 2).rlike("^[0-9A-F]{2}$"), F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")), F.lit(unknown))
    return F.concat(F.lpad(F.hex(255 - alpha), 2, "0"), F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2))


def colour_to_hex(colour: Column) -> Column:
    """&HAABBGGRR as #AARRGGBB, its alpha inverted; missing digits are zeros in front."""
    return F.concat(F.lit("#"), _turned(F.lpad(F.upper(F.regexp_replace(colour, "^(&H|&h)+", "")), 8, "0"), 0))


def hex_to_colour(colour: Column) -> Column:
    """#AARRGGBB as &HAABBGGRR, its alpha inverted; missing digits are zeros in front."""
    return F.concat(F.lit("&H"), _turned(F.lpad(F.upper(F.regexp_replace(colour, "^#+", "")), 8, "0"), 255))


#: What tells a font among attachments: starts of types, whole types, words in types, endings, and endings that tell one in a generic binary.
FONT_STARTS, FONT_WORDS = ("font/", "application/font", "application/x-font"), ("font", "truetype", "opentype")
FONT_TYPES = ("application/x-truetype-font", "application/truetype", "application/vnd.ms-opentype", "application/opentype", "application/postscript", "application/x-font-type1")
FONT_ENDS, FONT_BINARY_ENDS, BINARY = ("ttf", "otf", "ttc", "woff", "woff2", "eot", "fon", "fnt", "pfb", "pfa"), ("ttf", "otf", "ttc", "woff", "woff2"), ("application/octet-stream", "binary/octet-stream")


def is_font(mime: Column, name: Column) -> Column:
    """Whether an attachment is a font, by its type or its name."""
    kind, name = F.lower(mime), F.lower(name)
    by_type = kind.isin(*FONT_TYPES) | kind.rlike("|".join(FONT_WORDS)) | kind.rlike("^(" + "|".join(FONT_STARTS) + ")")
    return by_type | (kind.isin(*BINARY) & name.rlike(r"\.(" + "|".join(FONT_BINARY_ENDS) + ")$")) | name.rlike(r"\.(" + "|".join(FONT_ENDS) + ")$")


#: Override tags whose numbers scale with the height, those whose pairs scale evenly and move by the borders, and those that hold further tags.
BY_HEIGHT, BY_PAIR, NESTED = ("fs", "fsp", "bord", "xbord", "ybord", "shad", "xshad", "yshad", "blur", "be"), ("pos", "move", "org", "clip", "iclip"), ("t",)


def _scaled_number(text: str, factor: float, offset: float = 0.0) -> str:
    try:
        value = float(text) * factor + offset
    except ValueError:
        return text
    return str(int(value)) if value == int(value) else f"{value:.3f}".rstrip("0").rstrip(".")


def scale_block(block: str, even: float, height: float, borders: tuple[float, float] = (0.0, 0.0)) -> str:
    """The tags of one override block with their numbers scaled: sizes by the height's factor, places by the even one and moved by the borders; transforms hold further tags, at any depth."""
    out, at = [], 0
    while at < len(block):
        if block[at] != "\\":
            out.append(block[at])
            at += 1
            continue
        end = at + 1
        while end < len(block) and block[end].isalpha():
            end += 1
        name = block[at + 1 : end]
        if end < len(block) and block[end] == "(":
            depth, close = 0, end
            while close < len(block):
                depth += (block[close] == "(") - (block[close] == ")")
                close += 1
                if not depth:
                    break
            inner = block[end + 1 : close - 1] if not depth else block[end + 1 :]
            if name in NESTED:
                inner = scale_block(inner, even, height, borders)
            elif name in BY_PAIR:
                inner = ",".join(_scaled_number(v.strip(), even, borders[i % 2]) if i < 4 else v for i, v in enumerate(inner.split(",")))
            out.append(f"\\{name}({inner}" + (")" if not depth else ""))
            at = close
            continue
        stop = end
        while stop < len(block) and (block[stop].isdigit() or block[stop] in ".-"):
            stop += 1
        number = block[end:stop]
        out.append(f"\\{name}{_scaled_number(number, height) if number and name in BY_HEIGHT else number}")
        at = stop
    return "".join(out)


def scale_tags(text: str, even: float, height: float, borders: tuple[float, float] = (0.0, 0.0)) -> str:
    """A text with the numbers of its override blocks scaled; what is outside blocks stays."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        end = text.find("}", start)
        if end < 0:
            break
        out += [text[at : start + 1], scale_block(text[start + 1 : end], even, height, borders), "}"]
        at = end + 1
    return "".join([*out, text[at:]])


def scaled_tags(text: Column, even: float, height: float, borders: tuple[float, float] = (0.0, 0.0)) -> Column:
    """P20: scale_tags() text by text, as nested brackets are beyond regular expressions. Texts may be long, and an Arrow batch holds 10,000 of them; the plain way sends a hundred at a time."""
    return F.udf(lambda t: None if t is None else scale_tags(t, even, height, borders), "string", useArrow=False)(text)
