"""Functions and documents by worked examples, and the scorers against transforms written out by hand."""

from __future__ import annotations

import cmath
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import texts, words
from tidemark.operators import signals
from tidemark.operators.chapters import format_delta, format_ns, parse_ns
from tidemark.operators.edits import Scale
from tidemark.operators.events import format_centis, parse_centis
from tidemark.plans.settings import Settings, load, orphans
from tidemark.sources import chapters_xml, subtitles


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, latin", [("あいうえお", "aiueo"), ("さしすせそ", "sashisuseso"), ("しゃ", "sha"), ("ちゅ", "chu"), ("きょ", "kyo"), ("がっこう", "gakkou"), ("にっぽん", "nippon"), ("カタカナ", "katakana"), ("ラーメン", "raamen"), ("ヴァイオリン", "vaiorin"), ("っ", ""), ("っa", "a"), ("っっか", "kka"), ("aー", "aa"), ("ー", ""), ("x ぢゃ1", "x ja1"), ("ファン", "fan"), ("ヂュ", "ju"), ("ゐゑを", "wiwewo")])
def test_kana(text, latin):
    assert words.latin(text) == latin


def test_kana_readings_of_a_dictionary(spark):
    lines = spark.createDataFrame([("<entry><reb>ねこ</reb><reb>ネコ</reb>",), ("<reb>いぬ</reb>",), ("none",)], "line string")
    assert sorted(r.word for r in words.romanised_words(lines).collect()) == ["inu", "neko"]


@pytest.mark.parametrize("markup, made", [("<b>x</b>", "{\\b1}x{\\b0}"), ("<I>x</I>", "{\\i1}x{\\i0}"), ('<font color="#FF0000">r</font>', "{\\c&H0000FF&}r{\\c}"), ("<font color='red'>r</font>", "r{\\c}"), ("a\nb", "a\\Nb"), ("<span>x</span>", "x")])
def test_markup(spark, markup, made):
    assert one(spark, texts.to_overrides(F.col("t")), t=markup) == made


def test_markup_back_and_unbalanced_braces(spark):
    assert one(spark, texts.from_overrides(F.col("t")), t="{\\b1}x{\\b0}\\Ny{\\pos(1,2)}z}") == "<b>x</b>\nyz"
    assert one(spark, texts.from_overrides(F.col("t")), t="kept{lost") == "kept"


@pytest.mark.parametrize("text, even, height, borders, made", [("{\\fs20}a", 2, 3, (0, 0), "{\\fs60}a"), ("{\\pos(10,20)\\an8}", 2, 2, (5, 7), "{\\pos(25,47)\\an8}"), ("{\\t(0,100,\\fs10\\t(\\bord2))}x", 1, 2, (0, 0), "{\\t(0,100,\\fs20\\t(\\bord4))}x"), ("{\\fs1.5", 2, 2, (0, 0), "{\\fs1.5"), ("{\\fs1.25}", 2, 2, (0, 0), "{\\fs2.5}"), ("no", 2, 2, (0, 0), "no")])
def test_tags_are_scaled(text, even, height, borders, made):
    assert texts.scale_tags(text, even, height, borders) == made


def test_scales():
    assert Scale.between((640, 480), (640, 480)) is None and Scale.between((0, 0), (1, 1)) is None
    assert Scale.between((640, 360), (1920, 1200)) == Scale(3.0, 1200 / 360, 0.0, 60.0)


@pytest.mark.parametrize("text, ns", [("00:01:31.074316666", 91_074_316_666), ("00:00:01.5", 1_500_000_000), ("01:00:00", 3_600_000_000_000)])
def test_chapter_times(spark, text, ns):
    assert one(spark, parse_ns(F.col("t")), t=text) == ns


def test_clamped_and_signed_times(spark):
    assert one(spark, format_ns(F.col("t")), t=-100) == "00:00:00.000000000"
    assert one(spark, format_delta(F.col("t")), t=500) == "+500ns" and one(spark, format_delta(F.col("t")), t=-2_500_000) == "-2.500ms"
    assert one(spark, parse_centis(F.col("t")), t="1:23:45.67") == 5_025_670.0 and one(spark, format_centis(F.col("t")), t=5_025_670.0) == "1:23:45.67"


def test_numbers_and_fractions(spark):
    assert one(spark, texts.format_number(F.col("v")), v=48.0) == "48" and one(spark, texts.format_number(F.col("v")), v=2.5) == "2.5"
    assert one(spark, texts.fraction(F.col("t"), 9.0), t="24000/1001") == 24000 / 1001 and one(spark, texts.fraction(F.col("t"), 9.0), t="1/0") == 9.0 and one(spark, texts.fraction(F.col("t"), 9.0), t="x") == 9.0


@pytest.mark.parametrize("text, quoted", [("", "''"), ("plain-1.mkv", "plain-1.mkv"), ("a b", "'a b'"), ("it's", "'it'\\''s'"), ("$x", "'$x'")])
def test_shell_words(spark, text, quoted):
    assert one(spark, texts.shell_quoted(F.col("t")), t=text) == quoted


@pytest.mark.parametrize("mime, name, font", [("application/octet-stream", "a.ttf", True), ("application/octet-stream", "data.bin", False), ("font/ttf", "x", True), ("image/png", "x.png", False), ("text/plain", "x.OTF", True)])
def test_fonts(spark, mime, name, font):
    assert one(spark, texts.is_font(F.col("m"), F.col("n")), m=mime, n=name) is font


SRT = "1\n00:00:01,000 --> 00:00:02,500\n<b>Hi</b>\nthere\n\n00:00:03.000 --> 00:00:04,000\nno number\n\n3\nnot a time\n\n7\n00:00:05,000 --> 00:00:06,000\n"


def test_subrip(spark):
    docs = spark.createDataFrame([("a", SRT.replace("\n", "\r\n")), ("b", "﻿" + SRT), ("c", ""), ("d", None)], "doc string, content string")
    got = {}
    for r in subtitles.srt_events(docs).collect():
        got.setdefault(r.doc, []).append((r.srt_index, r.start_ms, r.end_ms, r.text))
    expected = [(1, 1000.0, 2500.0, "{\\b1}Hi{\\b0}\\Nthere"), (None, 3000.0, 4000.0, "no number"), (7, 5000.0, 6000.0, "")]
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == {"a": expected, "b": expected}


def test_web_cues(spark):
    text = "intro\nWEBVTT\nheader\n\nid\n00:01.000 --> 01:00:02.000 line:0\n<v Ann>x</v> <c.y>z</c>\n\nNOTE none\n"
    (r,) = subtitles.vtt_events(spark.createDataFrame([("a", text)], "doc string, content string")).collect()
    assert (r.start_ms, r.end_ms, r.text) == (1000.0, 3_602_000.0, "x z")


ASS = """[Script Info]
Title: t

[Events]
Format: Start, Layer, End, Text
Dialogue: 0:00:01.00, 3 ,0:00:02.5,a, b,c
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Comment: x,0:00:03.00,0:00:04.00,Main,Ann,1,2,3,fx,{\\i1}t
Dialogue: 1,bad
Other: 1
"""


def test_ass_fields_follow_the_format_in_force(spark):
    lines = subtitles.ass_lines(spark.createDataFrame([("a", ASS)], "doc string, content string"))
    got = [tuple(r)[1:] for r in subtitles.events(lines).orderBy("idx").collect()]
    assert got == [(0, 1000.0, 2050.0, "a, b,c", "Default", 3, "", 0, 0, 0, "", False), (1, 3000.0, 4000.0, "{\\i1}t", "Main", 0, "Ann", 1, 2, 3, "fx", True), (2, 0.0, 0.0, "", "Default", 1, "", 0, 0, 0, "", False)]


@pytest.mark.parametrize("data, name, bom", [(b"plain", "utf-8", False), ("é".encode(), "utf-8", False), (b"\xef\xbb\xbfx", "utf-8-sig", True), (b"\xff\xfex\0", "utf-16-le", True), (b"\xfe\xff\0x", "utf-16-be", True), ("日本".encode("shift_jis"), "shift_jis", False), (b"\xff\xff caf\xe9", "windows-1252", False), (b"\x81\x00\xff", "iso-8859-1", False)])
def test_encodings(spark, data, name, bom):
    got = spark.createDataFrame([(bytearray(data),)], "content binary").select(subtitles.detect_encoding(F.col("content")).alias("e")).first().e
    assert (got.name, got.has_bom) == (name, bom)


def test_files_of_any_encoding_are_read(spark, tmp_path):
    for name, data in (("a.srt", SRT.encode("utf-16")), ("b.srt", "é".encode("latin-1") + b"\xff\xff"), ("c.srt", b"\xef\xbb\xbfx")):
        (tmp_path / name).write_bytes(data)
    got = {r.doc.rpartition("/")[2]: r.content for r in subtitles.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.srt": SRT, "b.srt": "éÿÿ", "c.srt": "x"}


def test_chapters_of_xml(spark):
    basic = '<?xml version="1.0"?><Chapters xmlns="u"><EditionEntry><ChapterAtom><ChapterUID>1</ChapterUID><ChapterTimeStart>00:05:00.000000000</ChapterTimeStart><ChapterDisplay><ChapterString>A &lt;1&gt; &amp; &quot;b&quot;</ChapterString><ChapterLanguage>jpn</ChapterLanguage></ChapterDisplay></ChapterAtom><m:ChapterAtom><m:ChapterTimeStart>00:00:00.5</m:ChapterTimeStart><m:ChapterTimeEnd>00:00:01</m:ChapterTimeEnd></m:ChapterAtom><ChapterAtom><x/></ChapterAtom></EditionEntry></Chapters>'
    read = chapters_xml.read_chapters(spark.createDataFrame([("a", basic)], "doc string, content string"))
    rows = [(r.start_ns, r.end_ns, [tuple(d) for d in r.displays]) for r in read.orderBy("start_ns").collect()]
    assert rows == [(500_000_000, 1_000_000_000, [("Chapter 2", "und", "und")]), (300_000_000_000, None, [('A <1> & "b"', "jpn", "ja")])]
    again = chapters_xml.read_chapters(chapters_xml.write_chapters(read)).orderBy("start_ns").collect()
    assert [(r.start_ns, r.end_ns, [tuple(d) for d in r.displays]) for r in again] == rows


def test_garbage(spark):
    assert one(spark, words.is_garbage(F.col("t"), F.lit(10.0)), t="a b c d word") is True and one(spark, words.is_garbage(F.col("t"), F.lit(90.0)), t="a b c d word") is False
    assert one(spark, words.is_garbage(F.col("t"), F.lit(90.0)), t="AB C DE F word") is True and one(spark, words.is_garbage(F.col("t"), F.lit(90.0)), t="it") is False
    assert one(spark, words.cleaned(F.col("t")), t="A B C D\\Nreal text here\\NAB C D then a long line of text") == "real text here\\Nthen a long line of text"
    assert one(spark, words.cleaned(F.col("t")), t="A B C D") == ""


def test_words_come_together_again(spark):
    rows = spark.createDataFrame([(1, " a  b\tc "), (2, "x")], "id long, text string")
    assert {r.id: r.text for r in words.reassembled(words.tokens(rows, "id", "text"), "id").collect()} == {1: " a  b\tc ", 2: "x"}


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('dense_window_s = 5.0\nunknown_key = 1\nstepping_correction_mode = "filtered"\n')
    (tmp_path / "b.json").write_text('{"min_match_pct": 20.0}')
    made, data = load(str(tmp_path / "a.toml"))
    assert made == Settings(dense_window_s=5.0, stepping_correction_mode="filtered") and orphans(data) == ["unknown_key"]
    assert load(str(tmp_path / "b.json"))[0].min_match_pct == 20.0


def dft(x, n):
    return [sum(v * cmath.exp(-2j * cmath.pi * k * i / n) for i, v in enumerate(x)) for k in range(n // 2 + 1)]


def inverse(spectrum, n):
    out = []
    for t in range(n):
        total = spectrum[0].real + (spectrum[-1] * cmath.exp(1j * cmath.pi * t)).real
        out.append((total + 2 * sum((spectrum[k] * cmath.exp(2j * cmath.pi * k * t / n)).real for k in range(1, n // 2))) / n)
    return out


@pytest.mark.parametrize("name", ["phase", "coherent", "whitened"])
def test_weighted_scorers_by_hand(name):
    rng, rate, size = random.Random(3), 16_000.0, 200
    base = [rng.gauss(0, 1) for _ in range(size + 40)]
    a, b = base[:size], base[17 : 17 + size]
    n = 512
    x, y = dft(a, n), dft(b, n)
    cross = []
    for k, (p, q) in enumerate(zip(x, y)):
        weigh = {"phase": lambda: p * q.conjugate() / (abs(p * q.conjugate()) + 1e-9), "coherent": lambda: p * q.conjugate() / (math.sqrt(abs(p) ** 2 * abs(q) ** 2) + 1e-9), "whitened": lambda: p / (abs(p) + 1e-9) * (q / (abs(q) + 1e-9)).conjugate()}[name]
        cross.append(weigh() if 300 <= k * rate / n <= 6000 else 0j)
    correlation = [abs(v) for v in inverse(cross, n)]
    peak = max(range(n), key=lambda i: round(correlation[i], 9))
    rest = [v for i, v in enumerate(correlation) if not peak - 100 <= i <= peak + 100]
    mean = sum(rest) / len(rest)
    ratio = (correlation[peak] - mean) / math.sqrt(sum((v - mean) ** 2 for v in rest) / len(rest))
    lag, confidence = signals.SCORERS[name](np.array(a), np.array(b), rate)
    assert lag == (peak if peak <= n // 2 else peak - n) == 17
    assert abs(confidence - min(max((ratio - 10) * 10, 0), 100)) < 1e-6


def test_spectra_and_envelopes_by_hand():
    rng = random.Random(5)
    x = [rng.gauss(0, 1) for _ in range(100)]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 32) for i in range(32)]
    frames = [[abs(v) for v in dft([w * s for w, s in zip(window, x[at : at + 32])], 32)] for at in range(0, 69, 8)]
    made = signals.spectrogram(np.array(x), 32, 8)
    assert np.allclose(made.T, frames)
    rises = [sum(max(b - a, 0) for a, b in zip(f, g)) / 17 for f, g in zip(frames, frames[1:])]
    assert np.allclose(signals.onset_envelope(np.array(x), 32, 8), rises)
    filters = signals.mel_filters(16_000.0, 32, 4)
    corners = [700 * (10 ** (2595 * math.log10(1 + 8000 / 700) * i / 5 / 2595) - 1) for i in range(6)]
    for m in range(4):
        for k in range(17):
            hz = 500.0 * k
            left, centre, right = corners[m : m + 3]
            wanted = (hz - left) / (centre - left) if left <= hz <= centre else (right - hz) / (right - centre) if centre < hz <= right else 0.0
            assert abs(filters[m, k] - wanted) < 1e-9


@pytest.mark.parametrize("name, settings_", [("onset", {"frame": 64, "hop": 16}), ("mel", {"frame": 64, "hop": 16, "mels": 8})])
def test_feature_scorers_find_a_delay(name, settings_):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, 6000) * np.repeat(rng.random(60) > 0.6, 100)
    lag, confidence = signals.SCORERS[name](base[:4000], base[320:4320], 16_000.0, **settings_)
    assert abs(lag - 320) <= 16 and confidence > 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=24, max_size=60), st.integers(0, 23))
def test_peak_confidences_by_hand(values, peak):
    size = [abs(v) for v in values]
    order, near = sorted(size), max(len(size) // 100, 1)
    others = [v for i, v in enumerate(size) if not peak - near <= i <= peak + near]
    second = max(others) if max(others) > 0 else order[len(size) // 2]
    limit = order[min(int(len(size) * 0.9), len(size) - 1)]
    quiet = [v for v in size if v < limit]
    spread = math.sqrt(sum((v - sum(quiet) / len(quiet)) ** 2 for v in quiet) / len(quiet)) if len(quiet) > 10 else 1e-9
    total = size[peak] / (order[len(size) // 2] + 1e-9) * 5 + size[peak] / (second + 1e-9) * 8 + size[peak] / (spread + 1e-9) * 1.5
    assert math.isclose(signals.peak_confidence(np.array(values), peak), min(max(total / 3, 0), 100), rel_tol=1e-6, abs_tol=1e-6)


def test_peaks_are_signed_and_refined():
    c = np.zeros(16)
    c[14], c[13], c[15] = -4.0, 2.0, 3.0
    assert signals.signed_lag(c) == -2.0 and abs(signals.signed_lag(c, refine=True) - (-2.0 + 0.5 * (2 - 3) / (2 - 8 + 3))) < 1e-12
    assert signals.list_scorers() == ["coherent", "mel", "onset", "phase", "standard", "whitened"]


@pytest.mark.parametrize("span", (1, 2, 3, 5, 4096))
def test_runs_of_blocks_over_spans(spark, span):
    flags = [1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 0, 1, 0, 1, 1]
    rows = spark.createDataFrame([(s, i, float(i), f) for s in ("a", "b") for i, f in enumerate(flags[len(s) - 1 + (s == "b") :])], "signal string, block long, db double, on int").repartition(3)
    found = {(r.signal, r.first, r["last"], r.length, r.mean_db) for r in signals.runs(rows, F.col("on") == 1, 1, span).collect()}
    wanted = set()
    for s in ("a", "b"):
        own, start = [*flags[s == "b" :], 0], None
        for i, f in enumerate(own):
            if f and start is None:
                start = i
            if not f and start is not None:
                wanted.add((s, start, i - 1, i - start, (start + i - 1) / 2))
                start = None
    assert found == wanted
    assert {r.length for r in signals.runs(rows, F.col("on") == 1, 3, span).collect()} == {6}
