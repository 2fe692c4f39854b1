"""Word lists, rules and documents written and read by the data sources, sound and damaged."""

from __future__ import annotations

import pytest

from tidemark.sources.staged import SECTIONS, register


def load(spark, path, kind, **options):
    return spark.read.format("wordlist").option("format", kind).options(**options).load(str(path))


def rows(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


@pytest.mark.parametrize("split", (1, 3, 7, 16, 1 << 20))
def test_text_lists_by_ranges_of_bytes(spark, tmp_path, split):
    register(spark)
    (tmp_path / "a.txt").write_bytes("Word\n# a note\n\n  Éclair \r\nlast line".encode())
    (tmp_path / "b.txt").write_bytes(b"b\xff\xfed\nfine\n")
    (tmp_path / "_hidden.txt").write_text("hidden\n")
    got = rows(load(spark, tmp_path, "words", split=split).orderBy("file", "at"), "word", "problem", "at")
    assert got == [("word", None, 0), ("éclair", None, 15), ("last line", None, 27), ("b��d", "not UTF-8", 0), ("fine", None, 5)]
    assert rows(load(spark, tmp_path / "b.txt", "word_split"), "word") == [("b��d",), ("fine",)]


def test_word_and_name_elements(spark, tmp_path):
    register(spark)
    (tmp_path / "w.xml").write_text("<all><Word>Tom &amp; J</Word><word>no</word><Word> </Word><Word>a<b>B</b></Word></all>")
    assert sorted(rows(load(spark, tmp_path, "xml"), "word", "problem"), key=str) == [("", "empty"), ("ab", None), ("tom & j", None)]
    assert rows(load(spark, tmp_path, "xml", element="word"), "word") == [("no",)]
    (tmp_path / "w.xml").write_text("<names><blacklist><name>Bad One</name></blacklist><name> Ann </name></names>")
    assert rows(load(spark, tmp_path, "names"), "word", "blacklisted", "problem") == [("Bad One", True, None), ("ann", False, None)]


def test_rules_of_all_sections(spark, tmp_path):
    register(spark)
    lines = "".join(f"<{s}><{'Regex' if s == 'RegularExpressions' else 'Line'} {'find' if s == 'RegularExpressions' else 'from'}='{i}' {'replaceWith' if s == 'RegularExpressions' else 'to'}='x'/></{s}>" for i, s in enumerate(SECTIONS))
    (tmp_path / "r.xml").write_text(f"<OCRFixReplaceList>{lines}<Line from='lost' to='y'></Line><WholeWords><Word to='z'/><Regex find='a' replaceWith='b'/></WholeWords></OCRFixReplaceList>")
    got = rows(load(spark, tmp_path, "rules").orderBy("at"), "kind", "old", "new", "problem")
    assert got[:9] == [(kind, str(i), "x", None) for i, kind in enumerate(SECTIONS.values())]
    assert got[9:] == [(None, "lost", "y", "outside its section"), ("whole_word", "", "z", "nothing to replace"), (None, "a", "b", "outside its section")]


def test_a_broken_file_keeps_what_came_before(spark, tmp_path):
    register(spark)
    (tmp_path / "n.xml").write_text("<names><name>one</name><name>two</nam>")
    (tmp_path / "o.xml").write_text("<names><name>three</name></names>")
    (tmp_path / "p.xml").write_text("")
    got = rows(load(spark, tmp_path, "names").orderBy("file", "at"), "word", "problem")
    assert [g[0] for g in got] == ["one", None, "three"] and got[1][1].startswith("XML: mismatched tag")


def test_long_files_are_parsed_as_a_stream(spark, tmp_path):
    register(spark)
    (tmp_path / "n.xml").write_text("<names>" + "".join(f"<name>n{i}</name>" for i in range(20_000)) + "</names>")
    (tmp_path / "w.txt").write_text("".join(f"w{i}\n" for i in range(20_000)))
    assert load(spark, tmp_path / "n.xml", "names").where("problem IS NULL").distinct().count() == 20_000
    text = load(spark, tmp_path / "w.txt", "words", split=10_000)
    assert text.rdd.getNumPartitions() > 10 and text.select("word").distinct().count() == 20_000


RULES = [("whole_line", "<a> & 'b'", 'say "x"'), ("whole_word", "ä\tö", "line\nline"), ("regex", r"(\d)&lt;", "$1"), ("begin_line", "B", ""), ("begin_line", "C", "D")]


def test_lists_are_written_and_read_back(spark, tmp_path):
    register(spark)
    rules = spark.createDataFrame(RULES, "kind string, old string, new string").coalesce(1)
    rules.write.format("wordlist").option("format", "rules").mode("append").save(str(tmp_path / "r"))
    assert sorted(rows(load(spark, tmp_path / "r", "rules"), "kind", "old", "new", "problem")) == sorted((*r, None) for r in RULES)
    names = spark.createDataFrame([("Ann", False), ("Bad", True), ("Bo & Co", False)], "word string, blacklisted boolean").repartition(3)
    for _ in range(2):
        names.write.format("wordlist").option("format", "names").mode("append").save(str(tmp_path / "n"))
    assert sorted(rows(load(spark, tmp_path / "n", "names"), "word")) == sorted([("ann",), ("Bad",), ("bo & co",)] * 2)
    names.where("blacklisted").write.format("wordlist").option("format", "names").mode("overwrite").save(str(tmp_path / "n"))
    assert rows(load(spark, tmp_path / "n", "names"), "word", "blacklisted") == [("Bad", True)]
    assert not (tmp_path / "n" / "_staging").exists()


def test_nothing_is_seen_of_a_failed_task(spark, tmp_path):
    register(spark)
    good = spark.createDataFrame([(f"job{i}.txt", f"text {i}") for i in range(12)], "name string, text string").repartition(4)
    good.write.format("textdocument").mode("append").save(str(tmp_path))
    bad = good.selectExpr("concat('again-', name) AS name", "text").unionByName(spark.createDataFrame([("x/y", "no name")], "name string, text string"))
    with pytest.raises(Exception, match="no name for a document"):
        bad.write.format("textdocument").mode("append").save(str(tmp_path))
    assert sorted(rows(spark.read.format("textdocument").load(str(tmp_path)), "name", "text")) == sorted((f"job{i}.txt", f"text {i}") for i in range(12))
    assert not (tmp_path / "_staging").exists() and len(list(tmp_path.glob("part-*/*"))) == 12
    assert sorted(r.value for r in spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(str(tmp_path)).collect()) == sorted(f"text {i}" for i in range(12))


def test_wrong_options_and_missing_paths(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="no format csv"):
        load(spark, tmp_path, "csv").count()
    with pytest.raises(Exception, match="FileNotFoundError"):
        load(spark, tmp_path / "none", "words").count()
    assert load(spark, tmp_path, "words").count() == 0
