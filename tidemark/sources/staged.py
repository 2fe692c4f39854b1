"""Data sources of files that tasks write apart and a commit makes visible; register() makes wordlist and textdocument known to a session."""

from __future__ import annotations

import uuid
import xml.parsers.expat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from tidemark.session import ship

#: Bytes of a text list in one partition, and of an XML file that are parsed at once.
SPLIT, CHUNK = 8 << 20, 1 << 16
#: Documents in an archive, whose directory a task holds.
PACK = 10_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[fs.FileInfo]:
    """The file at a path, or all visible files under it, in order of their names."""
    system, base = _open(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    visible = lambda f: not any(p[:1] in "_." for p in f.path[len(base) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and visible(f)), key=lambda f: f.path)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written, or None."""

    folder: str | None


class StagedWriter(DataSourceWriter):
    """Each attempt of a task writes into a hidden folder of its own; the commit moves the folders of the attempts that count to where readers look, and an abort removes them all. So nothing of a failed job is seen, and an attempt that is run again leaves nothing twice."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def task(self, rows: Iterator[Row], system: fs.FileSystem, folder: str) -> int:
        """Write rows as files into folder; how many files."""
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, base = _open(self.path)
        folder = f"{base}/_staging/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        try:
            written = self.task(iterator, system, folder)
        except BaseException:
            system.delete_dir(folder)
            raise
        return Staged(folder if written else None)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = _open(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.base_name != "_staging":
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for i, message in enumerate(messages):
            if message is not None and message.folder:
                system.move(message.folder, f"{base}/part-{i:05d}-{self.job}")
        self._clean(system, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*_open(self.path))

    def _clean(self, system: fs.FileSystem, base: str) -> None:
        """Remove this job's staging folder, and the folder above it unless another job is writing."""
        if system.get_file_info(f"{base}/_staging/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_staging/{self.job}")
        if not system.get_file_info(fs.FileSelector(f"{base}/_staging", allow_not_found=True)) and system.get_file_info(f"{base}/_staging").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_staging")


# Documents: a file for each row


class DocumentWriter(StagedWriter):
    """Rows (name, text) as files of their own, or packed into archives of them; a null text is an empty file."""

    def __init__(self, path: str, overwrite: bool, packed: bool = False):
        super().__init__(path, overwrite)
        self.packed = packed

    def task(self, rows: Iterator[Row], system: fs.FileSystem, folder: str) -> int:
        named = self._named(rows)
        if not self.packed:
            return sum(self._file(system, f"{folder}/{name}", text) for name, text in named)
        written = 0
        while some := list(islice(named, 1)):
            with system.open_output_stream(f"{folder}/{written // PACK:05d}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, text in chain(some, islice(named, PACK - 1)):
                    archive.writestr(name, text)
                    written += 1
        return written

    def _file(self, system: fs.FileSystem, path: str, text: bytes) -> int:
        with system.open_output_stream(path) as out:
            out.write(text)
        return 1

    def _named(self, rows: Iterator[Row]) -> Iterator[tuple[str, bytes]]:
        names = set()
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name[:1] in "_." or name in names:
                raise ValueError(f"no name for a document, or not the only one: {name!r}")
            names.add(name)
            yield name, (row["text"] or "").encode()


class DocumentReader(DataSourceReader):
    """Documents by name, out of archives where they are packed; a partition holds the files of one folder."""

    def __init__(self, path: str, packed: bool = False):
        self.path, self.packed = path, packed

    def partitions(self) -> list[InputPartition]:
        folders: dict[str, list[str]] = {}
        for f in _files(self.path):
            folders.setdefault(f.path.rpartition("/")[0], []).append(f.path)
        return [InputPartition(paths) for paths in folders.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path in partition.value if partition is not None else ():
            if self.packed:
                with system.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
                    for name in archive.namelist():
                        yield name, archive.read(name).decode(errors="replace")
                continue
            with system.open_input_stream(path) as source:
                yield path.rpartition("/")[2], source.read().decode(errors="replace")


class TextDocuments(DataSource):
    """Format textdocument: (name, text), a file each; with the option packed, of both sides, in zip archives of PACK of them."""

    @classmethod
    def name(cls) -> str:
        return "textdocument"

    def schema(self) -> StructType:
        return StructType().add("name", StringType()).add("text", StringType())

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options["path"], self._packed())

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite, self._packed())

    def _packed(self) -> bool:
        return self.options.get("packed", "false").lower() == "true"


# Word lists and fix rules

#: The elements of rule files; sections and the kinds of their rules.
SECTIONS = {
    "WholeLines": "whole_line", "PartialLinesAlways": "partial_line_always", "PartialLines": "partial_line", "BeginLines": "begin_line", "EndLines": "end_line",
    "WholeWords": "whole_word", "PartialWordsAlways": "partial_word_always", "PartialWords": "partial_word", "RegularExpressions": "regex",
}
RULE_ELEMENTS = ("Line", "LinePart", "WordPart", "Beginning", "Ending", "Word")
REGEX_ELEMENTS = ("Regex", "RegEx")
#: What a rule file is written with, by kind.
_WRITTEN = {"whole_line": "Line", "partial_line_always": "LinePart", "partial_line": "LinePart", "begin_line": "Beginning", "end_line": "Ending", "whole_word": "Word", "partial_word_always": "WordPart", "partial_word": "WordPart"}
FORMATS = ("words", "word_split", "xml", "names", "rules")


def list_schema(kind: str) -> StructType:
    """The columns of a format: file, at (the entry's byte in it), what it says, and problem, null for a sound entry."""
    own = {"names": [("word", StringType()), ("blacklisted", BooleanType())], "rules": [("kind", StringType()), ("old", StringType()), ("new", StringType())]}
    schema = StructType().add("file", StringType()).add("at", LongType())
    for name, of in own.get(kind, [("word", StringType())]):
        schema = schema.add(name, of)
    return schema.add("problem", StringType())


class _Entries:
    """Parses one XML list as its bytes come in; out holds the entries found so far, without the file's name."""

    def __init__(self, kind: str, element: str):
        self.kind, self.element, self.out = kind, element if kind == "xml" else "name", []
        self.text, self.inside, self.black, self.section, self.start = [], False, False, None, 0
        self.parser = xml.parsers.expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.opened, self.closed
        self.parser.CharacterDataHandler = lambda data: self.text.append(data) if self.inside else None

    def opened(self, tag: str, attributes: dict[str, str]) -> None:
        at = self.parser.CurrentByteIndex
        if self.kind != "rules":
            if tag == self.element:
                self.inside, self.start = True, at
                self.text.clear()
            self.black |= self.kind == "names" and tag == "blacklist"
        elif tag in SECTIONS:
            self.section = SECTIONS[tag]
        elif tag in RULE_ELEMENTS or tag in REGEX_ELEMENTS:
            regex = tag in REGEX_ELEMENTS
            old, new = (attributes.get("find", ""), attributes.get("replaceWith", "")) if regex else (attributes.get("from", ""), attributes.get("to", ""))
            fits = self.section is not None and regex == (self.section == "regex")
            self.out.append((at, self.section if fits else None, old, new, None if fits and old else "nothing to replace" if fits else "outside its section"))

    def closed(self, tag: str) -> None:
        if self.kind == "rules":
            if tag in SECTIONS:
                self.section = None
        elif tag == self.element and self.inside:
            word = "".join(self.text).strip()
            self.inside = False
            black = (self.black,) if self.kind == "names" else ()
            self.out.append((self.start, word if self.black else word.lower(), *black, None if word else "empty"))
        elif self.kind == "names" and tag == "blacklist":
            self.black = False


class WordListReader(DataSourceReader):
    """Text lists by ranges of bytes, XML lists a file to a partition and parsed as a stream. What can't be read is a row with its problem; what comes before a break in an XML file stays."""

    def __init__(self, options: dict):
        self.path, self.kind, self.element = options["path"], options.get("format", "words"), options.get("element", "Word")
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for f in _files(self.path):
            step = self.split if self.kind in ("words", "word_split") else max(f.size, 1)
            parts += [InputPartition((f.path, start, min(start + step, f.size))) for start in range(0, f.size, step)]
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        path, start, end = partition.value
        system, _ = _open(self.path)
        if self.kind in ("words", "word_split"):
            for entry in self._lines(system, path, start, end):
                yield path, *entry
            return
        entries = _Entries(self.kind, self.element)
        with system.open_input_stream(path) as source:
            while True:
                chunk = source.read(CHUNK)
                try:
                    entries.parser.Parse(chunk, not chunk)
                except xml.parsers.expat.ExpatError as error:
                    width = len(list_schema(self.kind)) - 3
                    entries.out.append((entries.parser.CurrentByteIndex, *[None] * width, f"XML: {error}"))
                    chunk = b""
                for entry in entries.out:
                    yield path, *entry
                entries.out.clear()
                if not chunk:
                    return

    def _lines(self, system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple]:
        """(at, word, problem) of the lines that start in [start, end)."""
        with system.open_input_file(path) as source:
            at = max(start - 1, 0)
            source.seek(at)
            held = source.read(end - at)
            while not held.endswith(b"\n"):
                more = source.read(CHUNK)
                held += more[: more.find(b"\n") + 1] or more
                if not more:
                    break
        if start:  # a line belongs to the range that it starts in
            skip = held.find(b"\n") + 1 or len(held)
            held, at = held[skip:], at + skip
        for line in held.split(b"\n"):
            if at >= end:
                return
            try:
                word, problem = line.decode().strip(), None
            except UnicodeDecodeError:
                word, problem = line.decode(errors="replace").strip(), "not UTF-8"
            if word and not word.startswith("#"):
                yield at, word.lower(), problem
            at += len(line) + 1


class WordListWriter(StagedWriter):
    """A file for each task in the format that the reader reads; columns file, at and problem are left out."""

    def __init__(self, path: str, overwrite: bool, kind: str, element: str):
        super().__init__(path, overwrite)
        self.kind, self.element = kind, element

    def task(self, rows: Iterator[Row], system: fs.FileSystem, folder: str) -> int:
        first = next(rows, None)
        if first is None:
            return 0
        with system.open_output_stream(f"{folder}/list.{'txt' if self.kind in ('words', 'word_split') else 'xml'}") as out:
            for text in self._texts(first, rows):
                out.write(text.encode())
        return 1

    def _texts(self, first: Row, rows: Iterator[Row]) -> Iterator[str]:
        def all_rows() -> Iterator[Row]:
            yield first
            yield from rows

        if self.kind in ("words", "word_split"):
            for row in all_rows():
                if row["word"] is None or "\n" in row["word"]:
                    raise ValueError(f"no word of a text list: {row['word']!r}")
                yield f"{row['word']}\n"
            return
        yield '<?xml version="1.0" encoding="utf-8"?>\n<list>\n'
        now = None
        for row in all_rows():
            if self.kind == "rules":
                section = next((s for s, k in SECTIONS.items() if k == row["kind"]), None)
                if section is None:
                    raise ValueError(f"no kind of rules: {row['kind']!r}")
            else:
                section = "blacklist" if self.kind == "names" and row["blacklisted"] else None
            if section != now:
                yield (f"</{now}>\n" if now else "") + (f"<{section}>\n" if section else "")
                now = section
            if self.kind != "rules":
                tag = self.element if self.kind == "xml" else "name"
                yield f"<{tag}>{escape(row['word'] or '')}</{tag}>\n"
            elif row["kind"] == "regex":
                yield f"<RegEx find={_attribute(row['old'])} replaceWith={_attribute(row['new'])} />\n"
            else:
                yield f"<{_WRITTEN[row['kind']]} from={_attribute(row['old'])} to={_attribute(row['new'])} />\n"
        yield (f"</{now}>\n" if now else "") + "</list>\n"


def _attribute(value: str | None) -> str:
    return quoteattr(value or "", {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})


class WordLists(DataSource):
    """Format wordlist; option format is one of FORMATS, element names the elements of xml, split the bytes of a text partition."""

    @classmethod
    def name(cls) -> str:
        return "wordlist"

    def _kind(self) -> str:
        kind = self.options.get("format", "words")
        if kind not in FORMATS:
            raise ValueError(f"no format {kind}; there are {', '.join(FORMATS)}")
        return kind

    def schema(self) -> StructType:
        return list_schema(self._kind())

    def reader(self, schema: StructType) -> WordListReader:
        self._kind()
        return WordListReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WordListWriter:
        return WordListWriter(self.options["path"], overwrite, self._kind(), self.options.get("element", "Word"))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    ship(spark)
    spark.dataSource.register(TextDocuments)
    spark.dataSource.register(WordLists)
