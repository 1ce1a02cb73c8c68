"""EPUB packages as a data source: read entry by entry, and written a file a book.

Both are Python data sources of Spark, under the name "epub". A file is opened where it lies and its entries are read one after the other,
so no package is held whole but those of a few MB, which are fetched at once. The writer is given a book's rows in order and streams them into a file in a staging folder; a task
renames its files when all are done, so that a package is there whole or not at all.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: What refers to a chapter, as rows; and the entries themselves.
REFERENCES = "package string, source string, ord int, href string, title string"
ENTRIES = "package string, ord int, name string, n_bytes long, content binary"
#: What the sink takes: of each book a row of kind "book" first, and its files in reading order.
FILES = "name string, spine int, kind string, file string, title string, content string, data binary"
#: Bytes of the files of one reading task, about; and as how many more a file counts: opening and parsing a small one takes a millisecond or two, whatever its size.
PARTITION, FILE = 64 << 20, 64 << 10
#: Bytes of a file that is fetched at once, at most, and of what is collected before a file is written on.
HELD, BUFFER = 4 << 20, 256 << 10
_CHUNK, _ROWS = 1 << 16, 4096
#: Bytes of an entry from which on it is compressed: below, it isn't worth setting up the tables, twice.
DEFLATED = 1024
_REFERENCES = pa.schema([("package", pa.string()), ("source", pa.string()), ("ord", pa.int32()), ("href", pa.string()), ("title", pa.string())])

STYLE = "body { font-family: serif; margin: 1em; line-height: 1.6; }\nh1, h2 { text-align: center; }\np { margin: 0.3em 0; text-indent: 2em; }\n.intro p { text-indent: 0; }\n"
_COVERS = {"image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, from any machine: what Hadoop writes as file:/x is file:///x here."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


# Reading


@lru_cache(1024)
def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def _references(name: str, root: ElementTree.Element) -> Iterator[tuple[str, int, str, str]]:
    at = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(name), href.partition("#")[0]))
    if name.endswith("nav.xhtml"):
        links = [e for e in root.iter() if _name(e.tag) == "a" and e.get("href")]
        yield from (("nav", k, at(e.get("href")), _text(e)) for k, e in enumerate(links))
    elif name.endswith(".ncx"):
        for k, point in enumerate(e for e in root.iter() if _name(e.tag) == "navPoint"):
            label = next((_text(e) for e in point if _name(e.tag) == "navLabel"), "")
            target = next((e.get("src") for e in point if _name(e.tag) == "content"), "")
            if label and target:
                yield "ncx", k, at(target), label
    else:
        titles = [_text(e) for e in root.iter() if _name(e.tag) in ("title", "h1", "h2")]
        yield from (("document", k, name, t) for k, t in enumerate(titles))


def _read_through(entry: IO[bytes], parsed: bool) -> ElementTree.Element | None:
    """Reads an entry to its end, where its checksum is held against it, and gives its root if it is to be parsed."""
    parser = ElementTree.XMLParser() if parsed else None
    while chunk := entry.read(_CHUNK):
        if parser:
            parser.feed(chunk)
        if len(chunk) < _CHUNK:
            break
    return parser.close() if parser else None


def references(file: IO[bytes]) -> Iterator[tuple[str, int, str, str]]:
    """(source, ord, href, title) of everything that refers to a chapter: nav anchors, ncx points, and headings of documents.

    Every entry is read to its end, so that its checksum is known. What can't be read is a row of source error: the whole file if it isn't a zip,
    an entry that is damaged ("checksum") or isn't well-formed; the other entries count all the same. An ncx point has its own label and target, not those of the points inside it.
    """
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, OSError, ValueError) as e:  # a file too short to seek in is a ValueError
        yield "error", 0, "", f"not a package: {e}"
        return
    for name in archive.namelist():
        try:
            with archive.open(name) as entry:
                root = _read_through(entry, name.endswith((".xhtml", ".ncx")))
        except ElementTree.ParseError as e:
            yield "error", 0, name, str(e)
        except (zipfile.BadZipFile, OSError, ValueError, EOFError, NotImplementedError, RuntimeError, zlib.error) as e:
            yield "error", 0, name, "checksum" if "CRC" in str(e) else f"{type(e).__name__}: {e}"
        else:
            if root is not None:
                yield from _references(name, root)


def entries(file: IO[bytes]) -> Iterator[tuple[int, str, int, bytes]]:
    """(ord, name, n_bytes, content) of every entry."""
    archive = zipfile.ZipFile(file)
    for k, info in enumerate(archive.infolist()):
        yield k, info.filename, info.file_size, archive.read(info)


@dataclass
class _Files(InputPartition):
    folder: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.entries = options["path"], options.get("entries", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        system, inner = file_system(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=False)) if i.type == fs.FileType.File and i.path.endswith(".epub")]
        elif info.type == fs.FileType.File:
            found = [info]
        else:
            raise FileNotFoundError(self.path)
        folder = inner if info.type == fs.FileType.Directory else posixpath.dirname(inner)
        parts: list[_Files] = []
        size = PARTITION
        for name, n_bytes in sorted((i.base_name, i.size) for i in found):
            if size >= PARTITION:
                parts.append(_Files(folder, []))
                size = 0
            parts[-1].names.append(name)
            size += n_bytes + FILE
        return parts or [_Files(folder, [])]

    def _rows(self, partition: _Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for package in partition.names:
            with system.open_input_file(posixpath.join(partition.folder, package)) as file:
                whole = io.BytesIO(file.read()) if file.size() <= HELD else file
                for row in entries(whole) if self.entries else references(whole):
                    yield package, *row

    def read(self, partition: _Files) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        rows = self._rows(partition)
        if self.entries:
            return rows
        return (pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _REFERENCES, strict=True)], schema=_REFERENCES) for some in batched(rows, _ROWS))


# Writing


class _Package:
    """One EPUB as it is written: chapters as they come, what lists them at the end."""

    def __init__(self, system: fs.FileSystem, path: str, head: dict):
        self.stream = system.open_output_stream(path, buffer_size=BUFFER)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        self.head, self.files = head, []
        self._put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        self._put("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        self._put("OPS/style/main.css", STYLE)
        self.cover = None
        if head["data"]:
            self.cover = "cover" + _COVERS.get(head["cover_mime"], ".jpg")
            self._put(f"OPS/{self.cover}", head["data"], zipfile.ZIP_STORED)
        if head["intro"]:
            title = escape(head["intro_title"])
            page = f'<html xmlns="http://www.w3.org/1999/xhtml" lang={quoteattr(head["language"])}><head><title>{title}</title><link rel="stylesheet" type="text/css" href="style/main.css"/></head><body><div class="intro"><h1>{title}</h1>{head["intro"]}</div></body></html>'
            self.add("intro", "intro.xhtml", head["intro_title"], page)

    def _put(self, name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data, how if len(data) >= DEFLATED else zipfile.ZIP_STORED)

    def add(self, kind: str, file: str, title: str, content: str) -> None:
        self._put(f"OPS/{file}", content)
        self.files.append((kind, file, title))

    def _tree(self, one, many) -> str:
        """The files as a tree, in which a volume holds the chapters up to the next one."""
        out, inner, over = [], [], None
        for k, (kind, file, title) in enumerate([*self.files, ("volume", "", "")]):
            if kind == "volume":
                if over:
                    out.append(many(*over, "".join(inner)) if inner else one(*over))
                inner, over = [], (k, file, title)
            else:
                (inner if over and kind == "chapter" else out).append(one(k, file, title))
        return "".join(out)

    def close(self) -> None:
        head = self.head
        language, title = escape(head["language"]), escape(head["title"])
        author = f'<dc:creator>{escape(head["author"])}</dc:creator>' if head["author"] else ""
        items = "".join(f'<item id="f{k}" href={quoteattr(f)} media-type="application/xhtml+xml"/>' for k, (_, f, _) in enumerate(self.files))
        cover, meta = "", ""
        if self.cover:
            cover = f'<item id="cover" href="{self.cover}" media-type={quoteattr(head["cover_mime"])} properties="cover-image"/>'
            meta = '<meta name="cover" content="cover"/>'
        spine = "".join(f'<itemref idref="f{k}"/>' for k in range(len(self.files)))
        self._put(
            "OPS/content.opf",
            f'<package version="3.0" unique-identifier="id" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(head["identifier"])}</dc:identifier><dc:title>{title}</dc:title><dc:language>{language}</dc:language>{author}{meta}</metadata>'
            f'<manifest>{items}{cover}<item id="style" href="style/main.css" media-type="text/css"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{spine}</spine></package>',
        )
        link = lambda file, title: f"<a href={quoteattr(file)}>{escape(title)}</a>"
        links = self._tree(lambda _, f, t: f"<li>{link(f, t)}</li>", lambda _, f, t, inner: f"<li>{link(f, t)}<ol>{inner}</ol></li>")
        self._put("OPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        point = lambda k, f, t, inner="": f'<navPoint id="n{k}"><navLabel><text>{escape(t)}</text></navLabel><content src={quoteattr(f)}/>{inner}</navPoint>'
        self._put("OPS/toc.ncx", f'<ncx version="2005-1" xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content={quoteattr(head["identifier"])}/></head><docTitle><text>{title}</text></docTitle><navMap>{self._tree(point, point)}</navMap></ncx>')
        self.zip.close()
        self.stream.close()


@dataclass
class _Written(WriterCommitMessage):
    """Where a task's list of its packages lies, and how many they are."""

    listed: str
    n: int


_DEFAULTS = {"author": "", "language": "zh-CN", "identifier": "", "intro": "", "intro_title": "简介", "cover_mime": "image/jpeg"}


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("the epub sink adds packages to a folder; it doesn't clear one")
        self.folder = options["path"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = file_system(self.folder)
        system.create_dir(f"{inner}/{self.staging}", recursive=True)
        done: dict[str, str] = {}
        current, package = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != current:
                    if package:
                        package.close()
                    current = row["name"]
                    if current in done:
                        raise ValueError(f"the rows of {current} don't come together")
                    if current in ("", ".", "..") or "\0" in current or any(part in ("", ".", "..") for part in current.split("/")):
                        raise ValueError(f"not a name for a package: {current!r}")
                    head = _DEFAULTS | {"title": current, "data": None}
                    if row["kind"] == "book":
                        told = json.loads(row["content"] or "{}")
                        head |= {k: v for k, v in {**told, "title": row["title"], "data": row["data"]}.items() if v is not None}
                    staged = f"{inner}/{self.staging}/{uuid.uuid4().hex}.epub"
                    done[current] = staged
                    package = _Package(system, staged, head)
                if row["kind"] != "book":
                    package.add(row["kind"], row["file"], row["title"], row["content"])
        if package:
            package.close()
        listed = f"{inner}/{self.staging}/{uuid.uuid4().hex}.json"
        with system.open_output_stream(listed) as f:
            f.write(json.dumps(sorted(done)).encode())
        for folder in {posixpath.dirname(f"{inner}/{name}") for name in done}:
            system.create_dir(folder, recursive=True)
        for name, staged in done.items():
            system.move(staged, f"{inner}/{name}.epub")
        return _Written(listed, len(done))

    def _clear(self) -> None:
        system, inner = file_system(self.folder)
        if system.get_file_info(f"{inner}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staging}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = file_system(self.folder)
        self._clear()
        with system.open_output_stream(f"{inner}/_SUCCESS") as f:
            f.write(str(sum(m.n for m in messages if m)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Takes away what the finished tasks have written, and what lies half-written in the staging folder."""
        system, inner = file_system(self.folder)
        for m in messages:
            if m:
                with system.open_input_stream(m.listed) as f:
                    for name in json.loads(f.read()):
                        system.delete_file(f"{inner}/{name}.epub")
        self._clear()


class EpubSource(DataSource):
    """Reads REFERENCES, or with the option entries=true ENTRIES, of one package or of those that lie right in a folder, sorted; writes FILES."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return ENTRIES if self.options.get("entries", "false") == "true" else REFERENCES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EpubSource)
    return spark


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """REFERENCES of the packages in a folder, not of those in its subfolders, or of one package."""
    return registered(spark).read.format("epub").load(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """ENTRIES of the same. A package that isn't a zip is an error."""
    return registered(spark).read.format("epub").option("entries", "true").load(path)


def write_packages(files: DataFrame, folder: str) -> None:
    """FILES as `name`.epub in the folder, which other packages of other names may be in; one of the same name is replaced.

    A book's rows go to one task in their order and through it one by one, so its text is never held whole; other books go to other tasks.
    """
    registered(files.sparkSession)
    files.select(*(c.split()[0] for c in FILES.split(", "))).repartition("name").sortWithinPartitions("name", "spine").write.format("epub").mode("append").save(folder)
