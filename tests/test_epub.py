"""Packages written by the sink and read again by the source."""

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from vellum.operators import publish, validate
from vellum.sources import epub, packages

CHAPTERS = "book long, vid long, cid long, volume string, chapter string, texts array<string>"
ROWS = [(7, 1, 1, "卷一", "第一章 a", ["x & y", "z"]), (7, 1, 2, "卷一", "第二章 <b>", ["w"]), (7, 2, 1, "卷二", "第三章 c", ["v"]), (8, 1, 1, "", "第1章", ["one"]), (9, 1, 1, "V", "第5章", ["long " * 20_000])]
BOOKS = "book long, name string, title string, identifier string, author string, intro string, cover binary, cover_mime string"
NAMED = [(7, "a", "T & t", "id-7", "A < B", "<p>Of it.</p>", b"\x89PNG", "image/png"), (8, "sub/b", "U", None, None, None, None, None), (9, "日本 c", "V", "id-9", "", "", None, "image/gif"), (10, "none", "No chapters", "id", None, None, b"", None)]


@pytest.fixture(scope="module")
def manifest(spark):
    return publish.manifest(spark.createDataFrame(ROWS, CHAPTERS)).cache()


@pytest.fixture(scope="module")
def folder(spark, manifest, tmp_path_factory):
    folder = tmp_path_factory.mktemp("epub")
    packages.write_books(manifest, spark.createDataFrame(NAMED, BOOKS), f"file://{folder}")
    return folder


def test_entries_are_the_manifest(spark, manifest, folder):
    """What is read back is, byte for byte and in order, what the manifest says, and nothing half-written is left."""
    assert sorted(p.name for p in folder.iterdir()) == sorted(["a.epub", "none.epub", "日本 c.epub", "sub", "_SUCCESS"]) and (folder / "_SUCCESS").read_text() == "4"
    rows = epub.read_entries(spark, f"file://{folder}").union(epub.read_entries(spark, f"file://{folder}/sub/b.epub")).where(F.col("name").rlike("/(chap|vol)_")).collect()
    names = {f"{n.rsplit('/')[-1]}.epub": b for b, n, *_ in NAMED}
    got = sorted((names[r.package], r.ord, r.name.removeprefix("OPS/"), r.content.decode()) for r in rows)
    want = sorted((r.book, r.spine, r.file, r.content) for r in manifest.collect())
    assert [(b, n, c) for b, _, n, c in got] == [(b, n, c) for b, _, n, c in want]


def test_a_package_has_all_that_readers_want(folder):
    with zipfile.ZipFile(folder / "a.epub") as z:
        assert z.testzip() is None and z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert z.read("OPS/cover.png") == b"\x89PNG" and b"<p>Of it.</p>" in z.read("OPS/intro.xhtml") and b"text-indent" in z.read("OPS/style/main.css")
        opf = ElementTree.fromstring(z.read("OPS/content.opf"))
        told = {e.tag.rpartition("}")[2]: e.text for e in opf.iter() if "purl.org" in e.tag}
        assert told == {"identifier": "id-7", "title": "T & t", "language": "zh-CN", "creator": "A < B"}
        listed = {e.get("id"): e.get("href") for e in opf.iter() if e.tag.endswith("}item")}
        assert {f"OPS/{h}" for h in listed.values()} == {n for n in z.namelist() if n.startswith("OPS/")} - {"OPS/content.opf"}
        spine = [listed[e.get("idref")] for e in opf.iter() if e.tag.endswith("}itemref")]
        assert spine == ["intro.xhtml", "vol_01.xhtml", "chap_01_001.xhtml", "chap_01_002.xhtml", "vol_02.xhtml", "chap_02_001.xhtml"]
        depth = lambda e, n=0: [(n, c.get("href")) for c in e if c.tag.endswith("}a")] + [x for c in e for x in depth(c, n + c.tag.endswith("}ol"))]
        assert depth(ElementTree.fromstring(z.read("OPS/nav.xhtml"))) == [(1, "intro.xhtml"), (1, "vol_01.xhtml"), (2, "chap_01_001.xhtml"), (2, "chap_01_002.xhtml"), (1, "vol_02.xhtml"), (2, "chap_02_001.xhtml")]


def test_references_agree(spark, folder):
    refs = packages.read_packages(spark, f"file://{folder}").cache()
    assert refs.where("source = 'error'").count() == 0 and {r.package for r in refs.collect()} == {"a.epub", "日本 c.epub"}  # none.epub refers to nothing, and subfolders aren't read
    one = refs.where("package = 'a.epub' AND number IS NOT NULL")
    assert [(r.source, r.number) for r in one.where("source <> 'document'").orderBy("source", "ord").collect()] == [(s, n) for s in ("nav", "ncx") for n in (1, 2, 3)]
    assert validate.package_issues(refs).count() == 0


def test_damage_is_issues(spark, folder, tmp_path):
    good = (folder / "a.epub").read_bytes()
    cut_entry = bytearray(good)
    with zipfile.ZipFile(io.BytesIO(good)) as z:
        cut_entry[z.getinfo("OPS/chap_01_002.xhtml").header_offset + 60] ^= 255
    for name, raw in {"cut": good[:-30], "none": b"", "text": b"not a zip", "entry": bytes(cut_entry), "good": good}.items():
        (tmp_path / f"{name}.epub").write_bytes(raw)
    (tmp_path / "left.txt").write_text("out")
    issues = validate.package_issues(packages.read_packages(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.package, r.detail) for r in issues if r.kind == "damaged" and not r.href) == [(f"{n}.epub", "not a package") for n in ("cut", "none", "text")]
    of_entry = {(r.kind, r.href) for r in issues if r.package == "entry.epub"}
    assert of_entry == {("damaged", "OPS/chap_01_002.xhtml"), ("missing document", "OPS/chap_01_002.xhtml")}
    assert not [r for r in issues if r.package == "good.epub"]
    with pytest.raises(Exception, match="missing"):
        epub.read_references(spark, f"file://{tmp_path}/missing").collect()
    (tmp_path / "empty").mkdir()
    assert epub.read_references(spark, f"file://{tmp_path}/empty").count() == 0


def test_a_failed_job_leaves_nothing(spark, manifest, tmp_path):
    """One book fails late; the books that other tasks have finished go, too, and what was there before stays."""
    (tmp_path / "old.epub").write_bytes(b"old")
    books = spark.createDataFrame([(7, "a", "T"), (8, "b", "U"), (9, "../up", "V")], "book long, name string, title string").withColumn("identifier", F.lit("i"))
    with pytest.raises(Exception, match="not a name"):
        packages.write_books(manifest, books, f"file://{tmp_path}")
    assert [p.name for p in tmp_path.rglob("*")] == ["old.epub"] and not (tmp_path.parent / "up.epub").exists()


def test_an_attempt_that_dies_leaves_no_package(tmp_path):
    """A writer that is stopped between two batches has only staged files; a second attempt writes the whole package."""
    import pyarrow as pa

    names = [c.split()[0] for c in epub.FILES.split(", ")]
    head = dict.fromkeys(names) | {"name": "x", "spine": -1, "kind": "book", "title": "X", "content": json.dumps({"identifier": "i"})}
    chapter = dict.fromkeys(names) | {"name": "x", "spine": 1, "kind": "chapter", "file": "c.xhtml", "title": "C", "content": "<html/>"}
    schema = pa.schema([(n, pa.int32() if n == "spine" else pa.binary() if n == "data" else pa.string()) for n in names])
    batch = lambda *rows: pa.RecordBatch.from_pylist(list(rows), schema)
    writer = epub._Writer({"path": f"file://{tmp_path}"}, False)

    def dying():
        yield batch(head, chapter)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    assert not list(tmp_path.glob("*.epub"))
    message = writer.write(iter([batch(head), batch(chapter)]))
    writer.commit([message])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "x.epub"]
    with pytest.raises(ValueError, match="come together"):
        writer.write(iter([batch(head, head | {"name": "y"}, chapter)]))
    with pytest.raises(ValueError, match="clear"):
        epub._Writer({"path": "file:///tmp/x"}, True)


def test_checks_read_packages_once(spark, sf_dir):
    """The checks go over references that were landed; none of their sides opens the packages again."""
    from vellum.plans import books

    for query in (books.package_issues, books.package_totals):
        assert "epub" not in query(spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).replace(".epub", "")


def test_small_packages_are_dealt_by_number(tmp_path):
    """Opening a package is work whatever its size: thousands of tiny ones are several tasks, each with every name once."""
    for k in range(3000):
        (tmp_path / f"{k}.epub").write_bytes(b"")
    parts = epub._Reader({"path": f"file://{tmp_path}"}).partitions()
    assert len(parts) >= 3 and max(len(p.names) for p in parts) <= 1024
    assert sorted(n for p in parts for n in p.names) == sorted(f"{k}.epub" for k in range(3000))


def test_large_packages_are_read_in_place(spark, tmp_path, monkeypatch):
    """A package of more than is fetched at once gives the same rows as one that is."""
    head = dict.fromkeys(c.split()[0] for c in epub.FILES.split(", ")) | {"name": "x", "spine": -1, "kind": "book", "title": "X", "content": "{}"}
    chapter = head | {"spine": 1, "kind": "chapter", "file": "c.xhtml", "title": "第1章", "content": "<html><h1>第1章</h1></html>"}
    epub.write_packages(spark.createDataFrame([head, chapter], epub.FILES), f"file://{tmp_path}")
    reader = epub._Reader({"path": f"file://{tmp_path}"})
    rows = lambda: [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    small = rows()
    monkeypatch.setattr(epub, "HELD", 0)
    assert rows() == small and {r["source"] for r in small} == {"nav", "ncx", "document"}
