"""Web archives: exact round trips, and packages of other writers."""

import base64
import hashlib
import io
import json
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import warc

PAGES = "page_id long, url string, html string"


def digests_by_hand(rows):
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    most = {}
    for i, p in payloads:
        if i is not None:
            most[p] = max(most.get(p, i), i)
    out = []
    for i, p in payloads:
        again = len(p) >= 1000 and p in most and i != most[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", most[p] if again else None))
    return sorted(out, key=repr)


def digests_by_operator(df):
    return sorted(map(tuple, warc.round_trip(df).collect()), key=repr)


LONG = "é" * 499 + "ab"  # 1000 bytes
AWKWARD = [
    (1, "http://a/", LONG), (2, "http://a/ b\r\nWARC-Type: x", LONG), (3, None, LONG), (3, "http://c/?q=%20", LONG), (None, "http://d/", LONG),
    (4, "", "é" * 499 + "a"), (5, "http://日本/", "é" * 499 + "a"), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "PK\x05\x06" * 400), (9, "u", "x" * 3_000_000),
    (None, "v", "y" * 2000), (None, "v", "y" * 2000), (-1, "w", "z" * 1000), (10, "w", "z" * 1000),
]


def test_archives_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert digests_by_operator(df) == digests_by_hand(map(tuple, df.select("page_id", "url", "html").collect()))


def test_archives_of_awkward_rows(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, PAGES).repartition(4)
    clashing = df.withColumns({c: F.lit("x") for c in "payload size content of first least digest to path problem record_type".split()})
    assert digests_by_operator(df) == digests_by_operator(clashing) == digests_by_hand(AWKWARD)
    assert digests_by_operator(df.limit(0)) == []
    packages = warc.write_archives(df, f"file://{tmp_path}/packages", package=300)
    assert packages.count() > 4 and packages.agg(F.sum("n_records")).first()[0] == len(AWKWARD)
    rows = warc.read_archives(packages, run=100).collect()
    assert [r.problem for r in rows if r.problem] == []
    assert sorted(((r.page_id, r.url) for r in rows if r.page_id), key=repr) == sorted(((i, u) for i, u, _ in AWKWARD if i), key=repr)
    assert all(r.payload.decode() == (dict((i, h) for i, _, h in AWKWARD)[r.page_id] or "") for r in rows if r.page_id and r.record_type == "response")


def test_revisits_of_a_third_of_all_pages(spark):
    rng = random.Random(3)
    rows = [(i, f"u{i}", "hot " * 300 if i % 3 == 0 else "few " * 300 + str(i % 50) if i % 3 == 1 else str(rng.random()) * 80) for i in range(3000)]
    assert digests_by_operator(spark.createDataFrame(rows, PAGES).repartition(6)) == digests_by_hand(rows)


def package(records, name="archive/a.warc.gz", index=True, before=b"", comment=b"", pack=None, **more):
    out = io.BytesIO()
    places, data = [], b""
    for i, r in enumerate(records):
        raw = (pack or (lambda x: zlib.compressobj(6, zlib.DEFLATED, 31)))(r)
        raw = raw if isinstance(raw, bytes) else raw.compress(r) + raw.flush()
        places.append({"filename": name.split("/")[1], "offset": str(len(data)), "length": str(len(raw))})
        data += raw
    with zipfile.ZipFile(out, "w", **more) as z:
        z.comment = comment
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        with z.open(name, "w", force_zip64=True) as f:
            f.write(data)
        if index:
            z.writestr("indexes/index.cdx", "".join(f"com,a)/ 2020 {json.dumps(p)}\n" for p in reversed(places)), zipfile.ZIP_STORED)
    return before + out.getvalue()


def wide(raw):
    """The same package with all ones where ZIP64's end of the directory says more."""
    at = raw.rindex(b"PK\5\6")
    entries, length, start = struct.unpack_from("<HII", raw, at + 10)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, length, start)
    return raw[:at] + end + struct.pack("<4sIQI", b"PK\6\7", 0, at, 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nabout\r\n\r\n"
FOREIGN = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nContent-Length: 23\r\n\r\nHTTP/1.0 200 OK\r\n\r\nbody\r\n\r\n"
OURS = zlib.decompress(warc.record(4, "http://y/", b"page", 4, hashlib.sha1(b"page").hexdigest(), None), 31)


@pytest.mark.parametrize(
    "raw",
    [
        package([INFO, FOREIGN, OURS]),
        package([INFO, FOREIGN, OURS], index=False),
        package([INFO, FOREIGN, OURS], name="archive/a.warc", pack=bytes),
        package([INFO, FOREIGN, OURS], name="archive/a.warc", pack=bytes, index=False),
        package([INFO, FOREIGN, OURS], before=b"#!/bin/sh\n" * 9, comment=b"PK\5\6 in a comment"),
        wide(package([INFO, FOREIGN, OURS])),
    ],
)
def test_packages_of_other_writers(spark, tmp_path, raw):
    (tmp_path / "a.wacz").write_bytes(raw)
    rows = warc.read_archives(spark.createDataFrame([(f"file:{tmp_path}/a.wacz",)], "path string")).collect()
    assert sorted((r.page_id or 0, r.url, r.payload, r.problem) for r in rows) == [(0, "http://x/", b"body", None), (4, "http://y/", b"page", None)]


def test_damage_is_told(spark, tmp_path):
    good = package([FOREIGN, OURS])
    bad = OURS.replace(b"page\r\n\r\n", b"pages\r\n\r\n"[:4] + b"\r\n\r\n").replace(b"\r\n\r\npage", b"\r\n\r\npaGe")
    files = {
        "empty": b"", "cut": good[: len(good) // 2], "text": b"PK\5\6" * 9, "digest": package([bad, OURS]), "short": package([OURS[:-8]]), "packed": package([OURS], compression=zipfile.ZIP_DEFLATED),
        "garbled": package([FOREIGN, OURS], index=False, pack=lambda r: zlib.compress(r, wbits=31)[:-9] + b"x"), "no64": wide(good).replace(b"PK\6\7", b"PK\0\0"),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    paths = [(f"file://{tmp_path}/{n}",) for n in [*files, "missing"]] + [(None,)]
    rows = warc.read_archives(spark.createDataFrame(paths, "path string")).collect()
    told = {n: [r.problem for r in rows if r.problem and (f"/{n}:" in r.problem or f"/{n} " in r.problem)] for n in [*files, "missing"]}
    assert all(len(told[n]) == 1 for n in ("empty", "cut", "text", "packed", "garbled", "no64", "missing")), told
    assert sorted(r.problem for r in rows if r.problem and "/" not in r.problem) == ["digest differs", "record is cut short"]
    assert sum(r.problem is None for r in rows) == 1  # the sound record beside the altered one


def test_written_packages_are_what_other_tools_read(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 200) for i in range(20)]
    [one] = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/p").collect()
    path = one.path.removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and [i.compress_type for i in z.infolist()] == [zipfile.ZIP_STORED] * 2
        data = z.read("archive/data.warc.gz")
        for line, (i, url, html) in zip(z.read("indexes/index.cdxj").decode().splitlines(), rows, strict=True):
            place = json.loads(line.split(" ", 2)[2])
            record = zlib.decompress(data[place["offset"] : place["offset"] + place["length"]], 31)
            assert record.endswith(html.encode() + b"\r\n\r\n") and f"WARC-Target-URI: {url}\r\n".encode() in record
            assert base64.b32encode(hashlib.sha1(html.encode()).digest()) in record
