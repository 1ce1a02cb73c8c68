"""Web archives in ZIP packages: written from pages, read by ranges through their directories and indexes.

A package holds `archive/data.warc.gz`, every record a gzip member of its own, and `indexes/index.cdxj`, a line a record with its place. Both
are stored, not compressed again, so a record is a range of the package's bytes. The reader parses the package's central directory (of
ZIP64 too), finds the members' data through their local headers, and deals the index's ranges over tasks, which read and
inflate just those. Nothing is extracted and no package is read whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import new_folder
from .common import stored

#: Payloads with fewer bytes are never revisits.
LEAST = 1000
#: Bytes of a package, about; bytes that are read at a time, about; bytes of records for each reading task, at most.
PACKAGE, RUN, PARTITION = 256 << 20, 4 << 20, 128 << 20
#: The tables hold no time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_WRITTEN = "path string, size long, n_records long"
_RUNS = "path string, start long, lengths array<long>, stop long, problem string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string"
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])
_RUN_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64())), ("stop", pa.int64()), ("problem", pa.string())])


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, from any machine: what Hadoop writes as file:/x is file:///x here."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Hadoop reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


# Records


def _identifier(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: tuple[int, str | None] | None) -> bytes:
    """A response, or where first (page_id, url) is given, a revisit of that page without the payload, as one gzip member.

    What a field can't hold of a URL (control characters) is escaped, and the URL itself then follows as JSON.
    """
    fields = {"WARC-Type": "revisit" if first else "response", "WARC-Record-ID": _identifier(page_id, url, digest), "WARC-Date": DATE}

    def located(name: str, extra: str, url: str | None) -> None:
        if url is not None:
            fields[name] = re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url)
            if fields[name] != url:
                fields[extra] = json.dumps(url)

    located("WARC-Target-URI", "Page-Url", url)
    if first:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _identifier(*first, digest), "WARC-Refers-To-Date": DATE, "Refers-To-Page-Id": str(first[0])}
        located("WARC-Refers-To-Target-URI", "Refers-To-Page-Url", first[1])
    if page_id is not None:
        fields["Page-Id"] = str(page_id)
    fields |= {"WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type": "application/http; msgtype=response"}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if first else payload)
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode("utf-8", "surrogatepass")) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines) if v}


def parsed(raw: bytes) -> dict | None:
    """A row of RECORDS from one record; None for records that hold no page (warcinfo, requests, metadata).

    A record whose length or digest isn't what its head says has a problem.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        return dict.fromkeys(_RECORD_SCHEMA.names) | {"problem": "not a record"}
    fields = _fields(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    method, _, told = fields.get("warc-payload-digest", "").partition(":")
    row = {
        "page_id": int(fields["page-id"]) if "page-id" in fields else None,
        "url": json.loads(fields["page-url"]) if "page-url" in fields else fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None,
    }
    told = base64.b32decode(told).hex() if method == "sha1" else None
    if kind == "revisit":
        size = _fields(http).get("content-length")
        return row | {"payload": None, "payload_bytes": None if size is None else int(size), "payload_digest": told, "problem": None}
    digest = hashlib.sha1(payload).hexdigest()
    problem = "record is cut short" if len(block) < int(fields["content-length"]) else "digest differs" if told not in (None, digest) else None
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "problem": problem}


# Writing


class _Package:
    """One package as it is written, from first byte to last."""

    def __init__(self, folder: str):
        system, inner = _file_system(folder)
        name = f"{uuid.uuid4().hex}.wacz"  # an attempt that is run again writes other files
        system.create_dir(inner, recursive=True)
        self.path = f"{folder}/{name}"
        self.stream = system.open_output_stream(f"{inner}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, raw: bytes, page_id: int | None, digest: str) -> None:
        self.data.write(raw)
        place = {"filename": "data.warc.gz", "offset": self.at, "length": len(raw), "digest": f"sha1:{digest}"}
        self.index.append(f"{'-' if page_id is None else page_id} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}\n")
        self.at += len(raw)

    def close(self) -> dict:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as f:
            for line in self.index:
                f.write(line.encode())
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return {"path": self.path, "size": size, "n_records": len(self.index)}


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, package: int = PACKAGE) -> DataFrame:
    """(path, size, n_records): the packages that hold a record for every row of pages(page_id, url, html), in a new folder of the shared one unless one is given.

    A payload is the html in UTF-8; a null is empty. Of rows with equal payloads of `least` bytes or more, that with the largest page_id is a
    response and the others revisit it; rows that share that page_id are all responses, as are rows that share a payload and have no page_id at all.
    All other rows are responses. An empty table gives no packages. Other columns are not read.

    Files have made-up names, and only those that the table lists count: it is stored by a job that commits its tasks, so a task that is lost or run
    twice leaves files that nothing names. Payloads are hashed first, without them being shuffled; the rows then meet the table of repeated payloads.
    """
    folder = _qualified(pages.sparkSession, folder or new_folder(pages.sparkSession, "archives"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "content": F.sha2("payload", 256)})
    same = rows.where(F.col("size") >= least).groupBy(F.col("content").alias("of"))
    known = same.agg(F.max(F.struct("page_id", "url")).alias("first"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("least"))
    known = stored(known.where("first.page_id IS NOT NULL AND least < first.page_id").drop("least"), "repeated")
    rows = rows.withColumn("digest", F.sha1("payload")).join(known, F.col("content") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first.page_id")).alias("to"), F.when(revisit, F.col("first.url")).alias("to_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, body, size, digest, to, to_url = (c[i].as_py() for c in batch.columns)
                current = current or _Package(folder)
                current.add(record(page_id, url, body, size, digest, None if to is None else (to, to_url)), page_id, digest)
                if current.at >= package:
                    done, current = current.close(), None
                    yield pa.RecordBatch.from_pylist([done])
        if current:
            yield pa.RecordBatch.from_pylist([current.close()])

    return stored(rows.mapInArrow(write, _WRITTEN), "packages")


# Reading


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # where the local header begins


class Damaged(ValueError):
    """A package that can't be read, and why."""


_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_ALL32 = 0xFFFFFFFF


def _range(file: pa.NativeFile, start: int, length: int) -> bytes:
    file.seek(start)
    raw = file.read(length)
    if len(raw) < length:
        raise Damaged(f"ends before byte {start + length}")
    return raw


def _directory_place(file: pa.NativeFile, size: int) -> tuple[int, int, int, int]:
    """Where the central directory begins, its bytes and entries, and what is to be added to all places (bytes before the package)."""
    tail = _range(file, max(0, size - 65557), min(size, 65557))
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at + 3)  # that mark stands in the comment
    if at < 0:
        raise Damaged("no end of central directory")
    end = size - len(tail) + at
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail[at - 20 : at] if at >= 20 else b""
    if locator[:4] == _LOCATOR:
        # ZIP64: the places of the older record may be all ones.
        (place,) = struct.unpack_from("<Q", locator, 8)
        found = next((p for p in (place, end - 20 - 56) if 0 <= p <= size - 56 and _range(file, p, 4) == _END64), None)
        if found is None:
            raise Damaged("no ZIP64 end of central directory")
        entries, length, start = struct.unpack("<QQQ", _range(file, found, 56)[32:56])
        end = found
    elif _ALL32 in (length, start):
        raise Damaged("no ZIP64 locator")
    before = end - length - start
    if before < 0:
        raise Damaged("central directory overlaps its end")
    return start + before, length, entries, before


def directory(file: pa.NativeFile, size: int) -> Iterator[Member]:
    """The members of a package, from its central directory, which is read a piece at a time."""
    start, length, entries, before = _directory_place(file, size)
    raw, at, left = b"", 0, length
    for _ in range(entries):
        while True:
            need = 46 if len(raw) - at < 46 else 46 + sum(struct.unpack_from("<HHH", raw, at + 28))
            if len(raw) - at >= need:
                break
            if not left:
                raise Damaged("central directory is cut short")
            piece = _range(file, start + length - left, min(left, 1 << 20))
            raw, at, left = raw[at:] + piece, 0, left - len(piece)
        mark, _, flags, method, _, packed, full, n_name, n_extra, _, _, header = struct.unpack_from("<4sIHHIxxxxIIHHHI4xI", raw, at)
        if mark != _ENTRY:
            raise Damaged("not an entry of a central directory")
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = [n for n, x in (("full", full), ("packed", packed), ("header", header)) if x == _ALL32]
        while len(extra) >= 4 and wide:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: those of the three that are all ones, in this order
                if n < 8 * len(wide):
                    raise Damaged("ZIP64 field is cut short")
                values = dict(zip(wide, struct.unpack_from(f"<{len(wide)}Q", extra, 4), strict=True))
                packed, header, wide = values.get("packed", packed), values.get("header", header), []
            extra = extra[4 + n :]
        if flags & 1:
            raise Damaged(f"{name} is encrypted")
        yield Member(name, method, packed, header + before)
        at += need


def data_of(file: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin: its local header may be longer than what the directory says."""
    if member.method:
        raise Damaged(f"{member.name} is compressed")
    raw = _range(file, member.header, 30)
    if raw[:4] != _LOCAL:
        raise Damaged(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", raw, 26))


def _lines(file: pa.NativeFile, start: int, size: int) -> Iterator[bytes]:
    rest = b""
    for at in range(0, size, 1 << 20):
        *lines, rest = (rest + _range(file, start + at, min(1 << 20, size - at))).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _runs_of(path: str, run: int) -> Iterator[dict]:
    """The neighbouring records of a package that are read at once; a member that no index lists is one run without lengths."""
    system, inner = _file_system(path)
    with system.open_input_file(inner) as file:
        members = {m.name: m for m in directory(file, file.size())}
        archives = {n.removeprefix("archive/"): m for n, m in members.items() if re.fullmatch(r"archive/.*\.warc(\.gz)?", n)}
        places: dict[str, list[tuple[int, int]]] = {}
        for name, member in members.items():
            if re.fullmatch(r"indexes/.*\.cdxj?", name):
                for line in _lines(file, data_of(file, member), member.size):
                    told = json.loads(line[line.index(b"{") :])
                    places.setdefault(told["filename"], []).append((int(told["offset"]), int(told["length"])))
        if lost := sorted(set(places) - set(archives)):
            raise Damaged(f"no archive {lost[0]}")
        for name, member in archives.items():
            start = data_of(file, member)
            if name not in places:
                yield {"path": path, "start": start, "lengths": None, "stop": start + member.size}
                continue
            begin = end = None
            lengths: list[int] = []
            for offset, length in sorted(set(places[name])):
                if offset + length > member.size:
                    raise Damaged(f"index leads beyond {name}")
                if lengths and (offset != end or end - begin >= run):
                    yield {"path": path, "start": start + begin, "lengths": lengths, "stop": start + end}
                    lengths = []
                begin, end = offset if not lengths else begin, offset + length
                lengths.append(length)
            if lengths:
                yield {"path": path, "start": start + begin, "lengths": lengths, "stop": start + end}


def _inflated(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def _scanned(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """The records of a member without an index, one after the other: gzip members, or plain records by their lengths."""
    held, at, inflate, out = b"", start, None, []
    while at < stop or held:
        if not held:
            held = _range(file, at, min(RUN, stop - at))
            at += len(held)
        if inflate is None and held[:1] == b"W":
            while b"\r\n\r\n" not in held and at < stop:
                piece = _range(file, at, min(RUN, stop - at))
                held, at = held + piece, at + len(piece)
            head = held[: held.index(b"\r\n\r\n") + 4] if b"\r\n\r\n" in held else held
            length = len(head) + int(_fields(head).get("content-length", 0)) + 4
            if length > len(held) and at < stop:
                piece = _range(file, at, min(length - len(held), stop - at))
                held, at = held + piece, at + len(piece)
            yield held[:length]
            held = held[length:]
            continue
        inflate = inflate or zlib.decompressobj(31)
        out.append(inflate.decompress(held))
        held = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = None, []
        elif at >= stop:
            raise Damaged("record is cut short")


def read_archives(packages: DataFrame, run: int = RUN) -> DataFrame:
    """RECORDS: a row for each response and revisit in packages(path); other records are passed over.

    The payload is that of a response, null for a revisit; a revisit's bytes and digest are what its head says of the payload. A
    record that isn't what its head says, and a package or a part of one that can't be read, is a row with a problem; of a package without a directory
    that is the only row. Members without an index are read from end to end, by one task each; compressed members can't be read by ranges and are a
    problem. Repeated paths are read once. An empty table gives no rows. Other columns than path, and size if there is one, are not read.
    """
    spark: SparkSession = packages.sparkSession
    paths = packages.where("path IS NOT NULL")
    size = paths.agg(F.sum("size")).first()[0] if "size" in paths.columns else None
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / PARTITION))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                try:
                    for x in _runs_of(path, run):
                        found.append(x | {"problem": None})
                except (OSError, ValueError, KeyError, struct.error) as e:
                    found.append({"path": path, "start": None, "lengths": None, "stop": None, "problem": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(found, _RUN_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                held, size = [], 0
                for row in _records_of(x):
                    held.append(row)
                    size += len(row["payload"] or b"") + 100
                    if size > RUN:
                        yield pa.RecordBatch.from_pylist(held, _RECORD_SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORD_SCHEMA)

    runs = paths.select("path").distinct().repartition(parts, "path").mapInArrow(locate, _RUNS)
    # Two shuffles of names and numbers only, so that packages and then their runs are dealt over all tasks.
    return runs.repartition(parts, "path", "start").mapInArrow(read, RECORDS)


def _records_of(run: dict) -> Iterator[dict]:
    if run["problem"]:
        yield dict.fromkeys(_RECORD_SCHEMA.names) | {"problem": f"{run['path']}: {run['problem']}"}
        return
    try:
        system, inner = _file_system(run["path"])
        with system.open_input_file(inner) as file:
            if run["lengths"] is None:
                raws = _scanned(file, run["start"], run["stop"])
            else:
                raw, at, cuts = _range(file, run["start"], run["stop"] - run["start"]), 0, []
                for n in run["lengths"]:
                    cuts.append((at, at + n))
                    at += n
                raws = (_inflated(raw[a:b]) for a, b in cuts)
            for x in raws:
                row = parsed(x)
                if row:
                    yield row
    except (OSError, ValueError, KeyError, zlib.error) as e:
        yield dict.fromkeys(_RECORD_SCHEMA.names) | {"problem": f"{run['path']} at {run['start']}: {type(e).__name__}: {e}"}


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as its record in the written packages says."""
    records = read_archives(write_archives(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
