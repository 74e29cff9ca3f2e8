"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds a WARC file of gzipped records (``archive/data.warc.gz``) and
an index (``indexes/index.cdxj``: one line per record with its place in the
WARC file), both stored without ZIP compression.  The reader takes the ZIP
directory from the end of the file (ZIP64 where fields overflow), locates the
stored members by their local headers, and reads the indexes (CDXJ or CDX, plain or
gzipped) and then the records by range; records that no index lists are found
by reading on.  Nothing is unpacked to disk.

Tasks reach packages through ``pyarrow.fs`` (local, HDFS, S3, ...) in the
shared folder.  Each attempt writes under a name of its own, and only the
packages in the manifest, which Spark writes, are read; so a task that is lost
or run twice leaves no trace in the result.  A package is closed once it holds
``ROLL`` bytes, which bounds a task's memory (but for a larger single record).

Of records with equal payloads of at least ``least_revisit`` bytes, the one
with the largest page_id is a response; the others revisit it and carry no
payload.

Defined cases: null html is an empty payload; null page ids are below all
others, and where a group of equal payloads has no other, all are responses;
rows that repeat the largest id are responses too; a null url leaves the field
out; an empty table gives no packages; a very long page is one record, which a
task holds whole; other columns are ignored.  A package that holds another
number of records than the manifest says, an index that names no or several
archive members, a record cut off and a payload unlike its digest are errors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_batches, shared_folder, written
from quorum.operators.joins import bounded_broadcast
from quorum.sources.io import store

ROLL = 32 << 20        # bytes of gzipped records in a package
NEAR = 4 << 20         # bytes of neighbouring records read at once
CHUNK = 1 << 18        # bytes read at once where no index tells the records
DATE = "2000-01-01T00:00:00Z"  # date of records that have none
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ---------------------------------------------------------------- writing

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A gzipped response record, or, with ``refers_to``, a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)),
              ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def _key(url: str | None) -> str:
    """Sort key: host labels from the last, then the rest of the URL."""
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)(.*)", (url or "").lower(), re.DOTALL)
    return quote(",".join(reversed(m[1].split("."))) + ")" + m[2] if m else (url or "-"), safe=",)/?&=#")


class _Package:
    def __init__(self):
        self.records, self.lines = io.BytesIO(), []

    def add(self, page_id, url, payload, refers_to):
        data = record(page_id, url, payload, refers_to)
        entry = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "filename": ARCHIVE.split("/")[1],
                 "offset": self.records.tell(), "length": len(data)}
        self.lines.append(f"{_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
        self.records.write(data)

    def packed(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(ARCHIVE, self.records.getbuffer())
            z.writestr(INDEX, "".join(sorted(self.lines)))
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        return out.getvalue()


MANIFEST = "path string, n_records long"


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        stem, number, package = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, _Package()

        def close():
            name = f"{stem}-{number:04d}.wacz"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(package.packed())
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(package.lines)], pa.int64())],
                                              ["path", "n_records"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                package.add(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())
                if package.records.tell() >= roll:
                    yield close()
                    number, package = number + 1, _Package()
        if package.lines:
            yield close()
    return run


def write_packages(pages: DataFrame, least_revisit: int = 0, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages; the written manifest
    (path, n_records) names them."""
    payload = F.coalesce("html", F.lit(""))
    same = written(pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
                   .filter(F.col("size") >= least_revisit)
                   .groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
                   .select("sha", "largest"), "same")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha")).join(bounded_broadcast(same), "sha", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    folder = shared_folder(pages.sparkSession, "wacz")
    return written(in_batches(rows.select("page_id", "url", "html", refers.alias("refers_to")), _write(folder, roll), MANIFEST),
                   "manifest")


# ---------------------------------------------------------------- reading

class Member(NamedTuple):
    name: str
    method: int
    size: int      # bytes in the file
    header: int    # place of the local header


class PackageError(ValueError):
    pass


def directory(f: pa.NativeFile) -> list[Member]:
    """The members of a ZIP file, from its central directory."""
    size = f.size()
    start = max(0, size - (1 << 16) - 22)
    tail = f.read_at(size - start, start)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature may also stand in the comment
    if at < 0:
        raise PackageError("no end of central directory")
    many, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    if many == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        signature, _, place, _ = struct.unpack("<IIQI", f.read_at(20, end - 20))
        if signature != 0x07064B50:
            raise PackageError("no ZIP64 locator")
        record64 = f.read_at(56, place)
        if record64[:4] != b"PK\x06\x06":
            raise PackageError("no ZIP64 end of central directory")
        many, length, offset = struct.unpack_from("<QQQ", record64, 32)
        end = place
    shift = end - length - offset  # bytes that stand before the archive
    if shift < 0:
        raise PackageError("central directory out of place")
    raw, members, at = f.read_at(length, offset + shift), [], 0
    for _ in range(many):
        (signature, _, _, _, method, _, _, _, packed, plain, n, extra_n, comment_n, _, _, _,
         header) = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if signature != 0x02014B50:
            raise PackageError("bad central directory entry")
        name = raw[at + 46:at + 46 + n].decode("utf-8", "replace")
        extra, place = raw[at + 46 + n:at + 46 + n + extra_n], 0
        while place + 4 <= len(extra):
            tag, many_bytes = struct.unpack_from("<HH", extra, place)
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                values = iter(struct.unpack_from(f"<{many_bytes // 8}Q", extra, place + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            place += 4 + many_bytes
        members.append(Member(name, method, packed, header + shift))
        at += 46 + n + extra_n + comment_n
    return members


def data_place(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise PackageError(f"{member.name} is compressed, so its records cannot be read by range")
    head = f.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise PackageError(f"no local header for {member.name}")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + extra


def _lines(f: pa.NativeFile, member: Member) -> list[str]:
    raw = f.read_at(member.size, data_place(f, member))
    return (gzip.decompress(raw) if member.name.endswith(".gz") else raw).decode().splitlines()  # all gzip members of it


def index_entries(f: pa.NativeFile, members: list[Member]) -> Iterator[tuple[str, int, int]]:
    """(WARC file, offset, length) of every record that an index lists: lines of
    CDXJ, or of CDX with its header, plain or gzipped."""
    for m in members:
        if not (m.name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", m.name)):
            continue
        places = None
        for line in _lines(f, m):
            if line.startswith(" CDX"):
                letters = line.split()[1:]
                places = [letters.index(x) for x in "gVS"]  # file, offset, length of the compressed record
            elif places:
                fields = line.split()
                yield fields[places[0]], int(fields[places[1]]), int(fields[places[2]])
            elif line.strip() and not line.startswith("!"):
                entry = json.loads(line.split(" ", 2)[2])
                yield entry["filename"], int(entry["offset"]), int(entry["length"])


def _archive(name: str, archives: list[Member]) -> Member:
    """The archive member that an index names by its path or the end of it."""
    found = [m for m in archives if m.name == name] or [m for m in archives if m.name.endswith("/" + name)]
    if len(found) != 1:
        raise PackageError(f"{len(found)} archive members are named {name}")
    return found[0]


def _scan(f: pa.NativeFile, at: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that lie in [at, stop), one after the other, found by reading on."""
    held = b""

    def more() -> bytes:
        nonlocal at
        if at >= stop:
            raise PackageError("a record is cut off")
        got = f.read_at(min(CHUNK, stop - at), at)
        at += len(got)
        return got
    while held or at < stop:
        held = held or more()
        if held[:1] == b"\x1f":
            unpack = zlib.decompressobj(31)
            parts = [unpack.decompress(held)]
            while not unpack.eof:
                parts.append(unpack.decompress(more()))
            held = unpack.unused_data
            yield parse_record(b"".join(parts))
        elif held[:1] in b"\r\n":
            held = held.lstrip(b"\r\n")
        else:
            while b"\r\n\r\n" not in held:
                held += more()
            fields, _ = parse_record(held)
            size = held.index(b"\r\n\r\n") + 4 + int(fields["content-length"])
            while len(held) < size:
                held += more()
            yield parse_record(held[:size])
            held = held[size:]


def records(f: pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record, in the order of the WARC files: those
    that an index lists by range, neighbours in one read, and what lies
    between them, or in a file without an index, by reading on."""
    members = directory(f)
    archives = [m for m in members if m.name.startswith("archive/") and m.size]
    listed: dict[str, set[tuple[int, int]]] = {m.name: set() for m in archives}
    for name, offset, length in index_entries(f, members):
        listed[_archive(name, archives).name].add((offset, length))
    for m in archives:
        spans, base, done, i = sorted(listed[m.name]), data_place(f, m), 0, 0
        while i < len(spans):
            j, first = i, spans[i][0]
            if first > done:
                yield from _scan(f, base + done, base + first)
            while j + 1 < len(spans) and spans[j + 1][0] == sum(spans[j]) and sum(spans[j + 1]) - first <= NEAR:
                j += 1
            done = sum(spans[j])
            data = f.read_at(done - first, base + first)
            for at, length in spans[i:j + 1]:
                raw = data[at - first:at - first + length]
                yield parse_record(zlib.decompress(raw, 31) if raw[:1] == b"\x1f" else raw)
            i = j + 1
        if done < m.size:
            yield from _scan(f, base + done, base + m.size)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise PackageError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[:int(fields["content-length"])]


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url string, payload binary")


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = store(path)
                rows, held, found = [], 0, 0
                with fs.open_input_file(inner) as f:
                    for fields, block in records(f):
                        found += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                            raise PackageError(f"payload of {fields['warc-record-id']} does not match its digest")
                        rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"],
                                     _page(fields["warc-refers-to"]) if revisit else None,
                                     fields.get("warc-target-uri"), payload if with_payload and not revisit else None))
                        held += len(payload) if with_payload else 100
                        if held >= NEAR:
                            yield out(rows)
                            rows, held = [], 0
                if expected is not None and found != expected:
                    raise PackageError(f"{found} records in {path}, {expected} expected")
                if rows:
                    yield out(rows)
    return run


def read_packages(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """``READ``'s columns of every record in the packages that ``manifest``
    (path, and n_records if it is known) names; payload is null for revisits and
    without ``with_payload``."""
    packages = max(1, manifest.count())  # a task each: a package is what one task can well read
    many = F.col("n_records") if "n_records" in manifest.columns else F.lit(None)
    return in_batches(manifest.select("path", many.cast("long").alias("n_records")).repartition(packages), _read(with_payload), READ)
