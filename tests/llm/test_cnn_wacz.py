"""Byte CNN and WACZ packages."""
import base64
import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quorum.llm import byte_cnn, wacz


def test_cnn_gradients():
    net = byte_cnn.ByteCNN()
    net.bias = np.float32(0.1)
    text, label = "some text of bytes é " * 60, 1
    grad = np.zeros(net.tables.shape, np.float64)
    net._gradients(text, label, 1.0, grad)
    hit = np.argwhere(np.abs(grad) > 1e-3)

    def loss():
        return -np.log(net.score(text))
    for k, b, f in hit[:: max(1, len(hit) // 12)]:
        keep, step = net.tables[k, b, f], 2e-3
        net.tables[k, b, f] = keep + step
        up = loss()
        net.tables[k, b, f] = keep - step
        down = loss()
        net.tables[k, b, f] = keep
        assert abs((up - down) / (2 * step) - grad[k, b, f]) < 0.05 * max(0.05, abs(grad[k, b, f]))


def test_cnn_spans_cover_whole_text(monkeypatch):
    net = byte_cnn.ByteCNN()
    text = "".join(chr(97 + i * i % 26) for i in range(9000)) + "#$%&" * 5
    whole = net.score(text)
    monkeypatch.setattr(byte_cnn, "SPAN", 3)
    assert abs(net.score(text) - whole) < 1e-9
    assert net.score(text) != net.score(text[:-20])


def test_cnn_rows(spark):
    rows = [(i, ("good prose here. " if i % 2 else "b@d $$ ## ") * 9, "x", 1.0) for i in range(60)]
    rows += [(None, "good prose here.", "x", None), (70, None, "x", None), (71, "", "x", None), (1, "good prose here. " * 9, "x", None),
             (72, "good prose here. " * 40000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    marks = [(i, i % 2) for i in range(60)] + [(1, 1), (3, None), (None, 1), (999, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = byte_cnn.score(docs, byte_cnn.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    seen = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert all(r.predicted == r.doc_id % 2 for r in seen)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in byte_cnn.score(docs, byte_cnn.train(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in byte_cnn.score(docs, byte_cnn.train(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert byte_cnn.score(docs.limit(0), byte_cnn.ByteCNN()).count() == 0


def test_cnn_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = byte_cnn.score(docs, byte_cnn.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for a in good] for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.92


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("least, roll", [(0, 1 << 20), (7, 200)])
def test_packages_brute_force(spark, least, roll):
    rows = [(1, "http://a.com/x", "<p>one"), (2, "http://a.com/y?ü\r\n", "<p>one"), (3, None, None), (4, "", ""), (9, "u", "tiny"), (8, "u", "tiny"),
            (5, "http://b.org", "é" * 200000), (6, "http://b.org", "é" * 200000), (None, "n", "<p>one"), (None, "n", "only null"),
            (None, "n", "only null"), (2, "again", "<p>one"), (-3, "m", "x\r\n\r\ny\x00")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, sha string, largest int").repartition(3)
    manifest = wacz.write_packages(pages, least, roll)
    got = wacz.read_packages(manifest).collect()
    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "").encode() == raw and p is not None), default=None)
        revisit = len(raw) >= least and best is not None and (page is None or page < best)
        want.append((page, len(raw), digest(raw), "revisit" if revisit else "response", best if revisit else None, None if revisit else raw))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or
                    (None if r.record_type == "revisit" else b"")) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    empty = wacz.write_packages(pages.limit(0), least)
    assert empty.count() == 0 and wacz.read_packages(empty).count() == 0


def package(method=zipfile.ZIP_STORED):
    data = [wacz.record(i, f"http://a/{i}", f"page {i}".encode(), None) for i in range(5)]
    lines, at = "", 0
    for i, d in enumerate(data):
        lines += f'a)/{i} 2000 {{"filename": "data.warc.gz", "offset": "{at}", "length": "{len(d)}"}}\n'
        at += len(d)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr(wacz.ARCHIVE, b"".join(data))
        z.writestr(wacz.INDEX, lines)
        z.comment = b"a comment with PK\x05\x06 inside, long enough to mislead"
    return out.getvalue()


def zip64(raw):
    """The same archive with every size and place moved to ZIP64 fields."""
    at = raw.rindex(b"PK\x05\x06", 0, raw.index(b"a comment"))
    many, length, offset = struct.unpack_from("<HII", raw, at + 10)
    entries, place, out = raw[offset:offset + length], 0, b""
    for _ in range(many):
        f = list(struct.unpack_from("<IHHHHHHIIIHHHHHII", entries, place))
        name = entries[place + 46:place + 46 + f[10]]
        extra = struct.pack("<HH3Q", 1, 24, f[9], f[8], f[16])
        place += 46 + f[10] + f[11] + f[12]
        f[8] = f[9] = f[16] = 0xFFFFFFFF
        f[11], f[12] = len(extra) + 4, 0
        out += struct.pack("<IHHHHHHIIIHHHHHII", *f) + name + struct.pack("<HH", 0x9999, 0) + extra
    end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, many, many, len(out), offset)
    locator = struct.pack("<IIQI", 0x07064B50, 0, offset + len(out), 1)
    return raw[:offset] + out + end + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


@pytest.mark.parametrize("change", [lambda x: x, zip64, lambda x: b"#!stub\n" + x])
def test_zip_directories(change):
    f = pa.BufferReader(change(package()))
    assert [m.name for m in wacz.directory(f)] == ["pages/pages.jsonl", wacz.ARCHIVE, wacz.INDEX]
    got = [(fields["warc-record-id"], block.partition(b"\r\n\r\n")[2]) for fields, block in wacz.records(f)]
    assert got == [(f"<urn:page:{i}>", f"page {i}".encode()) for i in range(5)]


def test_zip_errors():
    with pytest.raises(wacz.PackageError):
        list(wacz.records(pa.BufferReader(package(zipfile.ZIP_DEFLATED))))
    with pytest.raises(wacz.PackageError):
        wacz.directory(pa.BufferReader(b"no archive"))
    assert gzip.decompress(wacz.record(1, None, b"", None)).startswith(b"WARC/1.1\r\n")


def parts(n=5, plain=False):
    data = [wacz.record(i, f"http://a/{i}", f"page {i}".encode() * 500, None) for i in range(n)]
    return [gzip.decompress(d) for d in data] if plain else data


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return pa.BufferReader(out.getvalue())


def listing(name, data, kind="cdxj", only=None):
    at, lines = 0, [" CDX N b a m s k r M S V g"] if kind == "cdx" else ["!meta {}"]
    for i, d in enumerate(data):
        if only is None or i in only:
            lines.append(f"k 2000 http://a/{i} text/html 200 x - - {len(d)} {at} {name}" if kind == "cdx"
                         else f'k 2000 {{"filename": "{name}", "offset": "{at}", "length": "{len(d)}"}}')
        at += len(d)
    return ("\n".join(lines) + "\n").encode()


def pages_in(f):
    return [int(fields["warc-record-id"][10:-1]) for fields, _ in wacz.records(f)]


@pytest.mark.parametrize("plain", [False, True])
def test_indexes_of_other_writers(plain):
    data, name = parts(plain=plain), "archive/data.warc"
    whole = b"".join(data)
    halves = gzip.compress(listing("data.warc", data[:2])) + gzip.compress(listing("data.warc", data)[len(listing("data.warc", data[:2])):])
    for index in ({"indexes/index.cdx.gz": gzip.compress(listing("data.warc", data, "cdx"))}, {"indexes/index.cdxj.gz": halves},
                  {"indexes/index.cdx": listing(name, data, "cdx")}, {}, {"indexes/index.cdxj": listing("data.warc", data, only={1, 3})},
                  {"indexes/a.cdxj": listing("data.warc", data), "indexes/b.cdxj": listing("data.warc", data)}):
        assert pages_in(packed({name: whole, **index})) == [0, 1, 2, 3, 4]


def test_archives_of_equal_names():
    data = parts(6)
    files = {"archive/a/x.warc.gz": b"".join(data[:3]), "archive/b/x.warc.gz": b"".join(data[3:])}
    assert pages_in(packed(files)) == list(range(6))
    index = listing("archive/b/x.warc.gz", data[3:]) + listing("a/x.warc.gz", data[:3])
    assert pages_in(packed({**files, "indexes/i.cdxj": index})) == list(range(6))
    with pytest.raises(wacz.PackageError):
        pages_in(packed({**files, "indexes/i.cdxj": listing("x.warc.gz", data[:3])}))
    with pytest.raises(wacz.PackageError):
        pages_in(packed({"archive/x.warc.gz": b"".join(data)[:-30]}))


def test_records_that_are_missing(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(9)], "page_id long, url string, html string")
    manifest = wacz.write_packages(pages)
    assert wacz.read_packages(manifest).count() == 9 and wacz.read_packages(manifest.select("path")).count() == 9
    from pyspark.sql import functions as F
    with pytest.raises(Exception, match="expected"):
        wacz.read_packages(manifest.withColumn("n_records", F.col("n_records") + 1)).count()


def test_training_is_bounded_in_bytes(spark, monkeypatch):
    texts = [(i, ("good words here. " if i % 2 else "##$ %% ") * (5 + i)) for i in range(60)] + [(100, "x" * (2 << 20))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(byte_cnn.ByteCNN, "fit", lambda self, t, y, share: seen.append(sum(map(len, t))) or self)
    byte_cnn.train(docs, labels)
    whole = seen[-1]
    assert whole < 1 << 20
    monkeypatch.setattr(byte_cnn, "SAMPLE_BYTES", whole // 3)
    byte_cnn.train(docs, labels)
    assert 0 < seen[-1] < whole * 0.7


def test_scores_by_plain_convolution():
    """A score against loops over filters, places and chunks."""
    model = byte_cnn.ByteCNN(3)
    for text in ("", "é", "short text", "words " * 200):
        raw = list(text.encode()) + [0] * (byte_cnn.WIDTH - 1 + (not text))
        places = len(raw) - byte_cnn.WIDTH + 1
        out = [[sum(model.tables[k][raw[p + k]][f] for k in range(byte_cnn.WIDTH)) for f in range(byte_cnn.FILTERS)] for p in range(places)]
        blocks = [[max(out[p][f] for p in range(at, min(at + byte_cnn.BLOCK, places))) for f in range(byte_cnn.FILTERS)] for at in range(0, places, byte_cnn.BLOCK)]
        starts = range(0, max(1, len(blocks) - byte_cnn.CHUNK + byte_cnn.STRIDE), byte_cnn.STRIDE)
        chunks = [[max(0.0, *(blocks[min(s + k, len(blocks) - 1)][f] for k in range(byte_cnn.CHUNK))) for f in range(byte_cnn.FILTERS)] for s in starts]
        z = model.bias + sum(model.out[f] * sum(c[f] for c in chunks) / len(chunks) + model.out[byte_cnn.FILTERS + f] * max(c[f] for c in chunks)
                             for f in range(byte_cnn.FILTERS))
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-4
