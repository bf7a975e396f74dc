import base64
import hashlib
import io
import struct

import pytest
import zstandard

from reliefspark.llm import warc
from reliefspark.llm.shared import fresh_dir


def expected(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in rows:
        p = (h or "").encode()
        to = first.get(h or "") if len(p) >= least else None
        to = None if to == i else to
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


PAGES = "page_id long, url string, html string, path string, n_records long"


@pytest.mark.parametrize("least", [0, 4])
def test_pages_come_back(spark, least):
    rows = [(3, "abc"), (1, "abc"), (2, None), (4, ""), (5, "h" * 300_000), (6, "h" * 300_000), (None, "abc"), (None, "alone"), (7, "é\r\n\r\nWARC/1.1"), (8, "abcd"), (9, "abcd"), (9, "abcd")]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/é {i}\r\n", h, "p", 1) for i, h in rows], PAGES)
    manifest = warc.write_warc(pages, fresh_dir(spark, "t"), min_bytes=least)
    found = warc.read_warc(spark, manifest).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)
    assert got == expected(rows, least)
    texts = dict(rows)
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in found if r.record_type == "response" and r.page_id is not None)


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = [tuple(r)[:5] for r in warc.op1_warc(spark, sf).collect()]
    assert sorted(got, key=str) == expected([tuple(r) for r in pages])


def test_no_pages(spark):
    manifest = warc.write_warc(spark.createDataFrame([], PAGES), fresh_dir(spark, "t"))
    assert warc.read_warc(spark, manifest).count() == 0


def archive(n=40, **how):
    out = io.BytesIO()
    records = [warc.build_record(i, f"http://a/{i}", f"<html>{i} some words that come again {'x' * i}</html>".encode() * 20, None, "2020-01-01T00:00:00Z") for i in range(n)]
    warc.write_archive(out, iter(records), **how)
    return out.getvalue()


@pytest.mark.parametrize("dictionary_bytes", [0, 1024])
def test_frames(dictionary_bytes):
    data = archive(dictionary_bytes=dictionary_bytes)
    assert (struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC) == bool(dictionary_bytes)
    assert [int(h["X-Page-Id"]) for h, _, _ in warc.read_archive(io.BytesIO(data))] == list(range(40))


def test_compressed_dictionary():
    data = archive(dictionary_bytes=1024)
    n = struct.unpack("<I", data[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + n])
    data = data[:4] + struct.pack("<I", len(packed)) + packed + data[8 + n :]
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 40


def test_broken_archives():
    data = archive(dictionary_bytes=1024)
    for bad in (data[:-5], data[: len(data) // 2] + b"\0" + data[len(data) // 2 + 1 :], data[:30], data + b"junk and more"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"X-Date"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"<html>", b"<HTML>"), (b"WARC-Type: response", b"WARC-Type response"), (b"HTTP/1.1", b"HTTQ/1.1")])
def test_broken_records(change):
    record = warc.build_record(1, "http://a/", b"<html>x</html>", None, "2020-01-01T00:00:00Z")
    assert change[0] in record
    with pytest.raises(warc.WarcError):
        warc.parse_http(*warc.parse_record(record.replace(*change)))
