"""WARC archives compressed by Zstandard, one frame for each record.

File layout: a skippable frame (magic 0x184D2A5D) that holds the dictionary,
then one Zstandard frame for each record, compressed with that dictionary.
The first frame may be absent; the records' frames then use no dictionary.

Records: ``response`` (an HTTP head, then the payload) and ``revisit`` (the HTTP
head alone; its Content-Length still tells the full payload's length).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.shared import fresh_dir, local_or_remote, table, written

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

READ_BYTES = 1 << 16


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One whole record. ``refers_to`` makes it a revisit of that page's response."""
    digest = sha1_base32(payload)
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if page_id is not None:
        lines.append(("X-Page-Id", str(page_id)))
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    lines.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one decoded frame; WarcError if anything doesn't fit."""
    if not data.startswith(VERSION + b"\r\n"):
        raise WarcError(f"not a {VERSION.decode()} record: {data[:20]!r}")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the headers don't end")
    headers: dict[str, str] = {}
    for line in data[len(VERSION) + 2 : end].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line!r}")
        if name in headers:
            raise WarcError(f"header {name} twice")
        headers[name] = value.strip()
    if missing := [x for x in MANDATORY if x not in headers]:
        raise WarcError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdecimal():
        raise WarcError(f"bad Content-Length {headers['Content-Length']!r}")
    length, start = int(headers["Content-Length"]), end + 4
    if len(data) != start + length + 4 or data[start + length :] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(data) - start - 4} bytes, Content-Length is {length}")
    block = data[start : start + length]
    if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block digest differs")
    return headers, block


def parse_http(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(length of the full payload, payload or None for a revisit), checked."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/"):
        raise WarcError("the block has no HTTP head")
    found = re.search(rb"(?mi)^content-length:[ \t]*(\d+)\r?$", block[: end + 2])
    if not found:
        raise WarcError("the HTTP head has no Content-Length")
    length, body = int(found[1]), block[end + 4 :]
    if headers["WARC-Type"] == "revisit":
        if body or not headers.get("WARC-Refers-To"):
            raise WarcError("a revisit has a body, or refers to nothing")
        return length, None
    if len(body) != length:
        raise WarcError(f"the payload has {len(body)} bytes, HTTP says {length}")
    if headers.get("WARC-Payload-Digest") != f"sha1:{sha1_base32(body)}":
        raise WarcError("the payload digest differs")
    return length, body


def train_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where the samples are too few to train one."""
    if size <= 0 or sum(map(len, samples)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def write_archive(out, records: Iterable[bytes], *, dictionary_bytes: int = 16384, sample_bytes: int = 4 << 20, level: int = 3) -> tuple[int, int]:
    """Writes frames to ``out``; returns (records, bytes).

    The dictionary is trained on the first records, at most ``sample_bytes`` of
    them; it only changes how well the archive is compressed.
    """
    source, first, held = iter(records), [], 0
    for x in source:
        first.append(x)
        held += len(x)
        if held >= sample_bytes:
            break
    dictionary, size, n = train_dictionary(first, dictionary_bytes), 0, 0
    if dictionary is not None:
        frame = dictionary.as_bytes()
        size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame))) + out.write(frame)
    pack = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for part in (first, source):
        for x in part:
            size += out.write(pack.compress(x))
            n += 1
    return n, size


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise WarcError("the file ends in the middle of a frame")
    return data


def read_frames(source) -> Iterator[bytes]:
    """The decoded frames of a file object, one at a time."""
    start, dictionary = source.read(8), None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_MAGIC:
        raw = _exactly(source, struct.unpack("<I", start[4:])[0])
        if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == ZSTD_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
        start = b""
    unpack, held = zstandard.ZstdDecompressor(dict_data=dictionary), start
    while True:
        held = held or source.read(READ_BYTES)
        if not held:
            return
        frame, parts = unpack.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = source.read(READ_BYTES)
                if not held:
                    raise WarcError("the file ends in the middle of a frame")
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        yield b"".join(parts)


def read_archive(source) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers, length of the full payload, payload) of each record, checked."""
    for data in read_frames(source):
        headers, block = parse_record(data)
        yield headers, *parse_http(headers, block)


MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_refers_to(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest page_id with an equal payload, null for that page itself.

    Payloads are matched by SHA-256. Only hash and id are shuffled to find the
    smallest; that side has one row for each payload, so a payload that a third
    of the pages share is a skewed join that adaptive execution can split.
    Null ids count as larger than any id and are never referred to.
    """
    keyed = pages.withColumn("_key", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    firsts = keyed.groupBy("_key").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.where("_n > 1 and _first is not null").select("_key", "_first")
    same = keyed.join(firsts, "_key", "left")
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))
    return same.withColumn("refers_to", F.when(long & other, F.col("_first"))).drop("_key", "_first")


def write_warc(pages: DataFrame, to: str, *, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", dictionary_bytes: int = 16384) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives under the shared folder ``to``.

    Returns the manifest: path, records and bytes of each archive. Each task
    attempt writes a file of its own name and moves it in place when whole; the
    manifest names the files of the attempts that Spark accepted, so a lost
    executor leaves at most a file that nobody reads. Null html is an empty
    payload, null url a ``urn:page:`` one; a payload of any length is one record;
    ties and repeated rows as in ``with_refers_to``; no pages make no archive;
    extra columns are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    yield build_record(page_id, url, (html or "").encode("utf-8"), refers_to, date)

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.zst"
        store, folder = local_or_remote(to)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/.{name}") as out:
            n, size = write_archive(out, records(), dictionary_bytes=dictionary_bytes)
        if n:
            store.move(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{name}"], "n_records": [n], "n_bytes": [size]})
        else:
            store.delete_file(f"{folder}/.{name}")

    rows = with_refers_to(pages.select("page_id", "url", "html"), min_bytes).select("page_id", "url", "html", "refers_to")
    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(spark: SparkSession, manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` names, each archive read by one task as a stream.

    Every header, length and digest is checked; a broken archive, or one with
    another number of records than the manifest says, fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        schema = pa.schema(fields)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                store, name = local_or_remote(path)
                rows, held, n = [], 0, 0
                with store.open_input_stream(name) as source:
                    for headers, length, payload in read_archive(source):
                        n += 1
                        held += len(payload or b"") * payloads + 300
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, headers.get("WARC-Target-URI"), headers["WARC-Type"], int(refers) if refers else None, length, headers["WARC-Payload-Digest"].removeprefix("sha1:"), payload if payloads else None))
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
                            rows, held = [], 0
                if n != expected:
                    raise WarcError(f"{os.path.basename(path)} has {n} records, the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path", "n_records").repartition(n).mapInArrow(read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to WARC archives and back; a row for each page.

    Null html is an empty payload and null page_id stays null. Payloads of any
    length are one record each, held in memory one at a time. Of equal payloads
    the smallest page_id is the response; rows that repeat both id and payload
    of a response are responses too. No pages: no archives and no rows. Other
    columns than page_id, url and html, whatever their names, are left out.
    """
    manifest = write_warc(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_warc(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
