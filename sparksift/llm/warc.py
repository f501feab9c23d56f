"""WARC archives compressed with Zstandard and a dictionary.

An archive is a skippable frame that holds the dictionary (magic 0x184D2A5D, the
dictionary raw or itself compressed), then one frame for each record.  The reader
takes the dictionary from the leading frame, decodes one frame a record, and
validates: version line, required headers, Content-Length against the block,
the blank lines after it, block and payload digests.

Archives are rows (archive, content) of bounded size, so Spark's own writers and
readers move them on any file system; files `*.warc.zst` of other makers are read
with `read_archives` from a binaryFile source.

Of records with equal payloads the one with the largest page_id is the response;
the others are revisits that name it and keep the HTTP headers (with the length of
the payload) as their block, as the revisit profile for equal digests has it.

Defined results: a null html is an empty payload; a null url gives an empty target;
a null page_id never is referred to (groups whose ids are all null are responses);
rows with the same page_id are separate records; an empty table gives no rows;
other columns are ignored.  Broken frames or records raise ValueError with the
archive's name, or become rows with `error` where strict is off.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Magic numbers of the frames.
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in one archive, about; a record larger than that has one of its own.
ARCHIVE_BYTES = 4 << 20
#: Bytes of one decoded record at most; a frame that yields more is refused, as a row can't hold 2 GiB.
LARGEST_RECORD = 1 << 30
#: What the dictionary is made of: the text that headers of all records share.
_SHARED = (
    "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: https://www.\r\n"
    "WARC-Page-ID: \r\nWARC-Payload-Digest: sha1:\r\nWARC-Block-Digest: sha1:\r\nWARC-Refers-To-Page-ID: \r\n"
    f"WARC-Profile: {_REVISIT}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: \r\n\r\n"
    "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: \r\n\r\n"
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title></title></head><body></body></html>\r\n\r\n'
).encode()
_DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\r\n]", "", url or "")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{target}:{payload_digest}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}"]
    lines += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_batch(records: Iterator[bytes], dictionary: bytes = _SHARED) -> bytes:
    """One archive: the dictionary's frame, then a frame for each record."""
    writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=True, write_content_size=True)
    return dictionary_frame(dictionary) + b"".join(writer.compress(r) for r in records)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    view, at, options = memoryview(content), 0, {}
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        options["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0] if at + 8 <= len(view) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        if magic != ZSTD_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one = reader.decompressobj()
        parts, step, size = [], 1 << 16, 0
        try:
            while not one.eof and at < len(view):
                parts.append(one.decompress(view[at : at + step]))
                at += min(step, len(view) - at)
                size += len(parts[-1])
                if size > LARGEST_RECORD:
                    raise ValueError(f"a record of more than {LARGEST_RECORD} bytes")
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame is broken: {e}") from e
        if not one.eof:
            raise ValueError("the last frame is cut short")
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Headers and block of a record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", first):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no header {name}")
    if not headers["content-length"].isdigit():
        raise ValueError(f"no length: {headers['content-length']!r}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block and its end have {len(rest)} bytes")
    block = rest[:size]
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise ValueError("the block has another digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http + b"\r")
    size = int(length[1]) if length else len(payload)
    if headers["warc-type"] == "response":
        if size != len(payload):
            raise ValueError(f"the HTTP length is {size}, the payload has {len(payload)} bytes")
        if (said := headers.get("warc-payload-digest")) and said != f"sha1:{digest(payload)}":
            raise ValueError("the payload has another digest")
    return {"headers": headers, "payload": payload, "payload_bytes": size}


_WRITTEN = pa.schema([("archive", pa.string()), ("content", pa.binary())])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        content = write_batch(iter(held))
        return C.as_batch(_WRITTEN, [[f"pages-{hashlib.sha1(content).hexdigest()[:16]}.warc.zst"], [content]])

    for batch in C.byte_slices(batches, "html"):
        for page_id, url, html, sha1, kind, refers in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            payload = (html or "").encode()
            held.append(record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), kind, refers))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


_READ = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _read(strict: bool, keep_payload: bool):
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            for data in frames(content):
                got = parse(data)
                h = got["headers"]
                if h["warc-type"] == "warcinfo":
                    continue
                number = lambda x: int(x) if x is not None else None
                said = h.get("warc-payload-digest", "").removeprefix("sha1:") or digest(got["payload"])
                yield name, number(h.get("warc-page-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to-page-id")), got["payload_bytes"], said, got["payload"] if keep_payload and h["warc-type"] == "response" else None, None
        except ValueError as e:
            if strict:
                raise ValueError(f"{name}: {e}") from e
            yield name, None, None, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    out.append(row)
                    size += len(row[7] or b"") + 200
                    if size >= C.CHUNK_BYTES:
                        yield C.as_batch(schema, [list(x) for x in zip(*out, strict=True)])
                        out, size = [], 0
                if out:
                    yield C.as_batch(schema, [list(x) for x in zip(*out, strict=True)])

    return run


def read_archives(archives: DataFrame, strict: bool = True, keep_payload: bool = True) -> DataFrame:
    """Records of archives given as (archive, content)."""
    spark = archives.sparkSession
    C.small_batches(spark, 500)
    return archives.select("archive", "content").mapInArrow(_read(strict, keep_payload), _READ)


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of *.warc.zst files under a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.zst").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), "content"), strict)


def classify(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with sha1 (hex), record_type and refers_to; the largest page_id of equal payloads is the response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    groups = C.stage(rows.groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1"), "payloads")
    joined = C.skew_join(rows, groups, "sha1", "n", rows.count(), "page_id")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content) rows, one bounded archive each, written to the shared folder."""
    C.small_batches(pages.sparkSession, 500)
    return C.stage(classify(pages).mapInArrow(_write, "archive string, content binary"), "warc")
