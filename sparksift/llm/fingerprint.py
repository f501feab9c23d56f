"""Document fingerprints: a digest of bucket quartiles.

The byte triplets of a text (each three neighbours, and each three with one byte
skipped before the last) are hashed and counted in BUCKETS buckets.  The digest
holds, in hex, a checksum byte, the length class, the ratios of the quartiles of
the counts, and for each bucket in which quarter its count lies (2 bits).

Two digests differ by the sum over buckets of the distance of their quarters
(0, 1, 2, and 6 for opposite ends), plus what lengths, ratios and checksums
differ by, bounded by BOUND; likeness is 1 - difference / BOUND, 0 to 1.

Neighbours are found without a global window: documents are dealt out by ranges
of doc_id, and each range sorts and streams its rows.  Only the last document of a
range lacks its next one, so each range also hands out its first and last text,
and these meet range by range in a second, small step.

Defined results: a null text counts as empty; texts without triplets have all
buckets in the lowest quarter; a null doc_id sorts first; rows with the same
doc_id follow each other by the hash of the text, then the text; a single row is its own next document; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 256
#: The largest difference that counts.
BOUND = 300
_LENGTH_STEP = np.log(1.25)
_QUARTER_GAP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)


def _counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts of each text, a row of BUCKETS each."""
    n = len(texts)
    out = np.zeros(n * BUCKETS, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for span, last in ((3, 2), (4, 3)):
        if len(data) < span:
            continue
        size = len(data) - span + 1
        triplet = data[:size] | (data[1 : 1 + size] << np.uint32(8)) | (data[last : last + size] << np.uint32(16))
        with np.errstate(over="ignore"):
            triplet = (triplet ^ np.uint32(span << 24)) * np.uint32(0x9E3779B1)
            triplet ^= triplet >> np.uint32(15)
            bucket = ((triplet * np.uint32(0x85EBCA77)) >> np.uint32(24)).astype(np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), lengths)[:size]
        inside = np.ones(size, bool)
        for back in range(1, span):  # triplets that run over the end of their text
            at = begin[1:] - back
            at = at[(at >= 0) & (at < size)]
            inside[at] = False
        # a text shorter than the span has none; its start may lie before the marked places
        inside &= (np.arange(size) + span) <= (begin + lengths)[owner]
        out += np.bincount((owner * BUCKETS + bucket)[inside], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """Digest of each text as bytes: checksum, length class, ratios, quarters."""
    counts = _counts(texts)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * i // 4 - 1] for i in (1, 2, 3))
    quarter = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    packed = quarter[:, 0::4] | (quarter[:, 1::4] << 2) | (quarter[:, 2::4] << 4) | (quarter[:, 3::4] << 6)
    top = np.maximum(q3, 1)
    ratios = ((q1 * 100 // top) % 16) | (((q2 * 100 // top) % 16) << 4)
    lengths = np.fromiter(map(len, texts), np.float64, len(texts))
    classes = np.minimum(np.round(np.log1p(lengths) / _LENGTH_STEP), 255)
    sums = np.fromiter((zlib.crc32(t) & 0xFF for t in texts), np.uint8, len(texts))
    return np.concatenate([sums[:, None], classes.astype(np.uint8)[:, None], ratios.astype(np.uint8)[:, None], packed.astype(np.uint8)], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of digests, row by row."""
    x, y = a[:, 3:], b[:, 3:]
    total = np.zeros(len(a), np.int64)
    for shift in (0, 2, 4, 6):
        total += _QUARTER_GAP[(x >> shift) & 3, (y >> shift) & 3].sum(1)
    far = np.abs(a[:, 1].astype(np.int64) - b[:, 1])
    total += np.where(far <= 1, far, 6 * (far - 1))
    for shift in (0, 4):
        gap = np.abs(((a[:, 2] >> shift) & 15).astype(np.int64) - ((b[:, 2] >> shift) & 15))
        gap = np.minimum(gap, 16 - gap)
        total += np.where(gap <= 1, gap, 4 * (gap - 1))
    total += a[:, 0] != b[:, 0]
    return np.minimum(total, BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points gives way to the start of the following text."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    raw = [x.encode() for x in changed]
    own, other, after = digests([x.encode() for x in texts]), digests(raw), digests([x.encode() for x in following])
    return C.as_batch(_OUT, [ids, [len(x) for x in texts], [hashlib.sha256(x).hexdigest() for x in raw], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in other], likeness(own, other), likeness(own, after)])


_OPEN = pa.schema([*_OUT, ("range", pa.int32()), ("first", pa.string()), ("last", pa.string())])


def _columns(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int64': 'long', 'int32': 'int'}).get(str(f.type), str(f.type))}" for f in schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a range but the last; then a row with the first text and the last document."""
    waiting: list[tuple] = []  # (id, text, next text)
    size, first, last = 0, None, None

    def out() -> pa.RecordBatch:
        made = _compare(*map(list, zip(*waiting, strict=True)))
        return pa.RecordBatch.from_arrays([*made.columns, *(pa.nulls(made.num_rows, f.type) for f in list(_OPEN)[-3:])], schema=_OPEN)

    for batch in C.byte_slices(batches, "text"):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if last is None:
                first = text
            else:
                waiting.append((*last, text))
                size += len(last[1])
            last = (key, text)
        if size >= C.CHUNK_BYTES // 4:
            yield out()
            waiting, size = [], 0
    if waiting:
        yield out()
    if last is not None:
        at = TaskContext.get().partitionId()
        yield C.as_batch(_OPEN, [[last[0]], [None], [None], [None], [None], [None], [None], [at], [first], [last[1]]])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last documents of ranges, with the first texts of the next ones."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield _compare(*([batch.column(c)[i].as_py()] for c in range(3)))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how near the edited text and the next document are."""
    spark = docs.sparkSession
    C.small_batches(spark, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))]
    dealt = rows.repartitionByRange(ranges or C.partitions(rows, "text"), *order).sortWithinPartitions(*order, "text")
    staged = C.stage(dealt.mapInArrow(_stream, _columns(_OPEN)), "fingerprints")
    done = staged.where("range is null").select(*_OUT.names)
    # numbers of the ranges that have rows: as many as there are tasks
    held = sorted(r["range"] for r in staged.where("range is not null").select("range").collect())
    if not held:
        return done
    after = spark.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "range int, after int")
    open_ = staged.where("range is not null")
    following = open_.select(F.col("range").alias("after"), F.col("first").alias("following"))
    met = open_.select("range", "doc_id", "last").join(after, "range").join(following, "after").select("doc_id", "last", "following")
    return done.unionByName(met.mapInArrow(_close, _columns(_OUT)))
