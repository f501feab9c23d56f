"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted
over the corpus; repeated windows merge into maximal removal intervals.

A window is `k` consecutive words of one document.  A word goes if a window that
covers it has a word sequence that also starts in a document with a smaller
doc_id; all windows are judged on the input, so the first document keeps its copy.

Plan
  1. map: hash all windows of a slice of documents.  Of equal windows in a slice
     only those of the smallest doc_id go on; the others are decided on the spot.
     What goes on is packed by hash bucket (7 bytes a window), so a window that a
     third of all documents hold is a few entries a slice, not a hot key.
  2. shuffle by bucket; each task sorts its bucket's hashes and finds those held
     by several doc_ids.  Buckets grow in number with the text, not in size.
  3. what a bucket finds is packed by groups of documents, gathered to one row a
     document, and joined to the texts (one shuffle of them), where windows become
     intervals and the intervals are merged.
The identity of a window is 56 bits plus its bucket, from two independent
hashes: the odds that a window is mistaken stay near 1e-10 at any input size, as
the buckets grow with it.

Defined results: a null or empty text has no words; texts shorter than `k` words
lose none; documents with a null doc_id neither lose words nor take any; rows
with the same doc_id count as one document; an empty table gives no rows; other
columns pass through, and columns that this operator adds replace equal names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words in a window when nothing else is asked for.
WINDOW = 13
_POWERS = (C.Powers(0xC2B2AE3D27D4EB4F), C.Powers(0x165667B19E3779F9))
_SLICE_BYTES = 4 << 20
_BUCKET_BYTES = 8 << 20
_PACKED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
_FOUND = pa.schema([("pack", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
_MERGED = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])
_REST = np.uint64((1 << 56) - 1)


def _window_hashes(words: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(56-bit hash, bucket) of each run of k words."""
    first = C.mix(C.windows(words, k, _POWERS[0])) & _REST
    bucket = C.mix(C.windows(words, k, _POWERS[1])) % np.uint64(buckets)
    return first, bucket.astype(np.int64)


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.view("<u8").ravel()


def _rows(bucket: np.ndarray, docs: np.ndarray, hashes: np.ndarray, decided: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows, one for each bucket; the entries come sorted by document."""
    if not len(hashes):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, docs, hashes = bucket[order], docs[order], hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    out = []
    for low, high in zip(starts, [*starts[1:], len(bucket)], strict=True):
        own, counts = _runs(docs[low:high])
        out.append((int(bucket[low]) if not decided else -1 - int(bucket[low]), own.tobytes(), counts.astype(np.uint32).tobytes(), _pack(hashes[low:high])))
    for low in range(0, len(out), 64):
        yield C.as_batch(_PACKED, [list(x) for x in zip(*out[low : low + 64], strict=True)])


def _runs(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[starts], np.diff(np.concatenate([starts, [len(docs)]]))


def _map(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            docs, hashes, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(docs, kind="stable")
            docs, hashes, bucket = docs[order], hashes[order], bucket[order]
            order = np.argsort(hashes, kind="stable")  # equal hashes stay in doc_id order
            h, d = hashes[order], docs[order]
            head = np.concatenate([[True], h[1:] != h[:-1]])
            least = d[np.flatnonzero(head)[np.cumsum(head) - 1]]
            twin = np.concatenate([[False], (h[1:] == h[:-1]) & (d[1:] == d[:-1])])
            for take, decided in (((d == least) & ~twin, False), ((d != least) & ~twin, True)):
                chosen = np.sort(order[take])
                yield from _rows(bucket[chosen], docs[chosen], hashes[chosen], decided)

        for batch in C.byte_slices(batches, "text"):
            batch = batch.filter(pc.is_valid(batch.column(0)))
            texts = C.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, offsets = C.batch_words(texts)
            if len(words) >= k and len(ids):
                at, owner = C.doc_windows(offsets, k)
                h, b = _window_hashes(words, k, buckets)
                held.append((ids[owner], h[at], b[at]))
                size += sum(map(len, texts))
            if size >= _SLICE_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _packs(docs: np.ndarray, hashes: np.ndarray, packs: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of found hashes, one for each group of documents."""
    group = (C.mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(packs)).astype(np.int64)
    order = np.lexsort((docs, group))
    group, docs, hashes = group[order], docs[order], hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    out = []
    for low, high in zip(starts, [*starts[1:], len(group)], strict=True):
        own, counts = _runs(docs[low:high])
        out.append((int(group[low]), own.tobytes(), counts.astype(np.uint32).tobytes(), _pack(hashes[low:high])))
    for low in range(0, len(out), 64):
        yield C.as_batch(_FOUND, [list(x) for x in zip(*out[low : low + 64], strict=True)])


def _entries(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    docs = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)) for d, c, _ in rows])
    return docs, np.concatenate([_unpack(h) for *_, h in rows])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, bytes, bytes]]]]:
    """The rows of each value of the first column; the batches come sorted by it."""
    now, held = None, []
    for batch in batches:
        for key, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(tuple(row))
    if held:
        yield now, held


def _reduce(packs: int):
    """Of each bucket, the hashes that a document with a smaller doc_id also has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_key(batches):
            docs, hashes = _entries(rows)
            if bucket >= 0:  # else it was decided in the map task
                order = np.argsort(hashes, kind="stable")
                h = hashes[order]
                head = np.concatenate([[True], h[1:] != h[:-1]])
                group = np.cumsum(head) - 1
                repeated = np.bincount(group)[group] > 1
                order, group = order[repeated], group[repeated]
                least = np.full(int(head.sum()), np.iinfo(np.int64).max)
                np.minimum.at(least, group, docs[order])
                order = order[docs[order] != least[group]]
                docs, hashes = docs[order], hashes[order]
            if len(docs):
                yield from _packs(docs, hashes, packs)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with all that was found for it."""
    for _, rows in _by_key(batches):
        docs, hashes = _entries(rows)
        order = np.argsort(docs, kind="stable")
        own, counts = _runs(docs[order])
        packed, ends = _pack(hashes[order]), np.cumsum(counts)
        for low in range(0, len(own), 4096):
            part = slice(low, low + 4096)
            yield C.as_batch(_MERGED, [own[part], [packed[7 * (e - c) : 7 * e] for e, c in zip(ends[part].tolist(), counts[part].tolist(), strict=True)]])


def repeated_windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, found): packed hashes of the windows of a document that start in a
    document with a smaller doc_id too; one row for each document that has any."""
    C.small_batches(docs.sparkSession)
    buckets = C.partitions(docs, "text", _BUCKET_BYTES)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_map(k, buckets), "bucket int, docs binary, counts binary, hashes binary")
    # a partition each; what the map tasks have decided comes with negative numbers, to the same partitions
    own = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    dealt = packed.repartitionById(buckets, own).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_reduce(4 * buckets), "pack int, docs binary, counts binary, hashes binary")
    return found.repartitionById(buckets, F.col("pack") % buckets).sortWithinPartitions("pack").mapInArrow(_merge, "doc_id long, found binary")


def _covered(words: np.ndarray, k: int, found: np.ndarray) -> np.ndarray:
    """Mask of the words that a found window covers."""
    hashes = C.mix(C.windows(words, k, _POWERS[0])) & _REST
    hit = np.isin(hashes, found)
    change = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(hit)
    change[at] += 1
    np.subtract.at(change, at + k, 1)
    return np.cumsum(change[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of covered words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cut(k: int, extra: pa.Schema):
    names = ("n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans")
    schema = pa.schema([*extra, *zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True)])

    def one(text: bytes | None, found: bytes | None) -> tuple:
        if text is None:
            return 0, 0, hashlib.sha256(b"").hexdigest(), None, []
        parts = text.split()
        if not found:
            return len(parts), 0, hashlib.sha256(b" ".join(parts)).hexdigest(), text.decode("utf-8", "replace"), []
        hashes, starts, ends = C.words(text)
        mask = _covered(hashes, k, np.unique(_unpack(found)))
        spans = intervals(mask)
        kept = [x for x, gone in zip(parts, mask.tolist(), strict=True) if not gone]
        out, at = [], 0
        for low, high in spans:
            out.append(text[at : starts[low]])
            at = starts[high] if high < len(starts) else len(text)
        out.append(text[at:])
        left = b"".join(out)
        return len(parts), int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), left.decode("utf-8", "replace"), [{"start": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.byte_slices(batches, "text"):
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            found = batch.column(batch.schema.get_field_index("__found")).to_pylist()
            made = list(zip(*map(one, text, found), strict=True))
            yield C.as_batch(schema, [*(batch.column(batch.schema.get_field_index(n)).cast(t) for n, t in zip(extra.names, extra.types, strict=True)), *map(list, made)])

    return run, schema


def remove_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """Documents with n_words, n_removed, kept_sha256 (of the kept words joined by
    one space), kept_text (the text without the removed spans; white space
    elsewhere as it was) and removed_spans (maximal intervals of word numbers)."""
    added = ("n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans")
    docs = docs.drop(*added)
    found = repeated_windows(docs, k).toDF("__id", "__found")
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    passing = docs.columns
    fields = {f.name: f for f in docs.schema}
    from pyspark.sql.pandas.types import to_arrow_schema

    run, _ = _cut(k, to_arrow_schema(docs.schema))
    ddl = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in passing)
    return joined.select(*[F.col(f"`{c}`") for c in passing], "__found").mapInArrow(run, f"{ddl}, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans array<struct<start:long,end:long>>")
