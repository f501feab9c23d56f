"""What the training-data operators share: words and their hashes in numpy,
shared scratch tables, joins that survive hot keys, and Arrow batch handling.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text.  Word hashes are 64-bit: a polynomial over the word's bytes, mixed.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, skew_join, small_batches, spread  # noqa: F401 - operators and queries take these from here

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of text handled at once; bounds the memory of the numpy temporaries.
CHUNK_BYTES = 2 << 20
#: Bytes whose words are hashed at once; the tables of powers are as long.
HASHED_BYTES = 1 << 20


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), element-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Cached powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, value in (("up", self.base), ("down", self.inverse)):
                    powers = np.full(size, value, U64)
                    powers[0] = 1
                    setattr(self, name, np.cumprod(powers, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = Powers(_BASE)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_LOWERED = np.arange(256)
_LOWERED[65:91] += 32
_BYTE_VALUES_LOWER = _BYTE_VALUES[_LOWERED]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _pieces(size: int, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about HASHED_BYTES that end at white space (or with a word longer than that)."""
    at = 0
    while at < size:
        end = min(size, at + HASHED_BYTES)
        while end < size:
            stop = min(size, end + 65536)
            found = np.flatnonzero(_IS_SPACE[data[end:stop]])
            if len(found):
                end += int(found[0])
                break
            end = stop
        yield at, end
        at = end


def words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the bytes; lower folds A-Z first."""
    view = np.frombuffer(data, np.uint8)
    hashes, starts, ends = [], [], []
    values = _BYTE_VALUES_LOWER if lower else _BYTE_VALUES
    with np.errstate(over="ignore"):
        for low, high in _pieces(len(view), view):
            part = view[low:high]
            solid = np.empty(len(part) + 2, bool)
            solid[0] = solid[-1] = False
            np.logical_not(_IS_SPACE[part], out=solid[1:-1])
            edges = np.flatnonzero(solid[1:] != solid[:-1])
            s, e = edges[::2], edges[1::2]
            up, down = _BYTE_POWERS.upto(len(part))
            prefix = np.zeros(len(part) + 1, U64)
            np.cumsum(values[part] * up, out=prefix[1:])
            h = (prefix[e] - prefix[s]) * down[s]
            hashes.append(mix(h ^ ((e - s).astype(U64) * U64(0xA0761D6478BD642F))))
            starts.append(s + low)
            ends.append(e + low)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (faster here than by hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def batch_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, offsets): text i has hashes[offsets[i]:offsets[i+1]]."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    hashes, starts, _ = words(b"\n".join(texts), lower)
    return hashes, np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive words, rolling modulo 2**64."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        up, down = powers.upto(len(hashes))
        prefix = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * up, out=prefix[1:])
        return (prefix[k:] - prefix[:-k]) * down[:n]


def doc_windows(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text index) of each window that lies within one text."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(int(counts.sum())) - first[owner] + offsets[:-1][owner], owner


# ---------------------------------------------------------------- Arrow batches


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches so that each has about `limit` bytes in the column, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(low, high - low)
            low = high
    tidy()


def tidy() -> None:
    """Give freed memory back at the end of a task: worker processes live on, and executors count them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library has its own ways


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- Spark helpers


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: this cuts the
    lineage, and a lost executor loses none of it.  The table goes when the
    session ends, or earlier by unstage()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparksift-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, folder = _files(spark, path)
    system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            system, folder = _files(df.sparkSession, path)
            system.delete(folder, True)


def partitions(df: DataFrame, column: str, each: int = 16 << 20, least: int = 16) -> int:
    """How many partitions give each about `each` bytes of the column."""
    total = df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(least, -(-total // each))
