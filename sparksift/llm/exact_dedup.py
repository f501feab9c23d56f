"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Texts are equal if they are the same after each run of 0x20 and 0x09-0x0D becomes
one space.  Of equal texts the row with the smallest doc_id stays.

Plan
  1. one pass over the texts makes (doc_id, SHA-256); nothing reads a text again.
  2. first pass over the hashes: each sets PROBES bits in one block of BLOCK_BITS
     bits.  Bits are counted with a combine before the shuffle, so a text that a
     third of all rows hold is one row a task.  Those that two rows or more set make
     the filter of possibly repeated hashes, BITS_A_ROW bits a row at any size.
  3. second pass: a row whose bits aren't all in the filter is the only one with its
     text and passes straight through.  The others shuffle, and are grouped by the
     whole hash, so false positives (about 1.4 % of single texts) change nothing.
The filter is broadcast up to FILTER_BYTES, which is checked; a larger one is joined
by block instead, over hashes only.  Groups join back by `skew_join`.

Defined results: a null text counts as empty, and empty texts equal each other; a
null doc_id comes after all others; rows that repeat as a whole are equal texts, of
which one stays; texts are hashed whole, however long; an empty table gives no rows;
`mark_copies` returns its own columns only, `drop_copies` passes all others through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bits of a block (what Spark's bitmap functions hold in one value), bits set by a hash, bits of filter a row.
BLOCK_BITS, PROBES, BITS_A_ROW = 32768, 2, 16
#: Largest filter that is broadcast.
FILTER_BYTES = 64 << 20


def normal(text: str = "text") -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normal(text), 256))


def _block(digest: str, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(digest), 30), F.lit(blocks))


def _bits(digest: str) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(digest), 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def _is_set(bitmap: str, bit: Column) -> Column:
    """Whether a bit of a bitmap made by bitmap_construct_agg is set."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1


class RepeatFilter:
    """A Bloom filter of the hashes that at least two rows may share.

    hashes: a table with a column `digest`, read twice; rows: how many it has."""

    def __init__(self, hashes: DataFrame, rows: int):
        self.blocks = max(1, -(-rows * BITS_A_ROW // BLOCK_BITS))
        each = hashes.select(_block("digest", self.blocks).alias("__block"), F.explode(F.array_distinct(F.array(*_bits("digest")))).alias("__bit"))
        shared = each.groupBy("__block", "__bit").count().where(F.col("count") > 1).select("__block", "__bit")
        self.table = C.stage(shared.repartition("__block").groupBy("__block").agg(F.call_function("bitmap_construct_agg", F.col("__bit")).alias("__bitmap")), "filter")
        self.bytes = self.table.count() * (BLOCK_BITS // 8)

    def test(self, rows: DataFrame) -> DataFrame:
        """The rows (with a column `digest`) and __maybe: false if no other row has this hash."""
        table = self.table.withColumnRenamed("__block", "__at")
        table = F.broadcast(table) if self.bytes <= FILTER_BYTES else table
        joined = rows.join(table, _block("digest", self.blocks) == F.col("__at"), "left")
        found = [_is_set("__bitmap", bit) for bit in _bits("digest")]
        return joined.withColumn("__maybe", F.col("__bitmap").isNotNull() & found[0] & found[1]).drop("__at", "__bitmap")


def _groups(candidates: DataFrame) -> DataFrame:
    """For each hash: its first row, as (null id, id, row), and how many rows have it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("__row").alias("row")))
    return candidates.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))


def _hashed(docs: DataFrame, text: str, order: str) -> DataFrame:
    slim = docs.select(F.col(order).alias("doc_id"), _digest(text).alias("digest"), F.monotonically_increasing_id().alias("__row"))
    return C.stage(slim, "hashes")


def mark_copies(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row: the row that stays of those with its text."""
    hashes = _hashed(docs, text, order)
    tested = RepeatFilter(hashes, hashes.count()).test(hashes)
    candidates = C.stage(tested.where("__maybe").drop("__maybe"), "candidates")
    groups = C.stage(_groups(candidates).withColumn("group_size", F.col("n")), "groups")
    found = C.skew_join(candidates, groups, "digest", "n", candidates.count(), "__row")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    shared = found.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("__row")).alias("kept"), sha)
    single = tested.where(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return single.unionByName(shared)


def drop_copies(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns.  Rows whose text may repeat shuffle; the others don't."""
    hashes = _hashed(docs, text, order)
    repeats = RepeatFilter(hashes, hashes.count())
    first = _groups(repeats.test(hashes).where("__maybe")).select(F.col("digest").alias("__hash"), F.col("first.id").alias("__first"))
    wide = repeats.test(docs.select(F.struct("*").alias("__all"), F.col(order).alias("__own"), _digest(text).alias("digest")))
    candidates = wide.where("__maybe").join(first, (F.col("digest") == F.col("__hash")) & F.col("__own").eqNullSafe(F.col("__first")))
    return wide.where(~F.col("__maybe")).select("__all.*").unionByName(candidates.dropDuplicates(["digest"]).select("__all.*"))
