"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards, each shard with a weight.  A key draws an
exponential number for every shard: -ln(u) / weight, u from a hash of key and
shard.  A rack's draw is the least of its shards' draws - an exponential number
whose rate is the rack's whole weight - and a region's the least of its racks'.
The key descends: the region with the least draw, in it the rack, in it the
shard.  So each node gets its share of the weight, and if a shard is added or a
weight grows, keys move only into the subtrees whose weights grew, and in these
only to the shard that did (law `key`: doc_id and tree decide, nothing else).

Slots number the rows of a shard from 0 without gaps.  They are counted in two
steps, by parts of a shard, so that no task holds a shard.

Defined results: a null key is a key like any other; rows with the same key go to
the same shard; a null text has no bytes; an empty table gives no rows; other
columns pass through, but for those that this operator adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards in a rack and racks in a region when a tree is laid out by number.
RACK, REGION = 4, 3
#: Rows that one task numbers, about.
ROWS_A_PART = 1000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """A tree of `shards` leaves, filled rack by rack and region by region."""
    weights = weights or {}
    return [Leaf(i // (RACK * REGION), i // RACK, i, weights.get(i, 1.0)) for i in range(shards)]


def _draw(key: str, leaf: Leaf) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(leaf.region), F.lit(leaf.rack), F.lit(leaf.shard)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(leaf.weight)


def place(key: str, tree: list[Leaf]) -> Column:
    """Struct (draw, region, rack, shard) of the leaf to which the key descends."""
    leaves = [x for x in tree if x.weight > 0]
    if not leaves:
        raise ValueError("the tree has no shard with a weight")

    def best(options: list[Column]) -> Column:
        return F.array_min(F.array(*options)) if len(options) > 1 else options[0]

    def shard(leaf: Leaf) -> Column:
        return F.struct(_draw(key, leaf).alias("draw"), F.lit(leaf.region).alias("region"), F.lit(leaf.rack).alias("rack"), F.lit(leaf.shard).alias("shard"))

    regions: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    return best([best([best([shard(leaf) for leaf in rack]) for rack in racks.values()]) for racks in regions.values()])


def assign(rows: DataFrame, tree: list[Leaf], key: str = "doc_id") -> DataFrame:
    """Rows with region, rack and shard; narrow, without a shuffle."""
    added = ("region", "rack", "shard")
    at = rows.drop(*added).withColumn("__at", place(key, tree))
    return at.select("*", *[F.col(f"__at.{c}").alias(c) for c in added]).drop("__at")


def number(rows: DataFrame, order: list[str], shards: int, shard: str = "shard") -> DataFrame:
    """Rows with a slot, gapless from 0 in each of about `shards` shards."""
    parts = max(1, -(-rows.count() // (shards * ROWS_A_PART)))
    parted = rows.drop("slot").withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit("slot")), F.lit(parts)))
    sizes = parted.groupBy(shard, "__part").count()
    before = sizes.select(F.col(shard).alias("__s"), F.col("__part").alias("__p"), (F.sum("count").over(Window.partitionBy(shard).orderBy("__part")) - F.col("count")).alias("__before"))
    counted = parted.withColumn("__row", F.row_number().over(Window.partitionBy(shard, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    joined = counted.join(before, (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("slot", (F.col("__before") + F.col("__row") - 1).cast("long")).drop("__part", "__s", "__p", "__before", "__row")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    tree = layout(shards)
    new = layout(shards + 1)[-1]
    placed = slim.withColumn("__at", place("doc_id", tree))
    grown = F.array_min(F.array(F.col("__at"), F.struct(_draw("doc_id", new).alias("draw"), F.lit(new.region).alias("region"), F.lit(new.rack).alias("rack"), F.lit(new.shard).alias("shard"))))
    rows = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("__at.shard").alias("shard"), grown["shard"].alias("grown_shard"), F.col("__at.region").alias("region"), F.col("__at.rack").alias("rack"))
    return number(rows, ["doc_id", "text_crc32"], len(tree))
