"""Ranked lexical search: TPUT (three-phase uniform threshold) over term-partitioned postings.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII;
only A-Z are lowered.  A document's score for an item is the sum of weight * part over the
item's terms, repeats included, in 64-bit integers:
  weight(term) = floor(1000 * ln((2N + 2) / (2df + 1))), part = 10^9 tf div (1000 tf + 12 m),
  m = 75 + (25 n N) div L.

Index: one pass over the texts keeps (n, terms, counts) of each document, of terms that an
item has (of all terms if the items have more than TERMS_AT_ONCE).  From it come postings
(term, row, part), dealt by term - terms of many documents in several pieces - and sorted
within a term, largest part first.

Search, for items with at most PAIRS_AT_ONCE terms in all at a time
  1. each list gives its k best postings.  Their documents' scores are looked up, and an
     item's k-th best is a lower bound of what its k-th result has.
  2. the bound by the number of the item's lists, times SHARE, is the threshold of each
     of them.  A list gives every posting that some item asks for, once; they meet by document,
     where sums of what was given are lower bounds, and these plus the threshold (or the
     list's largest value, if less) for each list that gave nothing are upper bounds.
     Documents whose upper bound is under the item's k-th best lower bound are out.
  3. the exact scores of the others are looked up, and the k best stay.
No cap bounds the candidates; a SHARE under 1 makes lists give more, and candidates fewer.

A term is known by a 64-bit hash of its bytes; for 10^9 different words and 10^4 terms of
items the odds that any two are mistaken are about 10^-6.

Defined results: a null or empty text has no terms and is never found; an item without
terms, or whose terms no document has, has no results; rows of documents and of items that
repeat count each for itself; a null doc_id comes last among equal scores; texts count whole;
empty tables give no rows; only `doc_id`, `text` and `item_id`, `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Terms of items that go to all tasks at once; terms of items that are searched at once.
TERMS_AT_ONCE, PAIRS_AT_ONCE = 1_000_000, 1_000_000
#: Pairs of items and documents that are sent to all tasks instead of sorting the index for them.
PAIRS_SENT = 1_000_000
#: Postings of a term in one piece of its list, about.
POSTINGS_A_PIECE = 500_000
#: Share of the uniform threshold at which lists are cut.
SHARE = 0.25
#: Sums that a task keeps at once.
CELLS = 2_000_000
_FOLDED = bytes(i if chr(i).isalnum() and i < 128 or i > 127 else 32 for i in range(256)).lower()


def term_hashes(text: bytes) -> np.ndarray:
    """Hashes of the terms of a text, in order."""
    return C.words(text.translate(_FOLDED))[0]


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(row, id, n, terms, counts) of rows (row, id, text); of the terms in the vocabulary (ascending), if there is one."""
    for batch in C.byte_slices(batches, "text"):
        texts = [t.translate(_FOLDED) for t in C.text_bytes(batch.column(2))]
        hashes, offsets = C.batch_words(texts)
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(texts)), n)
        if vocabulary is not None:
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            hashes, owner = hashes[known], owner[known]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
        counts = np.diff(np.append(head, len(hashes)))
        bounds = pa.array(np.searchsorted(owner[head], np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (hashes[head].view(np.int64), counts.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), *lists], names=["row", "id", "n", "terms", "counts"])


def count_terms(rows: DataFrame, key: str, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(row, id, n, terms, counts), staged: number of terms, and how often each occurs, of rows with a key and a text."""
    C.small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col("text").cast("string").alias("text"))
    return C.stage(slim.mapInArrow(lambda batches: _counts(batches, vocabulary), f"row bigint, id {kind}, n bigint, terms array<bigint>, counts array<bigint>"), "terms")


def _each(counted: DataFrame, *columns: str) -> DataFrame:
    pairs = counted.select(*columns, F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return pairs.select(*columns, F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))


def _bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


class Index:
    """Counts of all documents, and the postings of the items' terms by term."""

    def __init__(self, docs: DataFrame, asked: DataFrame):
        """asked: (item, term, tf) of the items."""
        terms = asked.select("term").distinct()
        self.terms = terms.count()
        small = self.terms <= TERMS_AT_ONCE
        vocabulary = np.sort(np.array([r["term"] for r in terms.collect()], np.int64).view(np.uint64)) if small else None
        self.docs = count_terms(docs, "doc_id", vocabulary)
        self.n, self.total = self.docs.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        self.total = self.total or 0
        each = _each(self.docs, "row", "n")
        if not small:
            each = each.join(terms, "term", "left_semi")
        lists = each.groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.n + 2) / (2 * F.col("df") + 1))).cast("long")
        self.lists = C.stage(lists.withColumn("weight", weight).where("weight > 0"), "lists")
        sized = self.lists.select("term", F.ceil(F.col("df") / POSTINGS_A_PIECE).alias("pieces"))
        held = each.join(_bounded(sized, self.terms, TERMS_AT_ONCE), "term").select("term", "row", self.part().alias("part"), F.pmod(F.xxhash64("row"), "pieces").alias("piece"))
        self.postings = C.stage(held.repartition("term", "piece").sortWithinPartitions("term", F.desc("part")).drop("piece"), "postings")

    def part(self) -> Column:
        return F.expr(f"(1000000000L * tf) div (1000 * tf + 12 * (75 + (25 * n * {self.n}L) div {max(1, self.total)}L))")

    def exact(self, pairs: DataFrame, asked: DataFrame, n_pairs: int, n_asked: int) -> DataFrame:
        """(item, row, id, score) of pairs (item, row), for items (item, term, value), value being weight times repeats."""
        found = _each(self.docs.join(_bounded(pairs.select("item", "row"), n_pairs, PAIRS_SENT), "row"), "item", "row", "id", "n")
        own = asked.select(F.col("item").alias("__item"), F.col("term").alias("__term"), "value")
        scored = found.join(_bounded(own, n_asked, PAIRS_AT_ONCE), (F.col("item") == F.col("__item")) & (F.col("term") == F.col("__term")))
        return scored.select("item", "row", "id", (F.col("value") * self.part()).alias("u")).groupBy("item", "row").agg(F.first("id").alias("id"), F.sum("u").alias("score"))


def _kth(scores: DataFrame, value: str, k: int) -> DataFrame:
    """(item, bound): the k-th largest value of each item that has k."""
    place = Window.partitionBy("item").orderBy(F.desc(value))
    return scores.select("item", value, F.row_number().over(place).alias("at")).where(F.col("at") <= k).groupBy("item").agg(F.max("at").alias("n"), F.min(value).alias("bound")).where(F.col("n") == k).drop("n")


def _bounds(batches: Iterator[pa.RecordBatch], first: np.ndarray, item: np.ndarray, value: np.ndarray, least: np.ndarray, most: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(item, row, low, high) of what may be among the best, from postings (row, no, part) in order of row.

    The list `no` stands in items item[first[no]:first[no + 1]], with value times the part as its share of the score,
    if that is `least` at least; a list that gives nothing adds `most` at most.  bound: of each item's k-th best."""
    items = len(bound)
    rest_of = np.bincount(item, most, items).astype(np.int64) if len(item) else np.zeros(items, np.int64)

    def some(row: np.ndarray, no: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], row[1:] != row[:-1]])
        rows, own = row[new], np.cumsum(new) - 1
        step = max(1, CELLS // max(1, items))
        for at in range(0, len(rows), step):
            low_at, high_at = np.searchsorted(own, [at, at + step])
            lists, parts = no[low_at:high_at], part[low_at:high_at]
            many = first[lists + 1] - first[lists]
            place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[lists], many)
            u = value[place] * np.repeat(parts, many)
            given = u >= least[place]
            place, u = place[given], u[given]
            cell = np.repeat(own[low_at:high_at] - at, many)[given] * items + item[place]
            size = min(step, len(rows) - at) * items
            low, over = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(low, cell, u)
            np.add.at(over, cell, most[place])
            high = low + np.tile(rest_of, size // items) - over
            may = np.flatnonzero((low > 0) & (high >= np.tile(bound, size // items)))
            if len(may):
                yield C.as_batch(schema, [may % items, rows[at + may // items], low[may], high[may]])

    schema = pa.schema([("at", pa.int64()), ("row", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([a, b.to_numpy(zero_copy_only=False)]) for a, b in zip(held, batch.columns, strict=True)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield from some(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from some(*held)
    C.tidy()


def _best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the items (item, term, tf), whose number is bounded."""
    n_asked = asked.count()
    asked = C.stage(asked.join(_bounded(index.lists, index.terms, TERMS_AT_ONCE), "term").select("item", "term", (F.col("weight") * F.col("tf")).alias("value")), "asked")
    own = F.broadcast(asked) if n_asked <= PAIRS_AT_ONCE else asked

    top = Window.partitionBy("term").orderBy(F.desc("part"))
    heads = C.stage(index.postings.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k), "heads")
    pairs = C.stage(heads.join(own, "term").select("item", "row").distinct(), "pairs")
    known = C.stage(index.exact(pairs, asked, pairs.count(), n_asked), "known")
    bounds = _kth(known, "score", k)

    largest = heads.where("at = 1").select("term", F.col("part").alias("largest"))
    lists = asked.join(largest, "term").join(bounds, "item", "left").fillna(0, ["bound"]).withColumn("many", F.count("*").over(Window.partitionBy("item")))
    least = F.floor(F.lit(SHARE) * F.col("bound") / F.col("many")).cast("long")
    table = lists.select("item", "term", "value", "bound", least.alias("least"), F.least(least, F.col("value") * F.col("largest")).alias("most")).orderBy("term", "item").toArrow()
    item_ids, item = np.unique(table["item"].to_numpy(), return_inverse=True)
    terms, first = np.unique(table["term"].to_numpy(), return_index=True)
    first = np.append(first, table.num_rows).astype(np.int64)
    value, low, most, bound = (table[c].to_numpy().astype(np.int64) for c in ("value", "least", "most", "bound"))
    bound_of = np.zeros(len(item_ids), np.int64)
    bound_of[item] = bound
    cut = np.minimum.reduceat(low // value, first[:-1]) if len(terms) else np.zeros(0, np.int64)
    spark = index.docs.sparkSession
    asks = spark.createDataFrame(pa.table({"term": terms, "no": np.arange(len(terms)), "cut": cut}))
    given = index.postings.join(F.broadcast(asks), "term").where("part >= cut").select("row", "no", "part")
    given = given.repartition("row").sortWithinPartitions("row")
    send = (first, item, value, low, most, bound_of)
    may = given.mapInArrow(lambda batches: _bounds(batches, *send), "at bigint, row bigint, low bigint, high bigint")
    named = spark.createDataFrame(pa.table({"at": np.arange(len(item_ids)), "item": item_ids}))
    may = C.stage(may.join(F.broadcast(named), "at").drop("at"), "may")

    open_ = C.stage(may.join(F.broadcast(_kth(may, "low", k)), "item", "left").where("bound is null or high >= bound").select("item", "row"), "open")
    scores = index.exact(open_, asked, open_.count(), n_asked)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", F.col("id").alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, with scores above 0."""
    counted = count_terms(items, "item_id")
    asked = C.stage(_each(counted, "row").withColumnRenamed("row", "item"), "items")
    index = Index(docs, asked)
    parts = max(1, -(-asked.count() // PAIRS_AT_ONCE))
    found = None
    for i in range(parts):
        some = _best(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i) if parts > 1 else asked, k)
        found = some if found is None else found.unionByName(some)
    names = counted.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
