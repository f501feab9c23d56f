"""Benchmark decontamination: a BM25 inverted index of the test items, searched
with block-max WAND by every passage of every training document.

Index: terms are lower-cased words without ASCII punctuation, as 64-bit hashes;
an item's impact for a term is its BM25 weight divided by the item's own sum, so
that a passage with all terms of an item scores 1 and one threshold serves all
items.  Postings are sorted by item and cut in blocks of BLOCK items with the
largest impact of each.

Search: documents are cut in passages of twice the longest item, one item's length
apart, so that every occurrence of an item lies whole in some passage.  First, for
all passages of a batch at once, the block maxima of a passage's terms are summed:
where no block reaches the threshold there is no pivot, and the passage is done.
The others run WAND: cursors move to the pivot, a block whose maxima don't reach
the threshold is skipped, and what is left is scored in full.  All items at or
above the threshold are retrieved.

Verification: a hit counts if the shares of the question's and of the answer's word
runs (GRAM words) that the passage holds are OVERLAP or more.  Items without the
columns question and answer are halved.

The items of one index are bounded (ITEMS_AT_ONCE); larger benchmarks are searched
part by part, so that no more is ever broadcast; document frequencies, mean and
longest length are those of the whole benchmark, so parts don't change scores.

Defined results: null or empty texts have no passages, null or empty items match
nothing; an item without an id is found under a null one; items that repeat match each for itself; rows that repeat match alike;
an empty table gives no rows; other columns pass through `remove_leaks`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K1, B = 1.2, 0.75
BLOCK = 4
#: Least share of an item's own score, and least overlap of question and of answer.
THRESHOLD, OVERLAP, GRAM = 0.6, 0.5, 3
ITEMS_AT_ONCE = 20_000
_POWERS = C.Powers(0xA24BAED4963EE407)
_PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def terms(text: str | None) -> np.ndarray:
    """Hashes of the text's words, in order."""
    return C.words(normal(text))[0]


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION)


@dataclass
class Index:
    ids: list[int | None]
    vocabulary: np.ndarray  # term hashes, ascending
    first: np.ndarray  # postings of term t: items[first[t]:first[t+1]]
    items: np.ndarray
    impacts: np.ndarray
    block_first: np.ndarray  # blocks of term t
    blocks: np.ndarray
    block_max: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    longest: int

    @cached_property
    def lists(self) -> tuple[list, list, list, list]:
        """items, impacts, blocks and block maxima for the scalar search."""
        return self.items.tolist(), self.impacts.tolist(), self.blocks.tolist(), self.block_max.tolist()


def _grams(words: np.ndarray) -> np.ndarray:
    k = min(GRAM, len(words))
    return np.unique(C.windows(words, k, _POWERS)) if k else np.zeros(0, np.uint64)


@dataclass
class Whole:
    """What the scores need of a benchmark that is searched in parts."""

    count: int
    average: float
    longest: int
    terms: np.ndarray  # ascending, those of the part at least
    df: np.ndarray


def _words(text: str | None, question: str | None, answer: str | None) -> np.ndarray:
    return terms(text if text else f"{question or ''} {answer or ''}")


def build(items: list[tuple[int | None, str | None, str | None, str | None]], whole: Whole | None = None) -> Index:
    """Index of items (id, text, question, answer); whole: of the benchmark, if they are a part of it."""
    words = [_words(text, question, answer) for _, text, question, answer in items]
    lengths = np.array([len(w) for w in words])
    average = whole.average if whole else max(1.0, float(lengths.mean())) if len(lengths) else 1.0
    longest = whole.longest if whole else int(lengths.max()) if len(lengths) else 0
    count = whole.count if whole else len(items)
    pairs = [np.unique(w, return_counts=True) for w in words]
    owner = np.repeat(np.arange(len(items)), [len(t) for t, _ in pairs])
    term = np.concatenate([t for t, _ in pairs]) if pairs else np.zeros(0, np.uint64)
    tf = np.concatenate([c for _, c in pairs]).astype(float) if pairs else np.zeros(0)
    vocabulary, row, df = np.unique(term, return_inverse=True, return_counts=True)
    if whole and len(vocabulary):
        df = whole.df[np.searchsorted(whole.terms, vocabulary)]
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    weight = idf[row] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / average))
    own = np.bincount(owner, weight, len(items))
    impact = weight / np.maximum(own[owner], 1e-12)
    order = np.lexsort((owner, row))
    row, owner, impact = row[order], owner[order], impact[order]
    first = np.searchsorted(row, np.arange(len(vocabulary) + 1))
    block = owner // BLOCK
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(impact, head) if len(head) else np.zeros(0)
    question, answer = [], []
    for (_, _, q, a), w in zip(items, words, strict=True):
        half = (len(w) + 1) // 2
        question.append(_grams(terms(q) if q else w[:half]))
        answer.append(_grams(terms(a) if a else w[half:]))
    return Index([i for i, *_ in items], vocabulary, first, owner, impact, np.searchsorted(row[head], np.arange(len(vocabulary) + 1)), block[head], block_max, question, answer, max(16, longest))


def wand(index: Index, query: np.ndarray, threshold: float, live: list[int] | None = None) -> list[tuple[int, float]]:
    """Items whose score for the query's terms (rows of the vocabulary) reaches
    the threshold.  live: the only blocks whose maxima reach it, if that is known."""
    items, impacts, blocks, block_max = index.lists
    cursors = []  # [item, place, end, largest impact, block place, block end]
    for t in query.tolist():
        low, high = int(index.first[t]), int(index.first[t + 1])
        b, e = int(index.block_first[t]), int(index.block_first[t + 1])
        cursors.append([items[low], low, high, max(block_max[b:e]), b, e])
    found, at = [], 0
    while cursors:
        cursors.sort(key=itemgetter(0))
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c[3]
            if bound >= threshold:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        here = item // BLOCK
        if live is not None:
            while at < len(live) and live[at] < here:
                at += 1
            if at == len(live):
                break
            here = live[at]
        bound = 0.0
        if item < here * BLOCK:  # no block from the pivot's to this one can do
            target = here * BLOCK
        else:
            for c in cursors[: pivot + 1]:
                c[4] = bisect_left(blocks, here, c[4], c[5])
                if c[4] < c[5] and blocks[c[4]] == here:
                    bound += block_max[c[4]]
            if bound < threshold:
                target = (here + 1) * BLOCK  # unless another term's cursor comes before the block's end
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            elif cursors[0][0] == item:
                score = sum(impacts[c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
        for c in cursors if item < here * BLOCK else cursors[: pivot + 1]:
            if c[0] < target:
                c[1] = bisect_left(items, target, c[1], c[2])
                c[0] = items[c[1]] if c[1] < c[2] else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def _matches(index: Index, texts: list[str | None], threshold: float, overlap: float) -> list[tuple[int, int, int, float, float, float]]:
    """(text, item, passage, score, question overlap, answer overlap) of all verified hits."""
    words, offsets = C.batch_words([normal(t) for t in texts])
    if not len(words) or not len(index.vocabulary):
        return []
    stride = index.longest
    counts = np.diff(offsets)
    pieces = np.maximum(-(-counts // stride), 1) * (counts > 0)
    base = np.concatenate([[0], np.cumsum(pieces)])
    row = np.searchsorted(index.vocabulary, words)
    row[row == len(index.vocabulary)] = 0
    hit = np.flatnonzero(index.vocabulary[row] == words)
    owner = np.searchsorted(offsets, hit, "right") - 1
    piece = base[owner] + (hit - offsets[owner]) // stride
    size = len(index.vocabulary)
    pairs = C.distinct(piece * size + row[hit])
    # a passage is a piece and the next of the same text; the last piece alone adds nothing unless it is the only one
    before = pairs - size
    whose = np.repeat(np.arange(len(texts)), pieces)
    at = pairs // size
    inner = np.flatnonzero(at > base[whose[at]])
    pairs = C.distinct(np.concatenate([pairs, before[inner]]))
    passage, term = pairs // size, pairs % size
    # sums of block maxima by (passage, block)
    many = np.diff(index.block_first)[term]
    spread = np.repeat(np.arange(len(pairs)), many)
    place = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many) + index.block_first[term[spread]]
    n_blocks = len(index.ids) // BLOCK + 1
    sums = np.zeros(0)
    alive: dict[int, list[int]] = {}
    starts = np.searchsorted(passage, np.arange(int(base[-1]) + 1))
    step = max(1, (4 << 20) // n_blocks)
    edges = np.cumsum(many)
    for low in range(0, int(base[-1]), step):
        high = min(low + step, int(base[-1]))
        a, b = int(starts[low]), int(starts[high])
        if a == b:
            continue
        x, y = int(edges[a - 1]) if a else 0, int(edges[b - 1])
        sums = np.bincount((passage[spread[x:y]] - low) * n_blocks + index.blocks[place[x:y]], index.block_max[place[x:y]], (high - low) * n_blocks)
        for cell in np.flatnonzero(sums >= threshold - 1e-9).tolist():
            alive.setdefault(cell // n_blocks + low, []).append(cell % n_blocks)
    out = []
    for p in sorted(alive):
        hits = wand(index, term[starts[p] : starts[p + 1]], threshold, alive[p])
        if not hits:
            continue
        i = int(whose[p])
        begin = offsets[i] + (p - base[i]) * stride
        held = _all_grams(words[begin : min(begin + 2 * stride, offsets[i + 1])])
        for item, score in hits:
            shares = [1.0 if not len(g) else float(np.isin(g, held).mean()) for g in (index.question[item], index.answer[item])]
            if min(shares) >= overlap:
                out.append((i, item, int(p - base[i]), score, *shares))
    return out


def _all_grams(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unique(C.windows(words, k, _POWERS)) for k in range(1, GRAM + 1)])


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of ITEMS_AT_ONCE items at most, which together hold the benchmark; one at a time is made."""
    n = benchmark.count()
    parts = max(1, -(-2 * n // ITEMS_AT_ONCE)) if n > ITEMS_AT_ONCE else 1
    names = benchmark.columns
    pick = lambda c: F.col(c).cast("string") if c in names else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long"), pick("text").alias("text"), pick("question").alias("question"), pick("answer").alias("answer"))
    if parts == 1:
        yield build(sorted((tuple(r) for r in rows.collect()), key=repr))
        return
    # rows that repeat are dealt out as well
    copy = F.row_number().over(Window.partitionBy(*rows.columns).orderBy(F.lit(0)))
    dealt = C.stage(rows.withColumn("copy", copy).withColumn("part", F.pmod(F.xxhash64("item_id", "text", "copy"), F.lit(parts)).cast("int")), "items")
    each = C.stage(dealt.select("part", "text", "question", "answer").mapInArrow(_lengths, "part int, n long, terms array<long>"), "terms")
    total = each.agg(F.avg("n").alias("average"), F.max("n").alias("longest")).first()
    found = each.select("part", F.explode("terms").alias("term")).groupBy("part", "term").agg(F.count("*").alias("n"))
    df = C.stage(found.groupBy("term").agg(F.sum("n").alias("df"), F.collect_set("part").alias("parts")), "df")
    for i in range(parts):
        pairs = df.where(F.array_contains("parts", i)).select("term", "df").toArrow()
        keys, counts = pairs.column(0).to_numpy().astype(np.int64).view(np.uint64), pairs.column(1).to_numpy()
        order = np.argsort(keys)
        whole = Whole(n, max(1.0, total["average"]), total["longest"], keys[order], counts[order])
        items = dealt.where(F.col("part") == i).select(*rows.columns).collect()
        yield build(sorted((tuple(r) for r in items), key=repr), whole)
    C.unstage(dealt, each, df)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and distinct terms of each item."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("terms", pa.list_(pa.int64()))])
    for batch in batches:
        words = [_words(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))], schema=schema)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap): the best verified passage of each document and item."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    out = None
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in C.byte_slices(batches, "text"):
                best: dict[tuple[int, int], tuple] = {}
                for i, item, *rest in _matches(own, batch.column(1).to_pylist(), threshold, overlap):
                    if (i, item) not in best or rest[1] > best[i, item][1]:
                        best[i, item] = tuple(rest)
                if best:
                    ids = batch.column(0)
                    yield C.as_batch(schema, [list(x) for x in zip(*((ids[i].as_py(), own.ids[item], *rest) for (i, item), rest in best.items()), strict=True)])

        one = rows.mapInArrow(run, "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double")
        out = one if out is None else out.union(one)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Documents without a verified hit, all columns as they were; narrow, without a join."""
    spark = docs.sparkSession
    C.small_batches(spark)
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in C.byte_slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in _matches(sent.value, batch.column(batch.schema.get_field_index("text")).to_pylist(), threshold, overlap)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
