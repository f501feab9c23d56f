"""Periodic runs of words: block matching with an Aho-Corasick automaton over
integer sequences.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) and length >= max(LEAST_LENGTH, LEAST_EXPONENT * q), which no neighbouring
word extends keeping the period.

Method, a document at a time, in Arrow batches and without a shuffle
  1. A word of a run occurs at least LEAST_EXPONENT times in it.  So words that occur
     less often in their stretch end it, and stretches under LEAST_LENGTH words go; this
     is repeated until nothing changes, for all documents of a batch at once.  Only what
     is left, whose words become small integers by their bytes, is searched.
  2. For b = 1, 2, 4, ...: the blocks of b words at multiples of b are the keys of an
     automaton, as sequences of numbers (of words, or of b / 4 words each, numbered by
     doubling, so that keys stay short), which is run over the stretch.  An occurrence at a distance d from its
     aligned block with b <= d < 2b seeds period d: a run with such a period holds an
     aligned block and its copy d words on.  As all keys are of one length and there is one
     aligned place at such a distance, an automaton yields one seed a word at most.
  3. A seed is extended both ways, word by word, to the whole stretch in which words d
     apart are the same; further seeds of this stretch are skipped.  So are those that lie
     in a known stretch of a period p <= b: by Fine and Wilf's theorem a run of period d
     over them would have the period gcd(p, d).
The work is n log n in the words of a stretch, and memory follows one document.

Defined results: a null or empty text has no words and no runs; rows that repeat are
judged alike, each for itself; texts count whole, however long; an empty table gives no
rows; columns of `docs` pass through, but for those that this operator adds; runs are in
order of start, then period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Integers in a key, at most: blocks are sequences of the numbers of parts, which scales before have given.
KEY_LENGTH = 4
ADDED = ("n_words", "runs", "collapsed_text")
RUN = "struct<start:bigint,length:bigint,period:bigint>"


# ---------------------------------------------------------------- one stretch


def doubled(names: np.ndarray, h: int) -> np.ndarray:
    """Numbers of the sequences of 2h words from each place on, given those of h words: equal ones get equal numbers."""
    pairs = names[:-h] * (int(names.max()) + 1) + names[h:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def seeds(names: np.ndarray, h: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(aligned place, distance) of the occurrences of aligned blocks of b words at a distance in [b, 2b).

    names: the number of the h words from each place on.  A block is the sequence of its b / h names; the text is
    one sequence for each remainder of the place by h, with a mark that no key holds between them."""
    import ahocorasick

    places = np.concatenate([np.append(np.arange(r, len(names), h), -1) for r in range(min(h, len(names)))])
    sequence = tuple(np.where(places < 0, int(names.max()) + 1, names[places]).tolist())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    steps = np.arange(0, b, h)
    aligned = np.arange(0, len(names) + h - b, b)
    first: dict[tuple[int, ...], int] = {}
    block = np.empty(len(aligned), np.int64)
    for j, key in enumerate(map(tuple, names[aligned[:, None] + steps].tolist())):
        block[j] = first.setdefault(key, j)
        if block[j] == j:
            automaton.add_word(key, j)
    automaton.make_automaton()
    found = np.fromiter((x for pair in automaton.iter(sequence) for x in pair), np.int64).reshape(-1, 2)
    at = places[found[:, 0]] + h - b
    before = (at - b) // b
    near = before >= 0
    at, before, key = at[near], before[near], found[near, 1]
    same = block[before] == key
    return before[same] * b, (at - before * b)[same]


def _stretch(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The first and the last place, plus one, around `at` where words d apart are the same."""
    n, low, step = len(ids) - d, at, 64
    while low:
        part = slice(max(0, low - step), low)
        differ = np.flatnonzero(ids[part] != ids[part.start + d : part.stop + d])
        if len(differ):
            low = part.start + int(differ[-1]) + 1
            break
        low, step = part.start, step * 2
    high, step = at, 64
    while high < n:
        part = slice(high, min(n, high + step))
        differ = np.flatnonzero(ids[part] != ids[part.start + d : part.stop + d])
        if len(differ):
            high = part.start + int(differ[0])
            break
        high, step = part.stop, step * 2
    return low, high


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a stretch of word numbers."""
    n, b = len(ids), 1
    runs: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int]] = []  # stretches of which at least two periods are there, by place
    names, h = ids, 1  # numbers of h words each, h = b / 4 at least
    while b * LEAST_EXPONENT <= n:
        if h * KEY_LENGTH < b:
            names, h = doubled(names, h), h * 2
        reach = np.zeros(n + 1, np.int64)
        for low, high in known:
            reach[low] = max(reach[low], high)
        reach = np.maximum.accumulate(reach)
        start, distance = seeds(names, h, b)
        open_ = (distance * LEAST_EXPONENT <= n) & (reach[start] < start + distance + b)
        start, distance = start[open_], distance[open_]
        order = np.lexsort((start, distance))
        at_d, done = -1, 0
        for at, d in zip(start[order].tolist(), distance[order].tolist(), strict=True):
            if d == at_d and at < done:
                continue
            low, high = _stretch(ids, at, d)
            at_d, done = d, high
            length = high - low + d
            if length >= 2 * d:
                known.append((low, low + length))
            if length >= max(LEAST_LENGTH, LEAST_EXPONENT * d):
                runs.setdefault((low, length), d)
        b *= 2
    return sorted((start, length, period) for (start, length), period in runs.items())


# ---------------------------------------------------------------- batches


def stretches(hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that may hold runs: words often enough in their stretch, none across texts."""
    place = np.arange(len(hashes))
    part = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    while len(place):
        with np.errstate(over="ignore"):
            key = C.mix(hashes[place] + C.mix(part.astype(np.uint64) + np.uint64(1)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        stay = count[which] >= LEAST_EXPONENT
        left, of = place[stay], part[stay]
        new = np.concatenate([[True], (left[1:] != left[:-1] + 1) | (of[1:] != of[:-1])]) if len(left) else np.zeros(0, bool)
        own = np.cumsum(new) - 1
        long = np.bincount(own)[own] >= LEAST_LENGTH if len(left) else np.zeros(0, bool)
        if len(left) == len(place) and long.all():
            ends = np.flatnonzero(np.append(new[1:], True))
            return list(zip(left[np.flatnonzero(new)].tolist(), (left[ends] + 1).tolist(), strict=True))
        place, part = left[long], own[long]
    return []


def batch_runs(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, text without repeated periods) of each text."""
    joined = b"\n".join(texts)
    hashes, starts, ends = C.words(joined)
    begins = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    offsets = np.searchsorted(starts, begins)
    open_ = stretches(hashes, offsets)
    owner = np.searchsorted(offsets, [low for low, _ in open_], "right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (low, high), i in zip(open_, owner.tolist(), strict=True):
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(joined[s:e], len(number)) for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)], np.int64)
        shift = low - int(offsets[i])
        found.setdefault(i, []).extend((start + shift, length, period) for start, length, period in runs_of(ids))
    for i in range(len(texts)):
        first, last = int(offsets[i]), int(offsets[i + 1])
        runs = found.get(i, [])
        kept = np.ones(last - first, bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        s, e = starts[first:last][kept].tolist(), ends[first:last][kept].tolist()
        yield last - first, runs, b" ".join([joined[x:y] for x, y in zip(s, e, strict=True)])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, runs (start, length, period) and collapsed_text: the words of runs' first periods and outside runs."""
    C.small_batches(docs.sparkSession)
    docs = docs.drop(*ADDED).withColumn("__text", F.col(text).cast("string"))
    kinds = [f"`{c}` {t}" for c, t in docs.drop("__text").dtypes]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.byte_slices(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            words, runs, left = [], [], []
            for n, found, text in batch_runs(C.text_bytes(batch.column(at))):
                words.append(n)
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
                left.append(text.decode())
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in others] + [pa.array(words, pa.int64()), pa.array(runs, run_type), pa.array(left, pa.string())], names=[batch.schema.names[i] for i in others] + list(ADDED))

    return docs.mapInArrow(run, ", ".join([*kinds, "n_words bigint", f"runs array<{RUN}>", "collapsed_text string"]))


def with_periodic_ends(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with h = crc32(doc_id), h % 10 = 0, get their words from word a on by repeating p words from there:
    g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("__w", F.when(h % 10 == 0, words))
    n, g = F.size("__w"), F.floor(h / 10)
    rows = rows.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", F.when(n > 0, 1 + F.floor((n - F.col("__a")) / (3 + g % 8))))

    def word(i: Column) -> Column:
        return F.get(F.col("__w"), F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))

    edited = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.withColumn(text, F.when(F.col("__a").isNotNull(), edited).otherwise(F.col(text))).drop("__w", "__a", "__p")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run, and digests."""
    runs = F.col("runs")
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("__top", longest)
    length = -F.col("__top.less")
    return rows.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("__top.start").alias("start"), length.alias("length"), F.col("__top.period").alias("period"),
        F.floor(1000 * length / F.col("__top.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
