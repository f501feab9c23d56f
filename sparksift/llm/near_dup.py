"""MinHash-type near-dedup with SetSketch registers.

A document's set holds its distinct shingles of `k` words (A-Z lower-cased);
documents are linked if 100 * |A n B| >= percent * |A u B|, and a component is
what links connect.

Plan
  1. map: hash the shingles of each text; write set size, a 128-bit fingerprint
     of the set, and REGISTERS registers: K = floor(1 - log_b x), x the least of
     exponentially distributed values of the set's members, truncated to 16 bits.
     Registers merge by maximum, and two sets agree in one with about their
     Jaccard likeness.
  2. equal sets collapse into one class (aggregate on the fingerprint), so groups
     of copies never meet as pairs.
  3. classes meet where ROWS registers of a band agree.  Each bucket has a pivot,
     the class that shares most buckets with others, and its members become
     candidates with the pivot only: linear in the bucket.  Candidates must fit in
     size and pass a joint likelihood estimate that lies six standard deviations
     under the threshold, then are confirmed on the full sets.  Members without a
     link to the pivot get another pivot among them, PIVOTS times at most, and as
     long as that links more than a few.
  4. components of the confirmed links.
  5. members of a bucket that are in different components by then may still link.
     All classes of such buckets, pivots and linked ones too, take part in an exact
     prefix join (see `crossing_pairs`): their shingles are put in one order, those
     that only one component holds first, and sets that can reach the needed
     intersection share a shingle among their first ones.  What it finds is
     estimated and confirmed as in step 3, and components are joined.
Of the pairs that share a bucket no link is lost but by the estimate in step 3;
pairs within a component don't meet in step 5, and a class whose own shingles
rule a link out meets nobody.
With 24 bands of 4 registers a pair at the threshold 0.85 shares no bucket with
odds of 2e-8 (at 0.8: 3e-6).

Defined results: a text with fewer than `k` words has one shingle, the whole
sequence; null texts and texts without words have size 0 and no links; a null
doc_id has no component and is kept; rows with the same doc_id count as one
document with several texts; an empty table gives no rows; other columns are
not needed, and extra ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

#: SetSketch parameters: registers, base, rate, largest value.
REGISTERS, BASE, RATE, LARGEST = 96, 1.001, 20.0, 65534
ROWS = 4
BANDS = REGISTERS // ROWS
#: Pivots that a bucket gets at most before its members of different components meet by their shingles.
PIVOTS = 3
#: Another pivot is only tried where the last one linked one member in so many.
LEAST_YIELD = 20
#: Ratio of neighbouring size classes in the prefix join.
STEP = 1.02
_POWERS = C.Powers(0xD1B54A32D192ED03)
_SEEDS = C.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _ADDENDS = _SEEDS[:REGISTERS] | np.uint64(1), _SEEDS[REGISTERS:]
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sketch", pa.binary())])


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text i has the distinct shingle hashes hashes[offsets[i]:offsets[i+1]], ascending."""
    words, offsets = C.batch_words(texts, lower=True)
    at, owner = C.doc_windows(offsets, k)
    hashes = C.mix(C.windows(words, k, _POWERS))[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        with np.errstate(over="ignore"):
            whole = [C.mix(C.windows(words[offsets[i] : offsets[i + 1]], int(counts[i]), _POWERS) + np.uint64(counts[i]))[0] for i in short]
        hashes, owner = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set, a row each; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    starts = offsets[:-1][full]
    least = np.empty((len(full), REGISTERS), np.uint64)
    buffer = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            np.multiply(hashes, _FACTORS[j], out=buffer)
            np.add(buffer, _ADDENDS[j], out=buffer)
            least[:, j] = np.minimum.reduceat(buffer, starts)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-52)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST + 1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard likeness of pairs of sets that best explains, jointly, how often
    registers are greater, less and equal, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in the likeness
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.byte_slices(batches, "text"):
            hashes, offsets = shingle_sets(C.text_bytes(batch.column(1)), k)
            sizes = np.diff(offsets)
            sums = []
            with np.errstate(over="ignore"):
                for salt in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(hashes ^ np.uint64(salt)))])
                    sums.append(total[offsets[1:]] - total[offsets[:-1]])
            fingerprints = np.stack([*sums, sizes.astype(np.uint64)], 1)
            sketches = registers(hashes, offsets)
            yield C.as_batch(_SIGNED, [batch.column(0), sizes, [x.tobytes() for x in fingerprints], [x.tobytes() for x in sketches]])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])
    salt = C.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).view(np.uint64)[:, :, 0]
        with np.errstate(over="ignore"):
            keys = C.mix(C.mix(keys ^ salt) + salt)
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield C.as_batch(schema, [keys.ravel().view(np.int64), ids])


def _likely(percent: int):
    """Pairs whose estimate isn't six standard deviations under the threshold."""
    t = percent / 100
    floor = t - 6 * np.sqrt(t * (1 - t) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
            sa, sb = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (sa, sb))
            keep = estimate(sa, sb, na.to_numpy().astype(float), nb.to_numpy().astype(float)) >= floor
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


def _sets(k: int):
    schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.byte_slices(batches, "text"):
            hashes, offsets = shingle_sets(C.text_bytes(batch.column(1)), k)
            yield C.as_batch(schema, [batch.column(0), [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]])

    return run


def _confirm(percent: int):
    """Pairs whose exact intersection links them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (x, h, c, n, e) for each shingle e of the set x, h of component c."""
    for batch in C.byte_slices(batches, "set"):
        raw = batch.column(3).to_pylist()
        counts = [len(r) // 8 for r in raw]
        ids = [np.repeat(batch.column(i).to_numpy(), counts) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(np.repeat(counts, counts)), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["x", "h", "c", "n", "e"])


def _up(value, by: int):
    """value / by, rounded up; both whole."""
    return F.ceil(value / F.lit(by)).cast("long")


def crossing_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets (x, h, c, set) of different components c that may link: all pairs that do, and few others.

    All shingles have one order: those that a single component holds, then by the
    number of sets that hold them.  A pair needs `percent * (nx + ny) / (100 +
    percent)` shingles in common, so the first common one stands at a place p with
    at least as many from there on, in both sets: n - p is the most that a set can
    still share.  Hence places over n - percent * n / 100 don't count, and of a
    pair the smaller set's is short: at most n - 2 * percent * n / (100 + percent).
    Short places meet by the shingle, other ones (`long`) by the shingle and the
    size class of the smaller sets they fit.  Shingles of one component give
    nothing; of others, one side is never of the component that holds most."""
    posts = sets.select("x", "h", "c", "set").mapInArrow(_posts, "x long, h long, c long, n long, e long")
    several = C.stage(posts.groupBy("e").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low < high").select("e", "size", F.col("size").alias("holders")), "several")
    total = sets.agg(F.sum(F.length("set")).alias("n")).first()["n"] or 0
    shared = C.skew_join(posts, several, "e", "size", total // 8, "x").where("holders is not null")
    own = Window.partitionBy("x", "h")
    placed = shared.withColumn("at", F.row_number().over(own.orderBy("holders", "e")) - 1 + F.col("n") - F.count("*").over(own))
    first = C.stage(placed.where(F.col("at") <= F.col("n") - _up(F.col("n") * percent, 100)).select("x", "c", "n", "e", (F.col("n") - F.col("at")).alias("rest")), "first")
    held = first.groupBy("e", "c").agg(F.count("*").alias("own"))
    most = held.groupBy("e").agg(F.max_by("c", F.struct("own", "c")).alias("most"), F.sum("own").alias("size"), F.count("*").alias("components")).where("components > 1").select("e", "size", "most")
    met = C.skew_join(first, C.stage(most, "most"), "e", "size", first.count(), "x").where("most is not null")
    by_size = lambda n: F.floor(F.log(n) / F.log(F.lit(STEP))).cast("int")
    # the largest partner for which `rest` shingles are enough
    reach = F.floor(F.col("rest") * (100 + percent) / F.lit(percent)).cast("long") - F.col("n")
    met = met.withColumn("short", F.col("rest") >= _up(2 * percent * F.col("n"), 100 + percent)).withColumn("seeks", F.col("c") != F.col("most"))
    classes = F.when(F.col("short"), F.array(F.lit(-1))).otherwise(F.sequence(by_size(_up(F.col("n") * percent, 100)), by_size(F.greatest(reach, _up(F.col("n") * percent, 100)))))
    met = C.stage(met.withColumn("probes", classes).withColumn("places", F.when(F.col("short"), F.array(F.lit(-1), by_size(F.col("n"))))), "met")
    one = met.select("e", F.explode("probes").alias("size"), "seeks", F.col("x").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    two = met.where("short").select("e", F.explode("places").alias("size"), "seeks", F.col("x").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    fits = (F.col("ca") != F.col("cb")) & (F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    sides = ((one.where("seeks"), two), (one.where("not seeks"), two.where("seeks")))
    found = reduce(DataFrame.union, [x.drop("seeks").join(y.drop("seeks"), ["e", "size"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for x, y in sides])
    return C.stage(found.distinct(), "crossing")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = C.stage(texts.mapInArrow(_sign(k), "doc_id long, n long, fp binary, sketch binary"), "signed")
    sets = signed.where("n > 0 and doc_id is not null")
    classes = C.stage(sets.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
    reps = classes.select("rep", "n", "sketch")
    # buckets: only those with two classes at least go on
    bands = reps.select("rep", "sketch").mapInArrow(_bands, "key long, rep long")
    keys = C.stage(bands.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("size")).where("first < last").select("key", "size", F.col("size").alias("n")), "keys")
    multi = C.stage(C.skew_join(bands, keys, "key", "size", classes.count() * BANDS, "rep").where("n is not null"), "buckets")
    central = C.stage(multi.join(multi.groupBy("rep").agg(F.sum("n").alias("met")), "rep").select("key", "rep", "met"), "central")
    needed = central.select(F.col("rep").alias("need")).distinct()
    full = C.stage(texts.join(needed.hint("shuffle_hash"), F.col("doc_id") == F.col("need")).select("doc_id", "text").mapInArrow(_sets(k), "id long, set binary"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        fits = (F.least("na", "nb") * 100) >= F.greatest("na", "nb") * percent
        near = pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely(percent), "a long, b long")
        one, two = (full.select(F.col("id").alias(c), F.col("set").alias(f"set{c}")) for c in "ab")
        return near.join(one, "a").join(two, "b").select("a", "b", "seta", "setb").mapInArrow(_confirm(percent), "a long, b long").distinct()

    # pivots; what isn't linked to its bucket's pivot gets another among its like
    rounds, left = [], central
    for _ in range(PIVOTS):
        pivots = C.stage(left.groupBy("key").agg(F.max_by("rep", F.struct("met", "rep")).alias("pivot"), F.count("*").alias("size")).where("size > 1"), "pivots")
        drawn = C.stage(C.skew_join(left, pivots, "key", "size", left.count(), "rep").where("rep <> pivot"), "drawn")
        C.unstage(pivots)
        if not drawn.limit(1).count():
            break
        rounds.append(C.stage(linked(drawn.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()), "links"))
        left = C.stage(drawn.join(rounds[-1].select(F.col("a").alias("pivot"), F.col("b").alias("rep")), ["pivot", "rep"], "left_anti").select("key", "rep", "met"), "left")
        before, after = drawn.count(), left.count()
        C.unstage(drawn)
        if (before - after) * LEAST_YIELD < before:  # what is left is better met by its shingles
            break
    links = reduce(DataFrame.union, rounds, spark.createDataFrame([], "a long, b long"))
    # a doc_id that comes with several texts links its classes
    mark = F.xxhash64("fp")
    again = sets.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low < high").select(F.col("doc_id").alias("many"))
    same = sets.join(again, F.col("doc_id") == F.col("many")).select("doc_id", "fp").join(classes, "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(same))

    # buckets whose members are in several components
    placed = C.stage(central.select("key", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c")), "placed")
    mixed = C.stage(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "mixed")
    if mixed.limit(1).count():
        # a semi join, whose left side Spark splits where a bucket is hot
        open_ = placed.join(mixed, "key", "left_semi").select("rep", "c").distinct()
        meeting = C.stage(open_.join(full, F.col("rep") == F.col("id")).select(F.col("rep").alias("x"), F.xxhash64("set").alias("h"), "c", "set"), "meeting")
        more = C.stage(linked(crossing_pairs(meeting, percent)), "links")
        if more.limit(1).count():
            joined = more.join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left").join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left")
            merged = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            known = labels.select("v", "c").union(more.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti").select("v", F.col("v").alias("c")))
            labels = known.join(merged.select(F.col("v").alias("c"), F.col("c").alias("root")), "c", "left").select("v", F.coalesce("root", "c").alias("c"))
        C.unstage(meeting)
    named = classes.select("fp", "rep", "size").join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("fp", "size", F.coalesce("c", "rep").alias("component_id"))
    C.unstage(full, multi, keys, central, placed, mixed)
    rows = C.skew_join(signed.select("doc_id", "n", "fp"), named, "fp", "size", signed.count(), "doc_id")
    found = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
