"""Language ID, word first.

Known words score by their log frequency in each language; an unseen word falls
back to its character n-grams, the longest first: of the lengths 5 to 1 the first
at which the language model knows any n-gram of the (bounded) word decides, by the
mean log frequency of those it knows.  A text's score is the sum over its words,
and the prediction the language with the best.  `score` is the probability of that
language when at most EVIDENCE words' worth of evidence counts, so that long
texts don't all come out as 1.

Words are runs of letters, lower-cased.  The model is fitted on labelled rows
only, each different text of a language once: of each language on all of them, or
on about SAMPLE_DOCS whole documents chosen by a hash of their text (a documented
bound on what is fitted, not on what is predicted).  Each language brings its own
most frequent entries, an equal part of WORDS and GRAMS but LEAST_ENTRIES at least,
so a small language is in the model as a large one is; counts of all languages
stand for each entry kept, and frequencies are shares of all that was counted.
The model is bounded by these numbers and the number of languages, so it is
broadcast.

Defined results: a null text, or one without letters, is `und` with score 0, as is
every text if there are no labelled rows; ties go to the language that sorts
first; rows that repeat are predicted alike; null labels aren't learned; an empty
table gives no rows; other columns pass through, but for those that are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents of a language that are learned from, about.
SAMPLE_DOCS = 5_000
#: Entries of the model over all languages, and of one language at least.
WORDS, GRAMS, LEAST_ENTRIES = 60_000, 60_000, 1_000
LONGEST_GRAM = 5
EVIDENCE = 12
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHED = 50_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # row of word_logs
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    floor: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that isn't in the vocabulary, by its longest known n-grams."""
        if (known := self.cache.get(word)) is not None:
            return known
        bounded = f"^{word}$"
        scores = self.floor
        for n in range(LONGEST_GRAM, 0, -1):
            rows = [r for i in range(len(bounded) - n + 1) if (r := self.grams.get(bounded[i : i + n])) is not None]
            if rows:
                scores = self.gram_logs[rows].mean(0)
                break
        if len(self.cache) >= _CACHED:
            self.cache.clear()
        self.cache[word] = scores
        return scores

    def predict(self, text: str | None) -> tuple[str, float]:
        found = _LETTERS.findall(text.lower()) if text else []
        if not found or not self.languages:
            return UNKNOWN, 0.0
        rows = np.fromiter((self.words.get(w, -1) for w in found), np.int64, len(found))
        known = rows[rows >= 0]
        total = self.word_logs.T @ np.bincount(known, minlength=len(self.word_logs)) if len(known) > 50_000 else self.word_logs[known].sum(0)
        for i in np.flatnonzero(rows < 0).tolist():
            total = total + self.unseen(found[i])
        best = int(np.argmax(total))
        scaled = (total - total[best]) * (min(len(found), EVIDENCE) / len(found))
        return self.languages[best], float(1 / np.exp(scaled).sum())


def _most(counted: DataFrame, name: str, limit: int, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies of each language's most frequent entries, in all languages: rows of names, and a matrix."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
    each = max(LEAST_ENTRIES, limit // max(1, len(languages)))
    kept = counted.withColumn("place", place).where(F.col("place") <= each).select(name).distinct()
    rows = counted.join(kept, name).select("lang", name, "n").collect()
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = {x: i for i, x in enumerate(sorted({r[name] for r in rows}))}
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(names), len(languages)))
    for r in rows:
        counts[names[r[name]], at[r["lang"]]] = r["n"]
    smooth = 0.5
    return names, np.log((counts + smooth) / (np.array([totals.get(x, 0) for x in languages]) + smooth * (len(names) + 1)))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Model of rows (text, lang); the limits are as SAMPLE_DOCS, WORDS and GRAMS."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    if found:
        scale = 1 << 30
        share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(scale, int(scale * sample_docs / max(1, r["n"]))))])
        rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(scale)) < share[F.col("lang")])
    rows = rows.dropDuplicates(["text", "lang"])
    # words of letters only; combining marks are not letters here, as in prediction
    split = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = C.stage(split.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    bounded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST_GRAM)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(bounded) - k + 1, F.lit(1))), lambda i: F.substring(bounded, i, k))))
    pieced = C.stage(counted.select("lang", "n", F.explode(F.array_distinct(pieces)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    word_rows, word_logs = _most(counted, "word", words, languages)
    gram_rows, gram_logs = _most(pieced, "gram", grams, languages)
    C.unstage(counted, pieced)
    floor = gram_logs.min(0) if len(gram_logs) else np.zeros(len(languages))
    return Model(languages, word_rows, word_logs, gram_rows, gram_logs, np.full(len(languages), floor.min() if len(floor) else 0.0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with lang_pred and score; one narrow pass."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in C.byte_slices(batches, "text"):
            made = [own.predict(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Documents with held_out, lang_pred and score; learned from those that aren't held out."""
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs.drop("held_out").withColumn("held_out", held_out()), model)
