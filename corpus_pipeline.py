"""A corpus pipeline: language ID, near-dedup, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets
it as its docs.  All but the last return the columns of documents.

Defined results, for all stages: whole texts count, however long; an empty table
gives no rows; further columns, whatever their names, don't reach the result; rows
that repeat are separate rows, treated alike but for near-dedup, where they are
copies.  What a stage makes of nulls and of empty texts stands with it; a null
lang, source or n_chars passes through unless a stage sets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift import ship
from sparksift.llm import common, decontam, langid, near_dup, sentencepiece_sa, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language has this probability.
LEAST_SCORE = 0.3
#: Words of a passage that must repeat across documents before it is cut.
PASSAGE = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows; documents without letters or with no likely language go.

    So null and empty texts go, and all documents if none has a lang; a null doc_id stays."""
    ship(spark)
    model = langid.fit(docs)
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Null and empty texts are like nothing and stay, as does a null doc_id.  Rows with one doc_id
    are one document with several texts: all of them stay, or all go."""
    ship(spark)
    found = near_dup.near_duplicates(docs, k=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone"], "left_anti").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words that an earlier document has are cut; a document goes if nothing is left of it.

    Null and empty texts, and documents without a doc_id, stay as they are.  n_chars follows a text that is cut."""
    ship(spark)
    cut = substring_dedup.remove_repeats(docs, k=PASSAGE)
    return cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay."""
    ship(spark)
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding: null ids for a null text, none for an empty one."""
    ship(spark)
    import public_tokenizers

    encoded = sentencepiece_sa.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The sketches and the learned model aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stage(docs, name)
    return docs
