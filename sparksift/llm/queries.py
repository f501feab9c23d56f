"""The registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontam, exact_dedup, fingerprint, langid, near_dup, ranked_search, runs, sentencepiece_sa, sharding, substring_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return common.spread(table, table.columns[0]) if name != "benchmark" else table


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document after windows of 13 words are removed where an earlier document has them."""
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=13)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of each document under a public byte-level BPE vocabulary."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer, limit=512)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard likeness of 0.85 or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, and what reading these back gives."""
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of each document under a public SentencePiece model, as a digest, and whether they decode to the text."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_sa.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return sentencepiece_sa.digest(encoded).select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 as chosen and rejected: the shared prompt and both completions with their masks."""
    out = chat.format_pairs(chat.neighbours(_table(spark, sf_dir, "conversations")))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumn("chosen_mask", text(F.col("chosen_mask"))).withColumn("rejected_mask", text(F.col("rejected_mask")))


def op5_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, learned from those that aren't held out."""
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op6_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: verified hits of every passage."""
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of a weighted hash tree, and where one more shard would take them."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op8_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op11_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the one that stays of those whose texts differ in white space only."""
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"))


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of each document, a tenth of which end periodically; the longest run, and digests."""
    docs = runs.with_periodic_ends(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.digest(runs.find_runs(docs))


QUERIES = {
    "op1_warc_zstd": op1_warc_zstd,
    "op2_sentencepiece": op2_sentencepiece,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_word_backoff": op5_word_backoff,
    "op6_bm25_wand": op6_bm25_wand,
    "op7_weighted_hash_tree": op7_weighted_hash_tree,
    "op8_quartile_digest": op8_quartile_digest,
    "op3_substring_dedup": op3_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_bloom_exact_dedup": op11_bloom_exact_dedup,
    "op12_tput_search": op12_tput_search,
    "op13_periodic_runs": op13_periodic_runs,
}
