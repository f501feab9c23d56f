"""The pipeline's stages: what each drops, and what it keeps."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = {"en": [f"{a}ing{b}" for a in "bcdfg" for b in range(80)], "fr": [f"{a}eux{b}" for a in "hjklm" for b in range(80)]}
    vocabulary = {k: [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in v] for k, v in vocabulary.items()}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    passage, item = text("en", 60), text("en", 40)
    rows = [(i, text("en" if i % 2 else "fr", 150), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, rows[1][1], "en"), (101, rows[1][1] + " extra", "en")]  # an exact and a near copy
    rows += [(110, text("en", 80) + " " + passage + " " + text("en", 80), "en"), (111, text("en", 90) + " " + passage + " " + text("en", 70), "en")]
    rows += [(120, text("en", 50) + " " + item + " " + text("en", 50), "en"), (130, "12345 !!", "en"), (131, None, "en"), (132, "", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert tuple(now.columns) == corpus_pipeline.COLUMNS
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    every = {i for i, *_ in rows}
    assert every - set(kept["language_id"]) == {130, 131, 132}
    assert set(kept["language_id"]) - set(kept["near_dedup"]) == {100, 101}
    changed = {i for i, t in kept["substring_dedup"].items() if t != kept["near_dedup"][i]}
    assert changed == {111} and passage not in kept["substring_dedup"][111] and passage in kept["substring_dedup"][110]
    assert set(kept["substring_dedup"]) - set(kept["decontamination"]) == {120}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept["decontamination"]) and all(r.round_trip and len(r.ids) == r.n_tokens for r in out)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[0][0]] == [5, "language_id"] and F is not None


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in all columns, one very long text, repeated rows, and columns with the stages' own names."""
    spark.createDataFrame([(0, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    word = [f"{a}{b}{c}ly" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rng = random.Random(5)
    long = " ".join(rng.choices(word, k=150_000))
    rows = [(i, " ".join(rng.choices(word, k=60)), "en") for i in range(20)]
    rows += [(30, long, None), (31, long + " end", "en"), (None, rows[0][1], "en"), (None, None, None), (32, None, "en"), (33, "", None), (5, rows[5][1], "en")]
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    for name in ("score", "lang_pred", "kept", "component_id", "n_removed", "ids", "n_tokens", "found", "a", "set", "size", "key", "batch"):
        docs = docs.withColumn(name, F.lit("x"))
    for table, empty in ((docs, False), (docs.limit(0), True)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "sentencepiece":
                assert tuple(now.columns) == corpus_pipeline.COLUMNS
            now.write.parquet(str(tmp_path / f"{name}-{empty}"))
            now = spark.read.parquet(str(tmp_path / f"{name}-{empty}"))
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in now.collect())
        assert got == ([] if empty else sorted([(False, i) for i in range(20)] + [(False, 5), (False, 30), (True, 0)]))
