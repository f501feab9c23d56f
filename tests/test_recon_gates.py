"""Recon tries only the patterns that a text may match, and loses nothing by it."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_rule_index import examples

from sparksift.functions import text as X
from sparksift.operators import recon

PATTERNS = {name: p for name, (_, p) in recon.CATEGORIES.items()} | recon.PATTERNS


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    made = [t for p in PATTERNS.values() for t in examples(p, rng)]
    pairs = [a + join + b for join in ("", " ", "\n") for a, b in zip(rng.sample(made, 40), rng.sample(made, 40), strict=True)]
    odd = ["paſſword = 'abcd'", "TOKEN:\"x y\"", "aPİ_Key='k'", "éa@b.comm1x@c.de.f@g.hi", "@a@b.cd", "a@b", "12-3-" + "a" * 32 + ".apps.googleusercontent.com", "x.s3.amazonaws.comy.s3.amazonaws.com", "s3-a.amazonaws.com/b"]
    return made + pairs + odd + ["plain words", "", None]


def test_gates_lose_no_match(spark, texts, monkeypatch):
    rows = spark.createDataFrame([(f"{i:04}", t) for i, t in enumerate(texts)], "file string, text string")
    got = set(map(tuple, recon.extract(rows).collect()))
    monkeypatch.setattr(recon, "may_match_some", lambda text, patterns: F.lit(True))
    monkeypatch.setattr(recon, "_all", lambda text, p, group=0: F.regexp_extract_all(F.col(text), X.pattern(p), F.lit(group)))
    assert got == set(map(tuple, recon.extract(rows).collect()))
    assert {r[0] for r in got} == set(PATTERNS)


def test_prose_is_put_aside_by_its_bytes(spark):
    rows = spark.createDataFrame([("a", "some words, and more of them. " * 50), ("b", "mail x@y.example"), ("c", None)], "file string, text string")
    plan = recon.extract(rows)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "Filter" in below and "Contains(text" in below
    assert [r.file for r in rows.where(recon.may_match_some("text", list(PATTERNS.values()))).collect()] == ["b"]


def test_a_long_word_costs_its_length(spark):
    rows = spark.createDataFrame([("a", "a" * 400_000 + " x@y.example")], "file string, text string")
    start = time.monotonic()
    assert [(r.category, r.value) for r in recon.extract(rows, categories=["emails"]).collect()] == [("emails", "x@y.example")]
    assert time.monotonic() - start < 20
