"""Exact dedup, ranked search and periodic runs, against plain Python written from their descriptions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparksift.llm import exact_dedup, ranked_search, runs

DOCS = "doc_id long, text string"


def clashing(df):
    """More columns, whose names the operators use themselves."""
    return df.withColumns({c: F.lit(5) for c in ("keep_id", "kept", "digest", "first", "n", "row", "id", "term", "start", "period", "runs", "n_words", "__row", "score", "rank")})


# ---------------------------------------------------------------- exact dedup


def plain_copies(rows):
    """Rows (doc_id, keep_id, group_size, text_sha256), and how many of each text stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    first = lambda ids: min(ids, key=lambda i: (i is None, i))
    return [(i, first(ids), len(ids), hashlib.sha256(text.encode()).hexdigest()) for text, ids in groups.items() for i in ids]


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_exact_dedup(spark, monkeypatch, sent):
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", sent)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", "a\x0bb ", " a b", "a b", "é"])) for i in range(300)]
    rows += [(1000 + i, f"text {i}") for i in range(3000)] + [(5000 + i, f"text \n {i % 40}") for i in range(90)]
    rows += [(7, None), (8, ""), (None, ""), (None, "only here"), (9, " "), (10, "  \r\n "), (1000, "text 0"), (1000, "text 0"), (11, "x " * 200_000), (12, "x\n" * 200_000)]
    got = exact_dedup.mark_copies(clashing(spark.createDataFrame(rows, DOCS))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(plain_copies(rows), key=key)
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in stay})
    assert all(r.doc_id == r.keep_id for r in stay)
    kept = exact_dedup.drop_copies(clashing(spark.createDataFrame(rows, DOCS)))
    assert kept.columns == clashing(spark.createDataFrame([], DOCS)).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in stay)
    empty = exact_dedup.mark_copies(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0
    assert exact_dedup.drop_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_single_texts_pass_the_filter_and_no_copy_does(spark):
    rows = [(i, f"single {i}") for i in range(8000)] + [(10_000 + i, f"pair {i // 2}") for i in range(200)]
    hashes = spark.createDataFrame(rows, DOCS).select("doc_id", exact_dedup._digest().alias("digest"))
    may = {r.doc_id for r in exact_dedup.RepeatFilter(hashes, len(rows)).test(hashes).where("__maybe").collect()}
    assert may >= {i for i, _ in rows if i >= 10_000}
    assert len(may) - 200 < 0.03 * 8000


# ---------------------------------------------------------------- ranked search


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def plain_ranks(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    size = [(i, sum(c.values()), c) for i, c in counted if c]
    n_docs, total = len(size), sum(n for _, n, _ in size)
    df = Counter(t for _, _, c in size for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in size:
            m = 75 + (25 * n * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, at, i, -s) for at, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("few", [False, True])
def test_ranked_search(spark, monkeypatch, few):
    if few:
        for name, value in {"TERMS_AT_ONCE": 3, "PAIRS_AT_ONCE": 12, "PAIRS_SENT": 2, "POSTINGS_A_PIECE": 7, "CELLS": 5, "SHARE": 1.0}.items():
            monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "naïve", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(250)]
    docs += [(300 + i, docs[3][1]) for i in range(30)] + [(400, None), (401, ""), (402, "-- ! "), (None, docs[3][1]), (403, "w1 " * 20_000), (404, docs[4][1]), (404, docs[4][1])]
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(20, docs[3][1]), (21, docs[3][1]), (22, "nowhere"), (23, None), (24, ""), (25, "W59 w59 w58"), (None, "w2 w2 w9")]
    got = ranked_search.rank(clashing(spark.createDataFrame(docs, DOCS)), clashing(spark.createDataFrame(items, "item_id long, text string")).withColumn("id", F.lit("x")), k=5)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_ranks(docs, items, 5), key=key)


def test_ranked_search_of_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    assert ranked_search.rank(none, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert ranked_search.rank(one, none.withColumnRenamed("doc_id", "item_id")).count() == 0


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(6, 4 * q) and end > at:
                found.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
    found = plain_runs(words)
    gone = {x for start, length, q in found for x in range(start + q, start + length)}
    top = min(((-length, start, q) for start, length, q in found), default=None)
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (i, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for x, w in enumerate(words) if x not in gone).encode()).hexdigest())


def test_periodic_runs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 6)):
            unit = rng.choices("abcde"[: rng.choice([1, 2, 5])], k=rng.randint(1, 9))
            parts += (unit * rng.randint(1, 8))[: rng.randint(1, 60)]
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(parts)))
    rows += [(500, None), (501, ""), (502, "\n "), (None, "x y " * 9), (503, "z " * 5), (504, "z " * 6), (505, "é ß " * 4), (505, "é ß " * 4), (506, "a b " * 7)]
    rows.append((507, " ".join(str(rng.randrange(50)) for _ in range(700)) + " tail of it" * 40))
    got = runs.digest(runs.find_runs(runs.with_periodic_ends(clashing(spark.createDataFrame(rows, DOCS)))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(i, t) for i, t in rows), key=key)
    assert runs.digest(runs.find_runs(spark.createDataFrame([], DOCS))).count() == 0


def test_runs_of_long_texts(spark):
    """Periods of all scales in texts of some hundred thousand words."""
    rng = random.Random(2)
    unit = [str(rng.randrange(10**6)) for _ in range(30_000)]
    rows = [(1, "same " * 300_000), (2, " ".join(unit * 5)), (3, "a b c d e f g " * 40_000), (4, " ".join(unit + ["a", "b"] * 50_000 + unit))]
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.find_runs(spark.createDataFrame(rows, DOCS)).select("doc_id", "runs").collect()}
    assert found == {1: [(0, 300_000, 1)], 2: [(0, 150_000, 30_000)], 3: [(0, 280_000, 7)], 4: [(30_000, 100_000, 2)]}


def test_runs_keep_columns_and_collapse(spark):
    docs = spark.createDataFrame([(1, "go on on on on on on now", "k")], "doc_id long, text string, kind string")
    row = runs.find_runs(docs).first()
    assert (row.kind, row.text, row.n_words, row.collapsed_text) == ("k", "go on on on on on on now", 8, "go on now")
