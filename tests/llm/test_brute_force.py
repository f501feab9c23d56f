"""Operators without SQL, against plain Python written from their descriptions."""

import hashlib
import math
import random
import re
import string
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparksift.llm import chat, decontam, fingerprint, langid, sentencepiece_sa, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).withColumn("score", F.lit(7)).withColumn("ids", F.lit("x"))


# ---------------------------------------------------------------- language ID


def plain_language(labelled, texts):
    """(language, score) of each text, from word and n-gram counts of the different labelled texts."""
    found = re.compile(r"[^\W\d_]+").findall
    words, grams = {}, {}
    for text, lang in set(labelled):
        words.setdefault(lang, Counter()).update(found(text.lower()))
    languages = sorted(words)
    for lang in languages:
        grams[lang] = Counter()
        for word, n in words[lang].items():
            w = f"^{word}$"
            for gram in {w[i : i + k] for k in range(1, 6) for i in range(max(1, len(w) - k + 1)) if len(w) >= k}:
                grams[lang][gram] += n

    def logs(counts):
        every = set().union(*counts.values())
        return {x: [math.log((counts[lang][x] + 0.5) / (sum(counts[lang].values()) + 0.5 * (len(every) + 1))) for lang in languages] for x in every}

    word_logs, gram_logs = logs(words), logs(grams)
    floor = min(min(v) for v in gram_logs.values())
    out = []
    for text in texts:
        own = found((text or "").lower())
        if not own:
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(languages)
        for word in own:
            scores = word_logs.get(word)
            if scores is None:
                scores, w = [floor] * len(languages), f"^{word}$"
                for k in range(5, 0, -1):
                    known = [gram_logs[w[i : i + k]] for i in range(len(w) - k + 1) if w[i : i + k] in gram_logs]
                    if known:
                        scores = [sum(x) / len(known) for x in zip(*known)]
                        break
            total = [a + b for a, b in zip(total, scores)]
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        part = min(len(own), 12) / len(own)
        out.append((languages[best], 1 / sum(math.exp((t - total[best]) * part) for t in total)))
    return out


def test_language_id_equals_plain_python(spark):
    rng = random.Random(3)
    stems = {"en": "the thing with holding shine mother".split(), "de": "und nicht zeitung schein mutter die".split(), "xx": "the und qua zorp schine moter".split()}
    word = lambda lang: rng.choice(stems[lang]) + rng.choice(["", "", "s", "en", "ing"])
    docs = [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 30))), lang) for i, lang in enumerate(rng.choices(["en", "de", "xx"], [20, 15, 1], k=200))]
    docs += [(300, docs[0][1], docs[0][2]), (301, None, "en"), (302, "42 --", "de"), (303, "Blixten zzz thi", None), (304, "", None), (305, "mother und " * 30_000, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table(spark, docs)).collect()}
    learned = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 3 != 1 and t is not None and lang is not None]
    for (i, *_), (lang, score) in zip(docs, plain_language(learned, [t for _, t, _ in docs])):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, i


def test_small_languages_stay_in_the_model(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST_ENTRIES", 100)
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{''.join(rng.choices(string.ascii_lowercase, k=5))}" for _ in range(40)), "en") for i in range(300)]
    docs += [(1000 + i, f"qzu qzo vrix {'mbo' * (i + 1)}", "xx") for i in range(6)]
    model = langid.fit(table(spark, docs), words=200, grams=200)
    assert model.languages == ["en", "xx"] and {"qzu", "vrix", "mbo"} <= set(model.words)
    assert [model.predict(t)[0] for t in ("qzu vrix", "mbombombo", docs[0][1])] == ["xx", "xx", "en"]
    sampled = langid.fit(table(spark, docs), sample_docs=60)
    assert sampled.languages == ["en", "xx"] and sampled.predict("qzu vrix")[0] == "xx"


def test_language_ties_and_empty_tables(spark):
    same = [(0, "abc", "b"), (2, "abc", "a"), (3, "abc", None)]
    got = langid.predict(table(spark, same), langid.fit(table(spark, same))).collect()
    assert {(r.lang_pred, round(r.score, 9)) for r in got} == {("a", 0.5)}
    assert langid.predict(table(spark, same).limit(0), langid.fit(table(spark, same))).count() == 0
    assert langid.identify(table(spark, same).limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_matches(items, docs, threshold, overlap):
    """Best verified passage of each document and item: BM25 relative to the item's own score, over all pairs."""
    bare = str.maketrans(string.punctuation, " " * len(string.punctuation))
    split = lambda t: re.findall(r"[^ \t-\r]+", (t or "").lower().translate(bare))
    own = [split(t) for _, t in items]
    count, average, longest = len(items), max(1.0, sum(map(len, own)) / len(items)), max(16, max(map(len, own)))
    df = Counter(w for words in own for w in set(words))
    weights = []
    for words in own:
        tf = Counter(words)
        weights.append({w: math.log1p((count - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / average)) for w, n in tf.items()})
    runs = lambda words, k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    best = {}
    for doc_id, text in docs:
        words = split(text)
        for p in range(-(-len(words) // longest)):
            passage = words[p * longest : (p + 2) * longest]
            held = set(passage)
            for (item_id, _), item, weight in zip(items, own, weights):
                score = sum(v for w, v in weight.items() if w in held) / max(sum(weight.values()), 1e-12)
                if not item or score < threshold:
                    continue
                half = (len(item) + 1) // 2
                shares = []
                for part in (item[:half], item[half:]):
                    want = runs(part, min(3, len(part))) if part else set()
                    shares.append(len(want & runs(passage, min(3, len(part)))) / len(want) if want else 1.0)
                if min(shares) >= overlap and score > best.get((doc_id, item_id), (0, -1.0))[1] + 1e-12:
                    best[doc_id, item_id] = (p, score, *shares)
    return best


def test_decontamination_equals_plain_scoring(spark):
    rng = random.Random(21)
    word = lambda: f"t{rng.randrange(150)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(50)] + [(50, ""), (51, None)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += [word() for _ in range(rng.randrange(20))] + [w for w in items[rng.randrange(50)][1].split() if rng.random() < 0.85]
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, " ".join(word() for _ in range(60_000)) + " " + items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.passage, r.score, r.question_overlap, r.answer_overlap) for r in decontam.matches(table(spark, [(i, t, "en") for i, t in docs]), bench, 0.6, 0.5).collect()}
    want = plain_matches(items, docs, 0.6, 0.5)
    assert set(got) == set(want) and len(want) > 100
    for key, (p, *rest) in want.items():
        assert got[key][0] == p and np.allclose(got[key][1:], rest), key
    assert decontam.matches(table(spark, []), bench).count() == 0 and decontam.remove_leaks(table(spark, []), bench).count() == 0


# ---------------------------------------------------------------- sharding


def plain_draw(key, leaf):
    h = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest() if key is not None else 42
    for x in (leaf.region, leaf.rack, leaf.shard):
        h = xxhash.xxh64(struct.pack("<i", x), seed=h).intdigest()
    return -math.log(((h >> 11) + 0.5) / 2**53) / leaf.weight


def plain_descent(key, tree):
    """Region, then rack, then shard: a node draws the least of what the shards under it draw."""
    now = tree
    for level in ("region", "rack", "shard"):
        draws = {}
        for leaf in now:
            draws.setdefault(getattr(leaf, level), []).append(plain_draw(key, leaf))
        chosen = min(draws, key=lambda x: min(draws[x]))
        now = [leaf for leaf in now if getattr(leaf, level) == chosen]
    return now[0].shard


@pytest.mark.parametrize("weights", [{}, {0: 3.0, 5: 0.5, 7: 0.0, 23: 8.0}])
def test_shards_are_where_the_descent_ends(spark, weights):
    tree = [x for x in sharding.layout(24, weights) if x.weight > 0]
    rows = [(i * 7919, None, None) for i in range(3000)] + [(None, "x", None)]
    got = sharding.assign(table(spark, rows), sharding.layout(24, weights)).collect()
    assert all(r.shard == plain_descent(r.doc_id, tree) for r in got)
    held, whole = Counter(r.shard for r in got), sum(x.weight for x in tree)
    for leaf in tree:
        expected = 3000 * leaf.weight / whole
        assert abs(held[leaf.shard] - expected) < 6 * math.sqrt(expected) + 1
    heavier = sharding.assign(table(spark, rows), sharding.layout(24, weights | {9: 4.0})).collect()
    old = {r.doc_id: r.shard for r in got}
    assert {r.shard for r in heavier if r.shard != old[r.doc_id]} == {9}


def test_sharding_query_equals_plain_python(spark):
    rows = [(i, None if i % 11 == 0 else f"té{i % 50}", None) for i in range(800)] + [(5, "again", None)]
    got = sharding.shard_documents(table(spark, rows), 24).collect()
    new = sharding.layout(25)
    assert all(r.shard == plain_descent(r.doc_id, new[:24]) and r.grown_shard == plain_descent(r.doc_id, new) for r in got)
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)


# ---------------------------------------------------------------- fingerprints


def plain_digest(data: bytes) -> list[int]:
    counts = [0] * 256
    for span, last in ((3, 2), (4, 3)):
        for i in range(len(data) - span + 1):
            x = data[i] | data[i + 1] << 8 | data[i + last] << 16
            x = (x ^ (span << 24)) * 0x9E3779B1 & 0xFFFFFFFF
            x ^= x >> 15
            counts[(x * 0x85EBCA77 & 0xFFFFFFFF) >> 24] += 1
    ordered = sorted(counts)
    q1, q2, q3 = ordered[63], ordered[127], ordered[191]
    quarter = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    top = max(q3, 1)
    head = [zlib.crc32(data) & 255, min(round(math.log1p(len(data)) / math.log(1.25)), 255), (q1 * 100 // top) % 16 | (q2 * 100 // top) % 16 << 4]
    return head + [quarter[i] | quarter[i + 1] << 2 | quarter[i + 2] << 4 | quarter[i + 3] << 6 for i in range(0, 256, 4)]


def plain_likeness(a: list[int], b: list[int]) -> float:
    total = 0
    for x, y in zip(a[3:], b[3:]):
        for shift in (0, 2, 4, 6):
            gap = abs((x >> shift & 3) - (y >> shift & 3))
            total += 6 if gap == 3 else gap
    far = abs(a[1] - b[1])
    total += far if far <= 1 else 6 * (far - 1)
    for shift in (0, 4):
        gap = abs((a[2] >> shift & 15) - (b[2] >> shift & 15))
        gap = min(gap, 16 - gap)
        total += gap if gap <= 1 else 4 * (gap - 1)
    return 1 - min(total + (a[0] != b[0]), 300) / 300


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_fingerprints_equal_plain_python(spark, ranges):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdeé 漢\n") for _ in range(n))
    docs = [(3 * i, text(rng.randrange(400))) for i in range(60)] + [(500, None), (501, ""), (502, "a"), (503, "abc"), (504, text(30_000)), (505, docs_text := text(200)), (506, docs_text)]
    order = sorted(docs)
    want = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        changed = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = (plain_digest(x.encode()) for x in (t, changed, n))
        want[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), plain_likeness(a, b), plain_likeness(a, c))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint.fingerprints(table(spark, [(i, t, None) for i, t in docs]), ranges).collect()}
    assert set(got) == set(want)
    for i, (*texts, x, y) in want.items():
        assert list(got[i][:4]) == texts and abs(got[i][4] - x) < 1e-9 and abs(got[i][5] - y) < 1e-9, i


# ---------------------------------------------------------------- tokens


def test_long_runs_and_parts_of_the_index(spark, monkeypatch):
    """Runs without a boundary, longer than one index, give the library's ids."""
    monkeypatch.setattr(sentencepiece_sa, "INDEXED", 700)
    model = sentencepiece_sa.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    runs = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (399, 401, 699, 701, 5000)] + ["a" * 3000, "ab" * 2000, "the" * 900 + " of " + "x" * 1500]
    for text in runs:
        got = sentencepiece_sa.Encoder(public_tokenizers.path("piece_bpe_32k.model")).encode([text, "short one", text[:50]])
        assert got[0].tolist() == model.library.encode(text) and got[1].tolist() == model.library.encode("short one"), text[:20]


def test_unigram_models_take_the_best_path(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(6)
    spec = proto.ModelProto()
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, True
    spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = True, False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        spec.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256):
        spec.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    several = {"".join(rng.choices("abc", k=rng.randrange(2, 6))) for _ in range(60)}
    for piece in sorted({"a", "b", "c", "▁", "▁a", "▁ab", "▁cab"} | several):
        spec.pieces.add(piece=piece, score=-rng.uniform(2, 12), type=1)
    path = tmp_path / "unigram.model"
    path.write_bytes(spec.SerializeToString())
    encoder = sentencepiece_sa.Encoder(str(path))
    texts = ["", "a", "abc", "cab  ab", "zé abz", *("".join(rng.choices("abc ", k=rng.randrange(1, 200))) for _ in range(50)), "abcab" * 400]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.model.library.encode(text), text


def test_tokens_of_empty_tables_and_of_files_without_safe_boundaries(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sentencepiece_sa.encode(table(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert token_counts.token_counts(table(spark, []), path).count() == 0
    assert token_counts.splits_at_spaces(path) and not token_counts.splits_at_spaces(public_tokenizers.path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    word = public_tokenizers.path("word_bpe_49k.json")
    text = "It's a  Test of runs, " * 9000
    want = len(Tokenizer.from_file(word).encode(text, add_special_tokens=False).ids)
    assert [r.n_tokens for r in token_counts.token_counts(table(spark, [(0, text, None)]), word).collect()] == [want]


# ---------------------------------------------------------------- chat


def test_long_turns(spark):
    long = "word é😀 " * 100_000
    turns = [(0, 0, "user", long), (0, 1, "assistant", long), (1, 0, "user", long), (1, 1, "assistant", long + "!")]
    got = chat.format_pairs(chat.neighbours(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 1 and got[0].prompt == f"<|im_start|>user\n{long}<|im_end|>\n"
    assert got[0].chosen[got[0].chosen_mask[0].start : got[0].chosen_mask[0].end] == long + "<|im_end|>"
    assert got[0].rejected[got[0].rejected_mask[0].start : got[0].rejected_mask[0].end] == long + "!<|im_end|>"
