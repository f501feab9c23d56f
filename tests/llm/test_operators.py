"""The training-data operators against brute force, on small tables with nulls,
empty and long texts, ties, repeated rows and clashing column names."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparksift.llm import chat, common, decontam, fingerprint, langid, near_dup, queries, sentencepiece_sa, sharding, substring_dedup, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents, with columns whose names the operators use themselves."""
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).withColumn("score", F.lit(7)).withColumn("found", F.lit("x"))


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [words(rng, 60) for _ in range(6)]
    out = [(i, t, "en") for i, t in enumerate(base)]
    for k in range(12):  # near copies: a few words changed
        w = base[k % 3].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append((20 + k, " ".join(w), "en"))
    out += [(40, base[0], "en"), (41, base[0], None), (42, base[0].upper(), "en")]
    out += [(50, None, "en"), (51, "", "en"), (52, " \n\t ", None), (53, "one", "en"), (54, "One", "en"), (55, "a b", None), (None, base[1], "en")]
    out += [(60, words(rng, 6000), "en"), (61, base[4] + "\n" + base[5] + " tail", "en"), (3, base[3], "en"), (70, "word " * 3000, "en"), (71, "word " * 40, "en"), (72, "é" * 30 + "😀 ü " + base[2], "de")]
    return out


# ---------------------------------------------------------------- substring dedup


def test_substring_dedup(spark, rows):
    got = {}
    for r in substring_dedup.remove_repeats(table(spark, rows), 13).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and got[50][0].found == "x"
    earliest = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - 12) if i is not None else ():
            key = tuple(w[j : j + 13])
            earliest[key] = min(i, earliest.get(key, i))
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 12) if i is not None else ():
            if earliest[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        want = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
        assert want in [(r.n_words, r.n_removed, r.kept_sha256) for r in got[i]], i
        for r in got[i]:
            assert (r.kept_text is None) == (t is None)
            assert (r.kept_text or "").split() == left.decode().split()
    assert substring_dedup.remove_repeats(table(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- near-dedup


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= percent * len(x | y):
                            p, q = sorted((root(a), root(b)))
                            parent[q] = p
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, k, percent):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().translate(lower).split()
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        if i is not None:
            sets.setdefault(i, []).append(s)
    want = components(sets, percent)
    got = near_dup.near_duplicates(table(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
    assert near_dup.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_links_outside_the_pivots_component(spark):
    """A chain of texts, each like the next only: one component, though no pivot is like all."""
    rng = random.Random(3)
    w = [f"v{rng.randrange(10**9)}" for _ in range(200)]
    chain = []
    for i in range(12):
        chain.append((i, " ".join(w), None))
        for j in range(3):
            w[(i * 17 + j) % 200] = f"u{rng.randrange(10**9)}"
    got = near_dup.near_duplicates(table(spark, chain), 3, 85).collect()
    sets = {i: [frozenset(zip(t.split(), t.split()[1:], t.split()[2:]))] for i, t, _ in chain}
    assert {r.doc_id: r.component_id for r in got} == components(sets, 85)


@pytest.mark.parametrize("pivots", [1, 3])
def test_links_between_texts_unlike_the_pivot(spark, monkeypatch, pivots):
    """Near-copied excerpts, a chain of them and bridges beside a large group of copies that has all the pivots."""
    monkeypatch.setattr(near_dup, "PIVOTS", pivots)

    def one_bucket(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0] * batch.num_rows, pa.int64()), batch.column(0)], names=["key", "rep"])

    monkeypatch.setattr(near_dup, "_bands", one_bucket)  # so that no other bucket helps
    rng = random.Random(11)
    w = [f"v{rng.randrange(10**9)}" for _ in range(300)]
    fresh = lambda t, n: [f"u{rng.randrange(10**9)}" if rng.randrange(len(t)) < n else x for x in t]
    docs = [(i, fresh(w, 2)) for i in range(12)]
    docs += [(100 + i, fresh(w[:150], 2)) for i in range(8)]  # excerpts
    docs += [(200 + i, w[: 290 - 22 * i]) for i in range(12)]  # shorter and shorter: each like the next only
    tail = [f"t{rng.randrange(10**9)}" for _ in range(300)]
    docs += [(300 + i, w[200:] + fresh(tail, 2)) for i in range(8)]  # longer
    docs += [(400 + i, w[30 * i : 30 * i + 100] + tail[20 * i : 20 * i + 15]) for i in range(7)]
    docs += [(500 + i, w[30 * i : 30 * i + 100] + tail[20 * i : 20 * i + 18]) for i in range(7)]
    docs = [(i, " ".join(t), None) for i, t in docs]
    sets = {i: [frozenset(zip(t.split(), t.split()[1:], t.split()[2:]))] for i, t, _ in docs}
    got = near_dup.near_duplicates(table(spark, docs), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets, 85)


def test_links_among_texts_of_shared_sentences(spark):
    """Texts drawn from one pool of sentences, alike by about a half, and pairs planted just over the threshold and near 1."""
    rng = random.Random(5)
    pool = [[f"s{i}w{j}" for j in range(10)] for i in range(120)]
    docs = [[w for s in rng.sample(pool, 77) for w in s] for _ in range(400)]
    for i in range(60):
        copy = list(docs[i])
        for j in rng.sample(range(len(copy) // 4), (3, 8, 18)[i % 3]):
            copy[4 * j] = f"new{i}x{j}"
        docs.append(copy)
    sets = [set(zip(t, t[1:], t[2:])) for t in docs]
    at = {s: i for i, s in enumerate(set().union(*sets))}
    held = np.zeros((len(docs), len(at)), np.float32)
    for i, s in enumerate(sets):
        held[i, [at[x] for x in s]] = 1
    common = (held @ held.T).round()
    sizes = np.diag(common)
    want = list(range(len(docs)))
    links = np.argwhere(100 * common >= 85 * (sizes[:, None] + sizes - common))
    assert sum(a < b for a, b in links) >= 55 and (common[:400, :400].sum() - sizes[:400].sum()) / 400 / 399 > 0.5 * sizes.mean()
    for _ in range(3):
        for a, b in links:
            want[b] = min(want[a], want[b])
    got = near_dup.near_duplicates(table(spark, [(i, " ".join(t), None) for i, t in enumerate(docs)]), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("percent", [80, 85])
def test_crossing_pairs_lose_no_link(spark, percent):
    """All links between components come out of the prefix join, for sets of very different sizes and commonness."""
    rng = random.Random(percent)
    rows, sets = [], {}
    for i in range(160):
        core = range(rng.choice([20, 40, 200]))
        s = {x for x in core if rng.random() > 0.06} | {1000 + rng.randrange(300) for _ in range(rng.randrange(6))} | {10_000 + 50 * i + j for j in range(rng.randrange(8))}
        sets[i] = s
        rows.append((i, i, i // 8 * 8 if i % 3 else i, np.array(sorted(s), np.uint64).tobytes()))
    component = {r[0]: r[2] for r in rows}
    df = spark.createDataFrame([(x, h, c, bytearray(s)) for x, h, c, s in rows], "x long, h long, c long, set binary")
    got = {(r.a, r.b) for r in near_dup.crossing_pairs(df, percent).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert len(want) > 20 and want <= got and all(component[a] != component[b] for a, b in got)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    parts = near_dup.registers(np.concatenate([np.sort(a[:1000]), np.sort(a[1000:])]), np.array([0, 1000, 3000]))
    whole = near_dup.registers(np.sort(a), np.array([0, 3000]))
    assert (parts.max(0) == whole[0]).all()
    both = near_dup.registers(np.concatenate([np.sort(a[:2000]), np.sort(a[1000:])]), np.array([0, 2000, 4000]))
    j = near_dup.estimate(both[:1], both[1:], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1000 / 3000) < 0.2


# ---------------------------------------------------------------- WARC


def test_warc_queries_and_frames(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/", None), (4, "u", ""), (None, "http://c/", "<p>x</p>"), (5, "http://d/", "é" * 100_000), (6, "x\r\ny", "z"), (6, "w", "z2")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert len(got) == len(pages) and all(r.error is None for r in got)
    for i, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        kind = "response" if i == max(same) else "revisit"
        want = (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else max(same))
        assert want in [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
        assert all(r.payload == data for r in got if r.page_id == i and r.record_type == "response" and r.payload_bytes == len(data))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_rejects_broken_archives():
    good = warc.record(1, "http://a/", b"hello", warc.digest(b"hello"), "response", None)
    archive = warc.write_batch(iter([good, good]))
    assert list(warc.frames(archive)) == [good, good]
    assert warc.parse(good)["payload"] == b"hello"
    for broken in (archive[:-3], archive + b"junk junk", archive[:20]):
        with pytest.raises(ValueError):
            list(warc.frames(broken))
    for broken in (good.replace(b"hello", b"hellp"), good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: ", b"Content-Lenght: ")):
        with pytest.raises(ValueError):
            warc.parse(broken)


# ---------------------------------------------------------------- tokens


def test_sentencepiece_equals_the_library(spark, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_sa.load(path)
    odd = [(100 + i, t, "en") for i, t in enumerate(["  a", "a  b   c\n\n\td", "▁x ▁", "漢字 😀 1234567", "a" * 900 + " " * 900 + "b", "\x00 a", "<s> <unk> <0x0A>", "It's   fine."])]
    every = rows + odd
    texts = [t for _, t, _ in every]
    got = sentencepiece_sa.encode(table(spark, every), path).select("doc_id", "text", "ids", "n_tokens", "round_trip", "found").collect()
    assert len(got) == len(texts)
    for r in got:
        if r.text is None:
            assert r.ids is None and r.round_trip is None
        else:
            assert r.ids == model.library.encode(r.text) and r.n_tokens == len(r.ids)
            assert r.round_trip and sentencepiece_sa.decode(model, np.array(r.ids, np.int32)) == model.library.decode(r.ids)


def test_suffix_array_finds_all_occurrences():
    rng = np.random.default_rng(0)
    codes = rng.integers(1, 4, 300).astype(np.uint32)
    order = sentencepiece_sa.suffix_array(codes, 8)
    heads = [tuple(codes[i : i + 8]) for i in order]
    assert heads == sorted(heads)


def test_token_counts(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    every = rows + [(200, "a <|endoftext|> b  <|endoftext|>c", "en"), (201, ("It's a\n\n test  of  runs " * 8000), "en")]
    got = token_counts.token_counts(table(spark, every), path).collect()
    assert len(got) == len(every)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in every)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


# ---------------------------------------------------------------- language ID


def test_language_id(spark):
    rng = random.Random(5)
    vocabulary = {"en": ["the", "thing", "with", "that", "holding"], "de": ["und", "nicht", "einen", "zeitung", "über"], "fr": ["le", "été", "vous", "manière", "qui"]}
    docs = [(i, " ".join(rng.choices(vocabulary[lang], k=rng.randrange(1, 40))), lang) for i, lang in enumerate(rng.choices(list(vocabulary), k=300))]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "en"), (1003, "zeitungen", None), (None, "the thing", "en"), (1000, "the with", "en")]
    got = langid.identify(table(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang and r.doc_id is not None:
            assert r.lang_pred == r.lang
    assert next(r for r in got if r.doc_id == 1003).lang_pred == "de"
    assert {r.lang_pred for r in langid.predict(table(spark, docs), langid.fit(table(spark, docs).limit(0))).collect()} == {"und"}


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randrange(15, 60), 3000)) for i in range(60)] + [(60, None), (61, ""), (3, words(rng, 20, 3000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, words(rng, rng.randrange(1, 300), 3000), "en") for i in range(40)]
    planted = {}
    for i in range(100, 130):
        item, text = rng.choice(items[:60])
        planted[i] = item
        docs.append((i, f"{words(rng, rng.randrange(200), 3000)} {text.upper() if i % 2 else text.replace(' ', ', ')}. {words(rng, rng.randrange(200), 3000)}", "en"))
    docs += [(200, None, "en"), (201, "", "en"), (None, "x " + items[0][1], "en")]
    got = decontam.matches(table(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} >= set(planted.items())
    assert {r.doc_id for r in got} - set(planted) <= {None}
    clean = decontam.remove_leaks(table(spark, docs), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, *_ in docs} - set(planted) - {None} and "found" in clean.columns
    assert decontam.matches(table(spark, docs), bench.limit(0)).count() == 0


def test_parts_of_the_benchmark_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(13)
    items = [(i, words(rng, rng.randrange(5, 60), 200)) for i in range(60)] + [(60, None), (61, ""), *[(62, words(random.Random(2), 20, 200))] * 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = []
    for i in range(40):  # items with words left out, near the threshold
        part = [x for x in items[rng.randrange(60)][1].split() if rng.random() < 0.8]
        docs.append((i, f"{words(rng, 30, 200)} {' '.join(part)} {words(rng, 30, 200)}", "en"))
    docs.append((100, items[-1][1], "en"))
    found = lambda: sorted((r.doc_id, r.item_id, r.passage, round(r.score, 9)) for r in decontam.matches(table(spark, docs), bench, 0.5, 0.3).collect())
    whole = found()
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 60)
    assert len(whole) > 40 and found() == whole
    assert max(len(index.ids) for index in decontam.indexes(bench)) <= 60


def test_wand_equals_full_scoring():
    rng = random.Random(9)
    items = [(i, words(rng, 30, 60), None, None) for i in range(50)]
    index = decontam.build(items)
    for _ in range(40):
        query = np.array(sorted(rng.sample(range(len(index.vocabulary)), 25)))
        scores = np.zeros(len(items))
        for t in query:
            np.add.at(scores, index.items[index.first[t] : index.first[t + 1]], index.impacts[index.first[t] : index.first[t + 1]])
        for threshold in (0.2, 0.5, 0.7):
            found = dict(decontam.wand(index, query, threshold))
            assert {i for i, s in enumerate(scores) if s >= threshold + 1e-9} <= set(found) <= {i for i, s in enumerate(scores) if s >= threshold - 1e-9}


# ---------------------------------------------------------------- sharding, fingerprints, chat


def test_sharding(spark, rows):
    many = rows + [(1000 + i, f"t{i}", None) for i in range(3000)]
    got = sharding.shard_documents(table(spark, many), 24).collect()
    assert len(got) == len(many)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    texts = {i: (t or "").encode() for i, t, _ in many}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got if r.doc_id not in (None, 3))
    assert 40 < sum(r.grown_shard == 24 for r in got) < 240
    again = {r.doc_id: r.grown_shard for r in got}
    assert all(r.shard == again[r.doc_id] for r in sharding.assign(table(spark, many), sharding.layout(25)).collect())
    heavy = sharding.assign(table(spark, many), sharding.layout(24, {5: 3.0})).collect()
    old = {r.doc_id: r.shard for r in got}
    assert all(r.shard in (old[r.doc_id], 5) for r in heavy)
    assert sharding.shard_documents(table(spark, many).limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [1, 2, 7, None])
def test_fingerprints(spark, rows, ranges):
    got = fingerprint.fingerprints(table(spark, rows), ranges).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1]):
        changed = fingerprint.edited(t or "", n or "")
        a, b, c = (fingerprint.digests([x.encode()])[0] for x in (t or "", changed, n or ""))
        near = [float(fingerprint.likeness(a[None], x[None])[0]) for x in (b, c)]
        want.append((i is not None, i or 0, len(t or ""), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), *near))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)
    assert fingerprint.fingerprints(table(spark, rows).limit(0)).count() == 0


def test_digest_counts_triplets():
    texts = [b"", b"a", b"ab", b"abc", b"abcd" * 50, bytes(range(256))]
    counts = fingerprint._counts(texts)
    assert counts.sum(1).tolist() == [max(0, len(t) - 2) + max(0, len(t) - 3) for t in texts]
    assert (fingerprint._counts([texts[4]])[0] == counts[4]).all()


def test_chat(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", None),
        (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"),
        (2, 0, "user", "x"), (2, 1, None, "y"), (3, 1, None, "y"), (3, 0, "user", "x"),
        (4, 0, "assistant", "alone"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))
    got = {r.pair_id: r for r in chat.format_pairs(chat.neighbours(df)).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[0].prompt_turns == 1 and got[0].rejected_turns == 2
    assert [got[0].chosen[s.start : s.end] for s in got[0].chosen_mask] == ["a<|im_end|>"]
    assert [got[0].rejected[s.start : s.end] for s in got[0].rejected_mask] == ["b<|im_end|>"] * 2
    assert got[1].identical and got[1].chosen == got[1].rejected == "" and got[1].prompt_turns == 2
    assert got[2].prompt == got[2].rejected == "" and got[2].chosen_turns == 1 and not got[2].identical
    assert chat.format_pairs(chat.neighbours(df.limit(0))).count() == 0


# ---------------------------------------------------------------- shared helpers, registry


def test_skew_join_keeps_all_rows(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, F.lit(0)).otherwise(F.col("id")).alias("k"), F.lit("v").alias("extra"))
    left = left.withColumn("k", F.when(F.col("id") != 999, F.col("k")))
    groups = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = common.skew_join(left, groups, "k", "n", 1000, "id").collect()
    assert len(got) == 1000 and all(r.top == (699 if r.k == 0 else r.id if r.k is not None else None) for r in got)


def test_words_are_split_at_ascii_white_space_only():
    text = "a\x1cb c\x0bd  éa\n\tz"
    hashes, starts, ends = common.words(text.encode())
    assert [text.encode()[s:e] for s, e in zip(starts, ends)] == text.encode().split() and len(set(hashes.tolist())) == len(hashes)
    assert (common.words(b"ABC \xc3\x89", True)[0] == common.words(b"abc \xc3\x89", True)[0]).all()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
