"""Tables that change whole or not at all, and the caches in them."""

import gzip
import threading

import pytest
from pyspark.sql import functions as F

from sparksift.model import ScanOptions
from sparksift.operators import cache
from sparksift.plans.scan import scan
from sparksift.sources.snapshots import Snapshots

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3
PLAIN = ScanOptions(entropy=False, decode_base64=False, json=False)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def read(tables, name="t"):
    return sorted(r.n for r in tables.read(name, "n long").collect())


def test_changes(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "s"))
    assert tables.current() == (0, {}) and read(tables) == []
    tables.append(t=numbers(spark, 1, 2), u=numbers(spark, 7))
    base = tables.current()[1]
    tables.append(t=numbers(spark, 3))
    tables.replace(base, t=numbers(spark, 1))
    assert read(tables) == [1, 3] and read(tables, "u") == [7] and tables.current()[0] == 3
    assert sorted(r.n for r in tables.read("t", "n long", base).collect()) == [1, 2]
    tables.vacuum()
    assert read(tables) == [1, 3] and len(list((tmp_path / "s" / "data").iterdir())) == 3
    tables.drop()
    assert read(tables) == [] and tables.current()[0] == 4


@pytest.mark.parametrize("step", ["write", "_claim", "rename"])
def test_a_change_that_fails_leaves_the_tables_as_they_were(spark, tmp_path, monkeypatch, step):
    tables = Snapshots(spark, str(tmp_path / "s"))
    tables.append(t=numbers(spark, 1))
    other = Snapshots(spark, str(tmp_path / "s"))
    if step == "rename":
        class Broken:
            def __getattr__(self, name):
                if name == "rename":
                    raise RuntimeError("lost")
                return getattr(tables._system, name)

        other._system = Broken()
    else:
        def fail(*_):
            raise RuntimeError("lost")

        monkeypatch.setattr(other, step, fail)
    for change in (lambda: other.append(t=numbers(spark, 2)), lambda: other.replace(other.current()[1], t=numbers(spark, 3))):
        with pytest.raises(RuntimeError, match="lost"):
            change()
        assert read(tables) == [1]
    tables.append(t=numbers(spark, 4))
    assert read(tables) == [1, 4]
    tables.vacuum()
    assert read(tables) == [1, 4] and len(list((tmp_path / "s" / "data").iterdir())) == 2


def test_a_claim_that_was_left_behind(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "s"))
    tables.append(t=numbers(spark, 1))
    tables.TRIES, tables.WAIT = 1, 0.01
    assert tables._claim(2) and not tables._claim(2)
    with pytest.raises(TimeoutError):
        tables.append(t=numbers(spark, 2))
    tables.append(t=numbers(spark, 3))
    assert read(tables) == [1, 3]


def test_changes_at_a_time_are_all_kept(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "s"))
    writes = [tables.write(numbers(spark, i)) for i in range(6)]

    def add(w):
        Snapshots(spark, str(tmp_path / "s")).change(lambda parts: parts | {"t": [*parts.get("t", []), w]})

    threads = [threading.Thread(target=add, args=(w,)) for w in writes]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert read(tables) == [0, 1, 2, 3, 4, 5] and tables.current()[0] == 6


def test_result_cache_keeps_all_when_a_rewrite_fails(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(f"d{i}/a.py", TOKEN if i % 3 else f"k {TOKEN}{i}") for i in range(40)], "file string, text string")
    store = cache.ResultCache(spark, str(tmp_path / "c"))
    rows = lambda df: sorted(map(tuple, df.drop("seq").collect()))
    fresh = rows(scan(texts, PLAIN))
    assert rows(cache.scan_cached(texts, store, PLAIN, now=0.0)) == fresh
    monkeypatch.setattr(store.tables, "change", lambda make: (_ for _ in ()).throw(RuntimeError("lost")))
    for step in (lambda: store.cleanup(now=1.0), lambda: store.invalidate(TOKEN, now=1.0), store.clear):
        with pytest.raises(RuntimeError):
            step()
    monkeypatch.undo()
    known, left = store.split(texts, PLAIN, now=2.0)
    assert left.count() == 0 and rows(cache.scan_cached(texts, store, PLAIN, now=2.0)) == fresh
    store.invalidate(TOKEN, now=3.0)
    assert {r.text for r in store.split(texts, PLAIN, now=4.0)[1].collect()} == {TOKEN}
    assert rows(cache.scan_cached(texts, store, PLAIN, now=5.0)) == fresh and store.split(texts, PLAIN, now=6.0)[1].count() == 0
    monkeypatch.setattr(cache, "MOST_PARTS", 1)
    monkeypatch.setattr(cache, "KEYS_SENT", 0)
    assert rows(cache.scan_cached(texts.union(texts.withColumn("text", F.lit("new"))), store, PLAIN, now=7.0)) == fresh
    assert max(map(len, store.tables.current()[1].values())) == 1 and store.split(texts, PLAIN, now=8.0)[1].count() == 0


def test_contents_that_differ_in_bad_bytes_only_have_two_keys(spark, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path / "c"))
    packed = gzip.compress("\n".join([f"key {TOKEN}", *(str(i * 7919) for i in range(60))]).encode())
    spoilt = packed[:-1] + bytes([packed[-1] ^ 0x80])
    files = spark.createDataFrame([("a.gz", bytearray(packed)), ("b.gz", bytearray(spoilt))], "file string, content binary").withColumn("text", F.lit("same text"))
    assert store.keyed(files).select("content_key").distinct().count() == 2
