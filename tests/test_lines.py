"""Lines of large files by byte ranges, and context in tables of lines."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparksift.model import ScanOptions
from sparksift.plans.scan import scan, scan_large
from sparksift.sources import files as sources
from sparksift.sources import lines as L

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def made(rng, n):
    """Bytes of lines with all line ends, empty and long ones, and bytes that aren't UTF-8."""
    out = b""
    for i in range(n):
        body = rng.choice([b"", b"x", b"plain words here", "é ß 漢".encode(), b"\xff\xfe bad", f"k {TOKEN}{i}".encode(), b"token = Zq8fK2mX9vB4nL7pR1sT6wY3dG5hJ0aCeF+kQ", b"y" * rng.randrange(300)])
        out += body + rng.choice([b"\n", b"\r\n", b"\r", b"\n"])
    return out + rng.choice([b"", b"last", b"last\r", b"last\r\n"])


@pytest.mark.parametrize("read", [1, 7, 64, 1 << 20])
def test_ranges_cut_no_line(tmp_path, monkeypatch, read):
    monkeypatch.setattr(L, "READ_BYTES", read)
    rng = random.Random(read)
    for n in range(6):
        data = made(rng, rng.randrange(6)) if n else b""
        path = tmp_path / f"f{n}"
        path.write_bytes(data)
        whole = data.splitlines()
        for each in (1, 3, 10, 50, 1000):
            options = {"files": f'[["file://{path}", "{path}", {len(data)}]]', "rangeBytes": str(each)}
            reader, counter = L.LineReader(options), L.LineReader(options | {"mode": "count"})
            got, counts = [], []
            for part in reader.partitions():
                rows = [r for b in reader.read(part) for r in b.to_pylist()]
                assert [r["at"] for r in rows] == list(range(len(rows)))
                got += rows
                counts += [r["n"] for b in counter.read(part) for r in b.to_pylist()]
            assert [r["content"] for r in got] == whole and sum(counts) == len(whole)
            assert [r["before"] for r in got] == [b"\n".join(whole[max(0, i - 2) : i]) for i in range(len(whole))]
            assert [r["after"] for r in got] == [b"\n".join(whole[i + 1 : i + 3]) for i in range(len(whole))]


def test_large_files_by_ranges_equal_the_whole(spark, tmp_path):
    rng = random.Random(4)
    paths = []
    for name in ("a.log", "b.min.js", "c.txt"):
        (tmp_path / name).write_bytes((b"secret talk\n" if name != "c.txt" else b"") + made(rng, 3000) + f"end {TOKEN}".encode())
        paths.append((f"file://{tmp_path / name}", str(tmp_path / name), os.path.getsize(tmp_path / name)))
    options = ScanOptions(decode_hex=True, large_file_bytes=1000)
    key = lambda r: tuple(str(x) for x in r)
    columns = ("file", "line", "rule", "severity", "secret", "context", "entropy", "column", "context_before", "context_after")
    whole = sorted((tuple(r) for r in scan(sources.read_files(spark, str(tmp_path), skip_binary=False), options).select(*columns).collect()), key=key)
    parts = scan_large(spark, paths, options, range_bytes=4000)
    assert L.large_file_lines(spark, paths, 4000)[0].rdd.getNumPartitions() > 50
    assert sorted((tuple(r) for r in parts.select(*columns).collect()), key=key) == whole
    assert len(whole) > 200 and {r[2] for r in whole} >= {"github_personal_access_token", "high_entropy_token"}
    assert scan_large(spark, [], options).count() == 0


def test_scanner_reads_the_largest_files_by_lines(spark, tmp_path, monkeypatch):
    from sparksift.api import Scanner

    monkeypatch.setattr(sources, "LINES_FROM", 5000)
    (tmp_path / "small.txt").write_text(f"k {TOKEN}")
    (tmp_path / "large.txt").write_text("plain\n" * 2000 + f"k {TOKEN}\n")
    found = Scanner(spark, ScanOptions(entropy=False)).scan_paths([str(tmp_path)], mode="raw", max_bytes=1 << 30).findings.collect()
    assert {(os.path.basename(r.file), r.line) for r in found if r.rule == "github_personal_access_token"} == {("small.txt", 1), ("large.txt", 2001)}


def test_context_of_line_tables(spark):
    rng = random.Random(6)
    rows = [(f, i, rng.choice([None, "", f"{f}{i}"])) for f, n in (("a", 1), ("b", 2), ("c", 3), ("hot", 900), (None, 30)) for i in range(1, n + 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "file string, line long, line_text string").withColumn("context_after", F.lit(1)).withColumn("at", F.lit(2))
    by = {(f, i): t or "" for f, i, t in rows}
    for block in (4, 5, 100, 4096):
        got = L.with_line_context(table, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            near = lambda steps, r=r: "\n".join(by[r.file, r.line + k] for k in steps if (r.file, r.line + k) in by)
            assert (r.context_before, r.context_after) == (near([-2, -1]), near([1, 2])), (block, r)
    assert L.with_line_context(table.limit(0)).count() == 0


def test_numbers_without_gaps(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(10**6), i) for i, k in enumerate(["hot"] * 3000 + ["a", "b", "b", None, None])]
    got = L.numbered(spark.createDataFrame(rows, "key string, time long, id long"), "key", ["time", "id"], "place").collect()
    expected = {}
    for k in {k for k, *_ in rows}:
        expected |= {(k, i): n for n, (_, i) in enumerate(sorted((t, i) for key, t, i in rows if key == k), 1)}
    assert {(r.key, r.id): r.place for r in got} == expected and len(got) == len(rows)
    wide = L.with_numbers(spark.createDataFrame(rows, "key string, time long, id long").withColumn("text", F.lit("x")).withColumn("place", F.lit("old")), "key", ["time", "id"], "place")
    assert {(r.key, r.id): r.place for r in wide.collect()} == expected and set(wide.columns) == {"key", "time", "id", "text", "place"}
