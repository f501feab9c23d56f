"""The frontier of a crawl: times of requests, open requests a host, and no URL twice."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from sparksift.streaming import frontier as R

START = dt.datetime(2024, 1, 1)
EVENT = "kind string, url string, level int, ts timestamp"


def seconds(t):
    return round((t - START).total_seconds(), 3)


def run(spark, tmp_path, batches, **limits):
    """Requests after each batch of events (kind, url, level, second)."""
    R.use_rocksdb(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = spark.readStream.schema(EVENT).parquet(str(source))
    seen, each = set(), []
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame([(k, u, n, START + dt.timedelta(seconds=s)) for k, u, n, s in rows], EVENT)
        frame.coalesce(1).write.mode("append").parquet(str(source))
        query = R.requests(stream, **limits).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
        assert query.awaitTermination(180), number
        now = {(r.host, r.url, r.level, seconds(r["at"])) for r in spark.read.parquet(str(out)).collect()}
        each.append(sorted(now - seen, key=lambda r: r[3]))
        seen |= now
    return each


def test_requests_keep_rate_and_open_limit(spark, tmp_path):
    urls = [f"http://A.example:80/{i}.js" for i in range(5)] + ["https://u:p@b.example/x.js"]
    batches = [
        [("found", u, 0, 10) for u in urls] + [("found", urls[0], 0, 10), ("found", "no-url", 0, 10), ("found", "http://c/deep.js", 3, 10)],
        [("tick", "http://t/", 0, 30)],  # time goes on: the timer fires once the watermark has passed it
        [("tick", "http://t/", 0, 31)],
        [("ended", urls[0], 0, 40), ("found", urls[1], 1, 40)],
        [("ended", urls[1], 0, 60), ("ended", urls[1], 0, 60), ("ended", urls[2], 0, 61)],
        [("tick", "http://t/", 0, 90)],
        [("tick", "http://t/", 0, 120)],
        [("tick", "http://t/", 0, 121)],
    ]
    each = run(spark, tmp_path, batches, rate=0.5, most_open=2, depth=2, lanes=1)
    asked = [r for rows in each for r in rows]
    assert len({u for _, u, *_ in asked}) == len(asked) and {u for _, u, *_ in asked} <= set(urls)
    times = sorted(t for *_, t in asked)
    assert times[0] == 10 and all(b - a >= 2 for a, b in zip(times, times[1:]))
    assert {h for h, *_ in asked} == {"a.example:80", "b.example"}
    # two of a host at a time until one ends
    ends = {urls[0]: 40, urls[1]: 60, urls[2]: 61}
    for host in {h for h, *_ in asked}:
        spans = [(t, ends.get(u, 10**9)) for h, u, _, t in asked if h == host]
        assert all(sum(a <= t < b for a, b in spans) <= 2 for t, _ in spans)
    assert {u for _, u, *_ in asked} == set(urls)


def test_without_limits_all_are_asked_for_at_once(spark, tmp_path):
    urls = [f"http://h{i % 7}.example/{i}" for i in range(40)]
    each = run(spark, tmp_path, [[("found", u, 0, 5) for u in urls], [("found", u, 0, 9) for u in urls]], rate=0, most_open=100, lanes=3)
    by = defaultdict(list)
    for h, u, _, t in each[0]:
        by[h].append((u, t))
    assert {u for own in by.values() for u, _ in own} == set(urls) and {t for own in by.values() for _, t in own} == {5.0} and each[1] == []


def test_events_of_pages(spark):
    pages = spark.createDataFrame([("http://a/", 'x "https://a/s.js" "https://b/t.js" "https://a/s.js"', 0, START), ("http://n/", None, 1, START)], "url string, text string, level int, ts timestamp")
    got = sorted((r.kind, r.url, r.level) for r in R.page_events(pages).collect())
    assert got == [("ended", "http://a/", 0), ("ended", "http://n/", 1), ("found", "https://a/s.js", 1), ("found", "https://b/t.js", 1)]
    hosts = spark.createDataFrame([("HTTP://u:p@Ho.st:81/x",), ("http://h?q",), ("x",), (None,)], "u string").select(R.host_of(F.col("u")).alias("h"))
    assert [r.h for r in hosts.collect()] == ["ho.st:81", "h", "", None]
