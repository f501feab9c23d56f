"""The frontier of a crawl as a stateful stream: which URL is asked for when.

Events are URLs that were found and requests that have ended; what comes out are requests.  Hosts
are dealt out to lanes, each a key of the state with an equal part of the rate: a lane makes a
request every `lanes / rate` seconds at most, so all together keep the rate wherever they run, and a
host has at most `most_open` requests that haven't ended.  No URL is asked for twice.  A lane's state is what
it has seen, what waits, and what is open; a timer wakes it when its next request may be made.
Time is that of the events, as the watermark has it.  Fetching itself is left to what reads the requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.structured import script_urls

REQUEST = "lane int, host string, url string, level int, at timestamp"
FOUND, ENDED = "found", "ended"


def host_of(url):
    """Host and port of a URL, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


class Lane(StatefulProcessor):
    def __init__(self, interval_ms: int, most_open: int, depth: int):
        self.interval, self.most_open, self.depth = interval_ms, most_open, depth

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "level int")
        self.open = handle.getMapState("open", "url string", "host string")
        self.busy = handle.getMapState("busy", "host string", "n int")
        self.waiting = handle.getMapState("waiting", "place bigint", "url string, host string, level int")
        self.clock = handle.getValueState("clock", "free bigint, place bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free, place, timer = self.clock.get() if self.clock.exists() else (0, 0, -1)
        now = timerValues.getCurrentWatermarkInMs()
        events = pd.concat(list(rows)).sort_values(["ts", "kind", "level", "url"])  # a request that ends makes room first
        for kind, url, host, level, ts in zip(events["kind"], events["url"], events["host"], events["level"], events["ts"], strict=True):
            now = max(now, int(pd.Timestamp(ts).timestamp() * 1000))
            if kind == ENDED and self.open.containsKey((url,)):
                self.open.removeKey((url,))
                self.busy.updateValue((host,), (max(0, self.busy.getValue((host,))[0] - 1),))
            elif kind == FOUND and level <= self.depth and not self.seen.containsKey((url,)):
                self.seen.updateValue((url,), (int(level),))
                self.waiting.updateValue((place,), (url, host, int(level)))
                place += 1
        self.clock.update((free, place, timer))
        yield from self._ask(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        free, place, _ = self.clock.get()
        self.clock.update((free, place, -1))
        yield from self._ask(key, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))

    def _ask(self, key, now: int) -> Iterator[pd.DataFrame]:
        """The requests that may be made up to now, oldest first; a timer for the next, if one is ready."""
        free, place, timer = self.clock.get()
        asked, ready = [], False
        for (at,), (url, host, level) in sorted(self.waiting.iterator()):
            n = self.busy.getValue((host,))[0] if self.busy.containsKey((host,)) else 0
            if n >= self.most_open:
                continue
            if free > now:
                ready = True
                break
            moment = max(free, now) if self.interval == 0 or not asked else free
            asked.append((key[0], host, url, level, pd.Timestamp(moment, unit="ms")))
            free = moment + self.interval
            self.waiting.removeKey((at,))
            self.open.updateValue((url,), (host,))
            self.busy.updateValue((host,), (n + 1,))
        if ready and timer != free:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(free)
            timer = free
        self.clock.update((free, place, timer))
        if asked:
            yield pd.DataFrame(asked, columns=["lane", "host", "url", "level", "at"])

    def close(self) -> None:
        """Nothing is held beside the state."""


def requests(events: DataFrame, rate: float = 50, most_open: int = 5, depth: int = 1, lanes: int = 8, late: str = "0 seconds") -> DataFrame:
    """(lane, host, url, level, at): the requests of a stream of events (kind, url, level, ts).

    rate: requests a second in all, 0 for any number; depth: URLs of deeper levels aren't asked for.  URLs without a
    host are left out.  The session needs the state store of RocksDB (`use_rocksdb`)."""
    interval = round(1000 * lanes / rate) if rate > 0 else 0
    rows = events.withColumn("host", host_of(F.col("url"))).where("host <> '' and ts is not null")
    laned = rows.withWatermark("ts", late).select(F.pmod(F.xxhash64("host"), F.lit(lanes)).cast("int").alias("lane"), "kind", "url", "host", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "ts")
    return laned.groupBy("lane").transformWithStateInPandas(statefulProcessor=Lane(interval, max(1, most_open), depth), outputStructType=REQUEST, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark) -> None:
    """The state store that states of several tables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def page_events(pages: DataFrame) -> DataFrame:
    """Events of fetched pages (url, text, level, ts): the request has ended, and the scripts that the page quotes are found."""
    ended = F.array(F.struct(F.lit(ENDED).alias("kind"), F.col("url").alias("url"), F.col("level").cast("int").alias("level")))
    found = script_urls(pages.select(F.col("url").alias("from"), "level", "ts", "text")).select(F.lit(FOUND).alias("kind"), F.col("script_url").alias("url"), (F.col("level") + 1).cast("int").alias("level"), "ts")
    return pages.select(F.inline(ended), "ts").select("kind", "url", "level", "ts").unionByName(found)
