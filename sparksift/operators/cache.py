"""Caches as tables: results by content, URLs by address, with a time to live."""

from __future__ import annotations

import hashlib
import time
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FINDING, INTERNAL, ScanOptions
from ..sources.shared import skew_join, staged
from ..sources.snapshots import Parts, Snapshots

VERSION = 2
RESULT_SECONDS, URL_SECONDS = 14 * 86400, 24 * 3600
#: Kinds of file names that a scan treats apart, by what the lower-cased name ends with; the first that fits.
KINDS = ((r"\.json$", ".json"), (r"(\.min\.js|\.bundle\.js|\.min\.mjs)$", ".min.js"), (r"\.m?js$", ".js"))


def options_key(options: ScanOptions) -> str:
    """All that a result depends on besides content and kind of name: flags and rules."""
    return hashlib.sha256(repr((VERSION, sorted(asdict(options).items(), key=str))).encode()).hexdigest()[:16]


def content_key(file: Column, data: Column) -> Column:
    """Digest of the content and the kind of its name: equal keys have equal findings."""
    kind = F.lit("")
    for pattern, suffix in reversed(KINDS):
        kind = F.when(F.regexp_like(F.lower(file), F.lit(pattern)), suffix).otherwise(kind)
    return F.concat(F.sha2(data, 256), kind)


_ENTRY = "content_key string, file_size long, stamp double, options_key string"
_STORED = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FINDING.fields if f.name != "file") + ", seq array<int>, content_key string, stamp double, options_key string"
_GONE = "digest string, since double"
#: Writes of a table after which they are merged; keys that go to all tasks at once.
MOST_PARTS, KEYS_SENT = 20, 1_000_000


class ResultCache:
    """Findings by content, in tables that change whole or not at all: `entries`, a row a content, `findings`, a row a
    finding, without file names, and `gone`, contents to forget.

    A key that was stored again counts with its latest time.  A content that is to be forgotten is a row of `gone`,
    until the next merge leaves it out; what is stored after that counts again."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = RESULT_SECONDS):
        self.spark, self.seconds = spark, seconds
        self.tables = Snapshots(spark, path)

    def _alive(self, parts: Parts, name: str, ddl: str) -> DataFrame:
        rows = self.tables.read(name, ddl, parts)
        if not parts.get("gone"):
            return rows
        gone = self.tables.read("gone", _GONE, parts).groupBy("digest").agg(F.max("since").alias("since"))
        return rows.join(gone, (F.left("content_key", F.lit(64)) == F.col("digest")) & (F.col("stamp") <= F.col("since")), "left_anti")

    def entries(self, options: ScanOptions, now: float | None = None, parts: Parts | None = None) -> DataFrame:
        """(content_key, stamp) of the contents that are alive, each once."""
        least = (time.time() if now is None else now) - self.seconds
        stored = self._alive(self.tables.current()[1] if parts is None else parts, "entries", _ENTRY)
        return stored.where((F.col("options_key") == options_key(options)) & (F.col("stamp") >= least)).groupBy("content_key").agg(F.max("stamp").alias("stamp"))

    def findings(self, options: ScanOptions, now: float | None = None) -> DataFrame:
        """Findings of the contents that are alive."""
        parts = self.tables.current()[1]  # both tables of one generation
        stored = self.tables.read("findings", _STORED, parts).where(F.col("options_key") == options_key(options))
        return stored.join(self.entries(options, now, parts), ["content_key", "stamp"])

    def keyed(self, texts: DataFrame) -> DataFrame:
        data = F.coalesce("content", F.col("text").cast("binary")) if "content" in texts.columns else F.col("text").cast("binary")
        return texts.withColumn("content_key", content_key(F.col("file"), data))

    def hits(self, names: DataFrame, options: ScanOptions, now: float | None = None) -> DataFrame:
        """Findings of known contents under the names of the files (file, content_key); a content may have any number of names."""
        names = staged(names.select("file", "content_key"))
        counts = names.groupBy("content_key").agg(F.count("*").alias("__names"))
        found = self.findings(options, now).groupBy("content_key").agg(F.collect_list(F.struct(*[c for c in INTERNAL if c != "file"])).alias("__found"))
        met = skew_join(names, staged(found.join(counts, "content_key")), "content_key", "__names", names.count(), "file")
        return met.select("file", F.explode("__found").alias("x")).select("file", "x.*").select(INTERNAL)

    def split(self, texts: DataFrame, options: ScanOptions, now: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(findings of known contents under the names of the files, texts that must be scanned).

        Keys are looked up, not texts: these aren't shuffled unless more than KEYS_SENT contents are new."""
        keyed = self.keyed(texts)
        names = staged(keyed.select("file", "content_key"))
        new = staged(names.select("content_key").distinct().join(self.entries(options, now).select("content_key"), "content_key", "left_anti"))
        left = keyed.join(F.broadcast(new) if new.count() <= KEYS_SENT else new, "content_key", "left_semi")
        return self.hits(names, options, now), left

    def put(self, scanned: DataFrame, findings: DataFrame, options: ScanOptions, now: float | None = None) -> None:
        """Store scanned contents (content_key, text) and their findings, whose `file` is the content_key, in one change."""
        stamp, key = F.lit(float(time.time() if now is None else now)).alias("stamp"), F.lit(options_key(options)).alias("options_key")
        kept = findings.select(*[c for c in INTERNAL if c != "file"], F.col("file").alias("content_key"), stamp, key)
        once = scanned.groupBy("content_key").agg(F.max(F.octet_length("text").cast("long")).alias("file_size"))
        self.tables.append(findings=kept, entries=once.select("content_key", "file_size", stamp, key))
        if max(map(len, self.tables.current()[1].values())) > MOST_PARTS:
            self.merge()

    def merge(self, least: float = float("-inf")) -> None:
        """Write what is alive and no older than `least` anew, in order of the content, in the place of all writes so far."""
        parts = self.tables.current()[1]
        rows = {name: self._alive(parts, name, ddl).where(F.col("stamp") >= least).repartitionByRange("content_key").sortWithinPartitions("content_key") for name, ddl in (("entries", _ENTRY), ("findings", _STORED))}
        self.tables.replace(parts, **rows, gone=self.spark.createDataFrame([], _GONE))

    def invalidate(self, text: str, now: float | None = None) -> None:
        """Forget a content, under all kinds of names and options."""
        row = (hashlib.sha256(text.encode()).hexdigest(), float(time.time() if now is None else now))
        self.tables.append(gone=self.spark.createDataFrame([row], _GONE))

    def cleanup(self, now: float | None = None) -> None:
        """Forget what is too old, and give back the space of all that is forgotten."""
        self.merge((time.time() if now is None else now) - self.seconds)
        self.tables.vacuum()

    def clear(self) -> None:
        self.tables.drop()


def scan_cached(texts: DataFrame, cache: ResultCache, options: ScanOptions | None = None, now: float | None = None) -> DataFrame:
    """Findings as `scan` gives them, where contents that were scanned before aren't scanned again, and equal ones are scanned once."""
    from ..plans.scan import scan
    from . import post

    options = options or ScanOptions()
    texts = texts.where("text is not null")
    _, fresh = cache.split(texts, options, now)
    # one text stands for all with its key; the key ends as the name does, so the scan treats it alike
    fresh = staged(fresh.select([c for c in fresh.columns if c != "file"]).dropDuplicates(["content_key"]))
    cache.put(fresh, staged(scan(fresh.withColumn("file", F.col("content_key")), options)), options, now)
    return post.once_a_file(cache.hits(cache.keyed(texts), options, now))


# ---------------------------------------------------------------- URLs

URL_CACHE = "url_hash string, url string, content binary, content_type string, timestamp double"


def url_hash(url: str):
    return F.sha2(F.col(url), 256)


class UrlCache:
    """Fetched pages by URL, in a table that changes whole or not at all; what is stored again takes the place of what was."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = URL_SECONDS):
        self.spark, self.seconds = spark, seconds
        self.tables = Snapshots(spark, path)

    def stored(self) -> DataFrame:
        return self.tables.read("urls", URL_CACHE)

    def put(self, fetched: DataFrame, now: float) -> None:
        """Store fetched pages (url, content, content_type); null URLs are left out."""
        rows = fetched.where("url is not null").select(url_hash("url").alias("url_hash"), "url", F.col("content").cast("binary").alias("content"), "content_type", F.lit(float(now)).alias("timestamp"))
        self.tables.append(urls=rows)
        if len(self.tables.current()[1]["urls"]) > MOST_PARTS:
            self._merge(float("-inf"))

    def latest(self, now: float) -> DataFrame:
        return latest_urls(self.stored(), now, self.seconds)

    def missing(self, urls: DataFrame, now: float) -> DataFrame:
        return missing_urls(urls, self.stored(), now, self.seconds)

    def _merge(self, least: float) -> None:
        parts = self.tables.current()[1]
        rows = self.tables.read("urls", URL_CACHE, parts)
        self.tables.replace(parts, urls=latest_urls(rows, least, 0).repartitionByRange("url_hash"))

    def cleanup(self, now: float) -> None:
        """Forget what is too old and what was replaced, and give back their space."""
        self._merge(now - self.seconds)
        self.tables.vacuum()

    def clear(self) -> None:
        self.tables.drop()


def latest_urls(cached: DataFrame, now: float, seconds: float = URL_SECONDS) -> DataFrame:
    """The live entry of each URL in a table (url_hash, url, content, content_type, timestamp); of several at one time that with the greatest digest of its content."""
    alive = cached.where(F.col("timestamp") >= now - seconds)
    row = F.struct(*[F.col(c) for c in alive.columns])
    return alive.groupBy("url_hash").agg(F.max_by(row, F.struct("timestamp", F.md5("content"), "content_type")).alias("r")).select("r.*")


def missing_urls(urls: DataFrame, cached: DataFrame, now: float, seconds: float = URL_SECONDS) -> DataFrame:
    """URLs without a live entry."""
    live = cached.where(F.col("timestamp") >= now - seconds).select("url_hash").distinct()
    return urls.withColumn("url_hash", url_hash("url")).join(live, "url_hash", "left_anti").drop("url_hash")
