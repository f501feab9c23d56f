"""The hunt: a chain of stages from lists of URLs and fetched pages to what they give away.

Each stage is a table in a folder.  A stage whose table is complete isn't run again, so a
chain that was cut short goes on where it stopped.  Fetching is not part of it: pages are
a table (url, html [, content_type]), made by whoever may fetch.

    urls       URLs of all lists: http and https, in scope, scripts only if wanted, the first `most`
    reached    URLs that the scripts name, level by level
    files      fetched pages of these URLs, under safe names, the first of equal contents
    scripts    bodies of inline scripts
    sources    original sources that source maps carry
    report     what all of these give away, by category
    findings   secrets in all of these
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..model import COLUMNS, SEVERITIES, ScanOptions
from ..operators import post, recon, structured
from ..sinks import reports
from ..sinks.document import write_document
from ..sources import files as sources
from ..sources.lines import numbered
from ..sources.shared import staged
from .scan import scan

#: Categories of the report that stand under other names in its JSON form, with their descriptions.
RENAMED = {"js_endpoints": ("endpoints", "Endpoints"), "js_urls": ("urls", "URLs"), "js_variables": ("variables", "JS Variables"), "js_routes": ("routes", "Hidden Routes")}
MAPS = ("sourcemaps", "Source Maps Available")


@dataclass(frozen=True)
class HuntOptions:
    scope: str | None = None
    scripts_only: bool = True
    #: URLs that are taken, and half of what a level of the crawl takes; None for all.
    most: int | None = 200
    depth: int = 0
    inline_scripts: bool = True
    source_maps: bool = True
    filter_content_type: bool = False
    scan: ScanOptions = field(default_factory=ScanOptions)


def live_urls(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The first word of each line of a prober's output: its URL, without status and title."""
    return lines.select(*(keep or []), F.regexp_extract(F.col(line), r"^\s*(\S+)", 1).alias("url")).where("url <> ''")


def candidate_urls(urls: DataFrame, options: HuntOptions) -> DataFrame:
    """(url, position) of the URLs to fetch: the first `most` by position of a table (url, position)."""
    rows = urls.select(F.trim("url").alias("url"), "position").where(F.regexp_like("url", F.lit("^https?://")))
    if options.scope:
        rows = rows.where(F.regexp_like("url", F.lit(options.scope)))
    if options.scripts_only:
        rows = rows.where(F.contains(F.lower("url"), F.lit(".js")))
    once = rows.groupBy("url").agg(F.min("position").alias("position"))
    return once if options.most is None else once.orderBy("position", "url").limit(options.most)


def collision_names(rows: DataFrame, name: Column, order: list[str]) -> DataFrame:
    """Rows with `name`, where all but the first of a name, by the order columns, get _1, _2, ... before the extension.

    The order columns tell all rows apart.  Only they and the name are dealt out and counted, by ranges, so that a name
    may have any number of rows; the other columns join what was found."""
    named = rows.withColumn("__name", name)
    slim = named.select("__name", *order)
    at = F.col("__place") - 1
    end = sources.suffix(F.col("__name"))
    stem = F.left("__name", F.length("__name") - F.length(end))
    full = F.when(at == 0, F.col("__name")).otherwise(F.concat(stem, F.lit("_"), at.cast("string"), end))
    found = numbered(slim, "__name", order, "__place").withColumn("name", full).drop("__name", "__place")
    if set(rows.columns) == set(order):
        return found
    keys = found.select("name", *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    met = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(order)]
    return rows.drop("name").join(keys, met).drop(*[f"__{i}" for i in range(len(order))])


def fetched_files(pages: DataFrame, options: HuntOptions) -> DataFrame:
    """(file, url, text) of pages (url, html [, content_type]): safe names, the first of equal contents by name."""
    if options.filter_content_type and "content_type" in pages.columns:
        pages = pages.where(sources.is_script_like(F.col("content_type")))
    rows = pages.where(F.length("html") > 0).groupBy("url").agg(F.min("html").alias("text"))
    named = collision_names(rows, sources.fetched_name(F.col("url")), ["url"]).select(F.col("name").alias("file"), "url", "text")
    kept = post.exact_duplicates(named, "text", "file").where("keep").select(F.col("file").alias("__kept"))
    return named.join(kept, F.col("file") == F.col("__kept"), "left_semi")


def inline_scripts(files: DataFrame) -> DataFrame:
    """(file, text) of script bodies in HTML files, as <stem>.inline-<number>.js."""
    html = files.where(F.regexp_like(F.lower("file"), F.lit(r"\.html?$"))).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), "text")
    found = structured.scripts(html, "text")
    return found.select(F.concat("stem", F.lit(".inline-"), F.col("script_no").cast("string"), F.lit(".js")).alias("file"), F.col("script").alias("text"))


def map_sources(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, text) of sources that the files' source maps carry: inline ones, absolute URLs, and
    relative ones by way of the URL that a file came from, as far as these were fetched."""
    refs = structured.source_map_refs(files.select("file", "url", "text")).select("file", "url", "ref_at", "source_map")
    inline = refs.where(F.startswith("source_map", F.lit("data:"))).select("file", "ref_at", structured.inline_source_map(F.col("source_map")).alias("source_map_text"))
    base = F.regexp_replace("url", "/[^/]*$", "")
    target = F.when(F.regexp_like("source_map", F.lit("^https?://")), F.col("source_map")).when(F.col("url").isNotNull(), F.concat(base, F.lit("/"), "source_map"))
    linked = refs.where(~F.startswith("source_map", F.lit("data:"))).withColumn("target", target)
    fetched = pages.groupBy(F.col("url").alias("target")).agg(F.min("html").alias("source_map_text"))
    maps = inline.unionByName(linked.join(fetched, "target").select("file", "ref_at", "source_map_text"))
    each = structured.source_files(maps.where("source_map_text is not null"))
    named = collision_names(each, sources.fetched_name(F.col("source_name")), ["file", "ref_at", "source_at"])
    return named.select(F.concat(F.lit("sources/"), "name").alias("file"), F.col("source_text").alias("text"))


def deep_report(files: DataFrame) -> DataFrame:
    """(category, desc, value, file): each value once in a category, and script files whose map stands beside them."""
    text = files.where(~F.contains(F.left("text", F.lit(1024)), F.lit("\0")))
    found = recon.extract(text.select("file", "text")).select("category", "desc", "value", "file")
    new = F.create_map(*[F.lit(x) for old, pair in RENAMED.items() for x in (old, pair[0])])
    told = F.create_map(*[F.lit(x) for old, pair in RENAMED.items() for x in (old, pair[1])])
    found = found.select(F.coalesce(new[F.col("category")], "category").alias("category"), F.coalesce(told[F.col("category")], "desc").alias("desc"), "value", "file")
    beside = structured.with_source_maps(files.select("file")).where("map_file is not null")
    return found.unionByName(beside.select(F.lit(MAPS[0]).alias("category"), F.lit(MAPS[1]).alias("desc"), F.col("map_file").alias("value"), "file"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as one JSON document that tasks write: as `report_json`, but for white space, at any size."""
    rows = staged(report.select("category", "desc", "value", "file", F.monotonically_increasing_id().alias("__id")))
    first = rows.groupBy(F.col("category").alias("__c")).agg(F.min(F.struct("file", "value", "__id")).alias("__first"))
    opens = F.col("__first.__id") == F.col("__id")
    names = sorted(r["__c"] for r in first.select("__c").collect())  # there are some forty kinds
    quoted = lambda c: F.expr(f"substring(to_json(named_struct('x', `{c}`)), 6, length(to_json(named_struct('x', `{c}`))) - 6)")
    head = F.concat(F.when(F.col("category") == F.lit(names[0] if names else None), "").otherwise("]},"), quoted("category"), F.lit(': {"desc": '), quoted("desc"), F.lit(', "findings": ['))
    one = F.to_json(F.struct("value", "file"))
    piece = F.when(opens, F.concat(head, one)).otherwise(F.concat(F.lit(","), one))
    ordered = rows.join(first, F.col("category") == F.col("__c")).orderBy("category", "file", "value", "__id").select(F.concat(F.lit("\n"), piece).alias("piece"))
    write_document(ordered, path, f'{{"total_findings": {rows.count()}, "categories": {{', "", "]}}}\n" if names else "}}\n")


def report_json(report: DataFrame) -> str:
    """The report as one document; for reports that a reader could look through."""
    categories: dict[str, dict] = {}
    for r in report.orderBy("category", "file", "value").toLocalIterator():
        categories.setdefault(r["category"], {"desc": r["desc"], "findings": []})["findings"].append({"value": r["value"], "file": r["file"]})
    return json.dumps({"total_findings": sum(len(c["findings"]) for c in categories.values()), "categories": categories}, indent=2, ensure_ascii=False)


def stream_findings(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Findings of fetched texts, once for each rule and the first 60 characters of a secret."""
    found = scan(files.select("file", "text"), options)
    return post._least(found, [F.col("rule"), F.left("secret", F.lit(60))], F.struct("file", "line", "seq")).select(COLUMNS)


class Hunt:
    """The chain over one folder; each stage's table is made once."""

    STAGES = ("urls", "reached", "files", "scripts", "sources", "report", "findings")

    def __init__(self, spark: SparkSession, folder: str, options: HuntOptions | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options or HuntOptions()

    def done(self, stage: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{stage}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def next_stage(self) -> str | None:
        """The first stage that isn't complete."""
        return next((s for s in self.STAGES if not self.done(s)), None)

    def _table(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.done(stage):
            make().write.mode("overwrite").parquet(f"{self.folder}/{stage}")
        return self.spark.read.parquet(f"{self.folder}/{stage}")

    def run(self, urls: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
        """All stages over URLs (url, position) and fetched pages (url, html [, content_type])."""
        o = self.options
        first = self._table("urls", lambda: candidate_urls(urls, o))
        fetched = pages.select("url", F.col("html").alias("text"))
        reached = self._table("reached", lambda: structured.crawl(first, fetched, o.depth, None if o.most is None or not o.depth else 2 * o.most))
        files = self._table("files", lambda: fetched_files(pages.join(reached.select("url"), "url", "left_semi"), o))
        none = files.select("file", "text").limit(0)
        scripts = self._table("scripts", lambda: inline_scripts(files) if o.inline_scripts else none)
        more = self._table("sources", lambda: map_sources(files.unionByName(scripts.withColumn("url", F.lit(None).cast("string"))), pages) if o.source_maps else none)
        every = files.select("file", "text").unionByName(scripts).unionByName(more)
        report = self._table("report", lambda: deep_report(every))
        findings = self._table("findings", lambda: stream_findings(every, o.scan))
        return {"urls": first, "reached": reached, "files": files, "scripts": scripts, "sources": more, "report": report, "findings": findings}


# ---------------------------------------------------------------- command line


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparksift.plans.hunt", description="Look for exposed secrets in fetched pages of a list of URLs.")
    p.add_argument("urls", nargs="+", help="lists of URLs, one a line; first words of lines count, so a prober's output will do")
    p.add_argument("--pages", required=True, help="Parquet table of fetched pages: url, html and, if known, content_type")
    p.add_argument("-o", "--output-dir", required=True, help="folder of the stages; a chain that was cut short goes on there")
    p.add_argument("-f", "--format", choices=sorted(reports.PIECES), default="text")
    p.add_argument("-s", "--severity", default="LOW", choices=SEVERITIES)
    p.add_argument("-r", "--redact", action="store_true")
    p.add_argument("--scope", help="pattern that URLs must match")
    p.add_argument("-aj", "--all-files", action="store_true", help="all URLs, not only those of scripts")
    p.add_argument("-mf", "--max-files", type=int, default=200, help="URLs to take; 0 for all")
    p.add_argument("-jsd", "--js-depth", type=int, default=0, help="levels of scripts that scripts name")
    p.add_argument("--no-inline-scripts", action="store_true")
    p.add_argument("--no-source-maps", action="store_true")
    p.add_argument("--filter-content-type", action="store_true")
    p.add_argument("--no-entropy", action="store_true")
    p.add_argument("--decode-base64", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--fail-on", choices=SEVERITIES)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs the chain and writes <output-dir>/report.json and <output-dir>/findings.<format>; 1 if there are findings (at fail-on and worse)."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparksift-hunt").getOrCreate()
    ship(spark)
    found = sources.positioned(spark, *a.urls)
    urls = live_urls(found.withColumnRenamed("url", "value"), keep=["position"])
    options = HuntOptions(a.scope, not a.all_files, a.max_files or None, a.js_depth, not a.no_inline_scripts, not a.no_source_maps, a.filter_content_type, ScanOptions(a.severity, entropy=not a.no_entropy, decode_base64=a.decode_base64))
    made = Hunt(spark, a.output_dir, options).run(urls, spark.read.parquet(a.pages))
    write_report(made["report"], f"{a.output_dir}/report.json")
    reports.write_report(post.ordered(made["findings"]), a.format, f"{a.output_dir}/findings.{a.format}", a.redact)
    return int(post.failing(made["findings"], a.fail_on).first()["failed"])


if __name__ == "__main__":
    sys.exit(main())
