"""Sources: files, git history, URL lists, rule, ignore and exclude lists."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Rule, parse_rules
from .git import git_history  # noqa: F401 - surfaces take it from here

# Names, extensions and limits must be as they are for right results.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", ".tox", ".mypy_cache", ".pytest_cache", "node_modules", "venv", ".venv", "__pycache__", "build", ".eggs", "target", "vendor")
TEXT_EXTENSIONS = (
    ".cfg", ".conf", ".config", ".env", ".envrc", ".ini", ".properties", ".toml", ".json", ".json5", ".yaml", ".yml", ".xml", ".html", ".htm",
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rb", ".java", ".kt", ".swift", ".php", ".cs", ".rs", ".cpp", ".c", ".h",
    ".sh", ".bash", ".zsh", ".fish", ".ps1", ".tf", ".tfvars", ".hcl", ".md", ".txt", ".log", ".pem", ".key", ".crt", ".pub",
    ".gradle", ".mvn", ".npmrc", ".yarnrc", ".dockerignore", "Dockerfile", ".dockerfile", ".map",
)
LARGEST_FILE = 10 * 1024 * 1024
SNIFFED_BYTES = 8192
#: Files of more bytes than this aren't rows: they are read by lines, in ranges.
LINES_FROM = 64 << 20


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; a name's only, leading dot makes none."""
    name = file_name(path)
    return F.when(F.regexp_like(name, F.lit(r"^.+\.[^.]+$")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def is_text(path: Column, content: Column) -> Column:
    """By extension or name; else no NUL among the first bytes."""
    name = file_name(path)
    known = F.lower(suffix(path)).isin(*TEXT_EXTENSIONS) | name.isin(*TEXT_EXTENSIONS) | F.startswith(name, F.lit(".env."))
    return known | ~F.contains(F.substring(content, 1, SNIFFED_BYTES), F.lit(b"\x00"))


def kept_folder(relative: Column) -> Column:
    """Whether no folder on the way is hidden or one of the skipped ones."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(folders, lambda p: p.isin(*SKIPPED_FOLDERS) | F.startswith(p, F.lit(".")))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each folder (path, uri, folder, length, link, trail) but for what is skipped; the executors look.

    trail: the device and inode of the folder and of those above it.  A link to one of these is a circle."""
    from pyarrow import fs

    for batch in batches:
        for uri, trail in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            system, inner = fs.FileSystem.from_uri(uri)
            found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            head = uri[: len(uri) - len(inner)] if uri.endswith(inner) else ""
            if system.type_name == "local":
                own = os.stat(inner)
                trail = [*trail, f"{own.st_dev}:{own.st_ino}"]
                if trail[-1] in trail[:-1]:
                    continue
            rows = []
            for one in found:
                if one.type == fs.FileType.Directory and (one.base_name.startswith(".") or one.base_name in SKIPPED_FOLDERS):
                    continue
                if one.type in (fs.FileType.Directory, fs.FileType.File):
                    link = system.type_name == "local" and os.path.islink(one.path)
                    rows.append((head + one.path, one.path, one.type == fs.FileType.Directory, one.size or 0, link, trail))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(pa.string())), strict=True)], names=["uri", "path", "folder", "length", "link", "trail"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for uri, path, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            system, inner = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(inner) as data:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([data.read()], pa.binary())], names=["path", "length", "content"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (uri, path, length) with their first bytes as content."""
    from pyarrow import fs

    for batch in batches:
        starts = []
        for uri in batch.column(0).to_pylist():
            system, inner = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(inner) as data:
                starts.append(data.read(SNIFFED_BYTES))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.binary())], names=[*batch.schema.names, "content"])


_LISTED = "uri string, path string, folder boolean, length long, link boolean, trail array<string>"


def _walked(spark: SparkSession, root: str, follow_symlinks: bool) -> DataFrame:
    """(uri, path, length) of all files under a folder, level by level; hidden and skipped folders aside."""
    from .shared import staged

    tasks, files = spark.sparkContext.defaultParallelism, None
    folders = spark.createDataFrame([(root, [])], "uri string, trail array<string>")
    while True:
        level = staged(folders.repartition(tasks, "uri").mapInArrow(_children, _LISTED))
        level = level if follow_symlinks else level.where("not link")
        own = level.where("not folder").select("uri", "path", "length")
        files = own if files is None else files.unionByName(own)
        folders = level.where("folder").select("uri", "trail")
        if not folders.limit(1).count():
            return files


def _status(spark: SparkSession, path: str) -> tuple[str, str, bool, int]:
    """(uri, path, whether it is a file, length) of a path that exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    uri, inner = found.getPath().toString(), found.getPath().toUri().getPath()
    return (f"file://{inner}" if uri.startswith("file:") else uri), inner, found.isFile(), found.getLen()


def _stored(spark: SparkSession, uri: str, single: bool, exclude: list[str], max_bytes: int) -> DataFrame:
    """(path, length, content) in a store that Spark's readers open; they pass over names that begin with a dot or underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri).where(F.col("length") <= max_bytes)
    plain = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    if not single:
        files = files.where(kept_folder(F.substring("path", len(uri.rstrip("/")) + 2, 1 << 30)))
        for p in exclude:
            files = files.where(~F.regexp_like(plain, F.lit(p)))
    return files.select(plain.alias("path"), "length", "content")


def _listed_files(spark: SparkSession, path: str, exclude: list[str] | None, follow_symlinks: bool) -> DataFrame:
    """(uri, path, length) of the files under a path on disks that the machines mount, or of the file that it names."""
    uri, inner, single, length = _status(spark, path)
    if single:
        return spark.createDataFrame([(uri, inner, length)], "uri string, path string, length long")
    listed = _walked(spark, uri, follow_symlinks)
    for p in exclude or []:
        listed = listed.where(~F.regexp_like("path", F.lit(p)))
    return listed


def large_files(spark: SparkSession, path: str, exclude: list[str] | None = None, max_bytes: int = LARGEST_FILE, skip_binary: bool = True, follow_symlinks: bool = False) -> list[tuple[str, str, int]]:
    """(uri, path, length) of the files of more than LINES_FROM and at most max_bytes bytes;
    each of them is at least so many bytes, so the list is short beside what it names."""
    if max_bytes <= LINES_FROM or not _status(spark, path)[0].startswith("file:"):
        return []
    chosen = _listed_files(spark, path, exclude, follow_symlinks).where((F.col("length") > LINES_FROM) & (F.col("length") <= max_bytes))
    if skip_binary:
        chosen = chosen.mapInArrow(_starts, "uri string, path string, length long, content binary").where(is_text(F.col("path"), F.col("content")))
    return [(r["uri"], r["path"], r["length"]) for r in chosen.orderBy("path").collect()]


def read_files(spark: SparkSession, path: str, exclude: list[str] | None = None, max_bytes: int = LARGEST_FILE, skip_binary: bool = True, follow_symlinks: bool = False) -> DataFrame:
    """(file, text, content, length) of the text files under a path, or of the one file that it names.

    On disks that the machines mount, executors list folders and read files, so that the driver
    holds no list and no name is hidden; other stores are read by Spark's own reader.  Length and
    path decide before any content is read.  A file that is named itself isn't subject to
    `exclude`.  Invalid UTF-8 becomes the replacement character."""
    uri, _, single, _ = _status(spark, path)
    if uri.startswith("file:"):
        listed = _listed_files(spark, path, exclude, follow_symlinks)
        chosen = listed.where(F.col("length") <= max_bytes)
        files = chosen.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(_contents, "path string, length long, content binary")
    else:
        files = _stored(spark, uri, single, exclude or [], max_bytes)
    if skip_binary:
        files = files.where(is_text(F.col("path"), F.col("content")))
    return files.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "content", "length")


def from_table(rows: DataFrame, text: str = "text", file: str | None = None, template: str = "row:{}") -> DataFrame:
    """Any table with a text as (file, text); file: the column to name rows by."""
    name = F.col(file).cast("string") if file else F.monotonically_increasing_id().cast("string")
    before, after = template.split("{}")
    return rows.select(F.concat(F.lit(before), name, F.lit(after)).alias("file"), F.col(text).cast("string").alias("text"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, html) as texts; empty bodies are dropped."""
    return pages.where(F.length("html") > 0).select(F.col("url").alias("file"), F.col("html").alias("text"))


def fetched_name(url: Column) -> Column:
    """A safe file name for a URL: its last part without query, letters, digits and ._- only, 80 at most."""
    last = F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "/", -1), r"[^\p{L}\p{N}._-]", "")
    return F.when(last == "", "index.html").otherwise(F.left(last, F.lit(80)))


def is_script_like(content_type: Column) -> Column:
    """Content types worth fetching; a missing one is accepted."""
    return content_type.isNull() | F.regexp_like(F.lower(content_type), F.lit("text/|javascript|ecmascript|json"))


def positioned(spark: SparkSession, *paths: str) -> DataFrame:
    """(url, position) of lists of URLs, one a line; position: the list, then the place in it."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.text(path).select(F.trim("value").alias("url"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
        rows = rows.select("url", F.struct(F.lit(i).alias("list"), "p", "b", "m").alias("position"))
        out = rows if out is None else out.unionByName(rows)
    return out


def url_list(spark: SparkSession, path: str, js_only: bool = False, most: int | None = None, scope: str | None = None) -> DataFrame:
    """URLs of a list, one a line: http and https only, within scope, the first `most` by place in the list."""
    rows = positioned(spark, path).where(F.regexp_like("url", F.lit("^https?://")))
    if scope:
        rows = rows.where(F.regexp_like("url", F.lit(scope)))
    if js_only:
        rows = rows.where(F.contains(F.lower("url"), F.lit(".js")))
    return (rows.orderBy("position").limit(most) if most is not None else rows).select("url")


def merged_urls(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("url")
    for x in lists[1:]:
        out = out.unionByName(x.select("url"))
    return out.distinct().orderBy("url")


def text_path(path: str) -> bool:
    """Whether a path in a history has one of the text extensions."""
    name = path.rsplit("/", 1)[-1].lstrip(".")
    return "." in name and "." + name.rsplit(".", 1)[-1].lower() in TEXT_EXTENSIONS


def git_findings(blobs: DataFrame, options=None) -> DataFrame:
    """Findings of history, once for each rule and start of the secret, in commit order; without columns and context around."""
    from ..operators.post import _least
    from ..plans.scan import scan

    found = scan(blobs.select("file", "text"), options).join(blobs.select("file", "order").groupBy("file").agg(F.min("order").alias("order")), "file")
    first = _least(found, [F.col("rule"), F.left("secret", F.lit(40))], F.struct("order", "line", "seq"))
    return first.drop("order").withColumn("column", F.lit(0)).withColumn("context_before", F.lit("")).withColumn("context_after", F.lit(""))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of a list; Spark's own reader passes over files whose name begins with a dot."""
    if not path.rsplit("/", 1)[-1].startswith((".", "_")):
        return spark.read.text(path)
    uri, inner, _, length = _status(spark, path)
    one = spark.createDataFrame([(uri, inner, length)], "uri string, path string, length long").mapInArrow(_contents, "path string, length long, content binary")
    return one.select(F.explode(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\r?\n")).alias("value"))


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in text_lines(spark, path).collect()]


def rules_file(spark: SparkSession, path: str) -> list[Rule]:
    return parse_rules("\n".join(_lines(spark, path)))


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of an ignore file, without comments."""
    rows = text_lines(spark, path).where(~F.startswith("value", F.lit("#")))
    return rows.select(F.trim(F.substring_index("value", "#", 1)).alias("fingerprint")).where("fingerprint <> ''").distinct()


def exclude_list(spark: SparkSession, path: str) -> list[str]:
    return [x.strip() for x in _lines(spark, path) if x.strip() and not x.startswith("#")]
