"""Structured content: JSON values, strings that JavaScript puts together, endpoints,
scripts in pages, source maps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import small_batches

# Keys, patterns and limits must be as they are for right results.
JSON_KEYS = (
    r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|access[_-]?token|auth[_-]?token|auth[_-]?key|client[_-]?secret|client[_-]?id|"
    r"private[_-]?key|ssh[_-]?key|encryption[_-]?key|signing[_-]?key|bearer|credential|refresh[_-]?token|session[_-]?key|secret[_-]?key|master[_-]?key)$"
)
ENDPOINTS = (
    r"""['"]((?:/api|/v\d+|/internal|/admin|/dashboard|/graphql|/rest)(?:/[a-zA-Z0-9_\-{}:]+){1,6})['"]""",
    r"""(?i)['"](/[a-z0-9_\-]+/(?:user|account|admin|auth|login|token|password|key|secret|config|setting)[a-z0-9_/\-]*)['"]""",
    r"""(?:fetch|axios\.(?:get|post|put|delete|patch))\s*\(\s*['"](https?://[^'"]+)['"]""",
    r"""(?i)(?:url|endpoint|baseURL|apiURL)\s*[:=]\s*['"](https?://[^'"]{10,})['"]""",
    r"""(wss?://[a-zA-Z0-9\-._]+(?:/[a-zA-Z0-9_/\-]*)?)""",
    r"""(?i)['"]((?:https?://[^'"]+)?/graphql(?:/[a-zA-Z0-9_\-]*)?)['"]""",
)
STATIC_ASSET = r"(\.png|\.jpg|\.gif|\.css|\.ico|\.woff|\.svg)$"
SCRIPT = r"(?is)<script[^>]*>\s*(//\s*<!\[CDATA\[)?\s*(.*?)\s*(//\]\]>)?\s*</script>"
SOURCE_MAP = r"//# sourceMappingURL=(.+)"
SCRIPT_URL = r"""['"](https?://[^'"]+\.(?:js|mjs|cjs)(?:\?[^'"]*)?)['"]"""
CRAWLED_SCRIPT = r"""['"]([^'"]*\.js(?:\?[^'"]*)?)['"]"""
STRING_LITERAL = r"""(["'])((?:[^\\]|\\.)*?)\1"""
STRING_SUM = STRING_LITERAL + r"""\s*\+\s*(["'])((?:[^\\]|\\.)*?)\3"""
STRING_JOIN = r"""\[([^\]]+)\]\s*\.\s*join\s*\(\s*(["'])\s*\2\s*\)"""
TEMPLATE = r"`([^`$]*)`"
LEAST_REBUILT = 20


# ---------------------------------------------------------------- JSON


#: What leaves Python at once: so many texts of documents, or the first that fill so many characters with their paths.
VALUES_SENT, CHARACTERS_SENT = 10_000, 8 << 20


def _inner(value: dict | list, named: bool) -> Iterator[tuple[str, object]]:
    """(part of the key path, value) of what a JSON value holds; named: whether anything of the path comes before."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield f".{key}" if named else key, inner
    else:
        for i, inner in enumerate(value):
            yield f"[{i}]", inner


def walk(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(key path, text) of every text in a JSON value, in order.

    The way down is a stack, so that no depth is too much, and paths are put together for texts only."""
    parts, rest = [path], [iter([("", value)])]
    while rest:
        part, inner = next(rest[-1], (None, None))
        if part is None:
            parts.pop()
            rest.pop()
        elif isinstance(inner, dict | list):
            parts.append(part)
            rest.append(_inner(inner, any(parts)))
        elif isinstance(inner, str) and inner:
            yield "".join(parts) + part, inner


def texts_in(source: str | None) -> Iterator[tuple[str, str]]:
    """`walk` of a JSON document; nothing if it isn't JSON, or nested some ten thousand levels deep, beyond what Python reads."""
    try:
        value = json.loads(source or "", parse_int=float)  # numbers aren't looked at, and int takes so many digits only
    except (ValueError, RecursionError):
        return
    yield from walk(value)


def json_values(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with key_path, key_name, value and json_at for each text in JSON documents of any size.

    Texts that aren't JSON have none.  A document is read whole by its task; what it holds leaves the task in pieces."""
    kept = [f for f in rows.schema if f.name != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def made(batch: pa.RecordBatch, found: list[tuple[int, str, str, int]]) -> pa.RecordBatch:
        at, paths, values, places = zip(*found, strict=True)
        taken = batch.select([f.name for f in kept]).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(paths), pa.array(values), pa.array(places, pa.int32())], names=[*(f.name for f in kept), "key_path", "value", "json_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for i, source in enumerate(batch.column(batch.schema.get_field_index(text))):
                for place, (path, value) in enumerate(texts_in(source.as_py())):
                    found.append((i, path.encode("utf-8", "replace").decode(), value.encode("utf-8", "replace").decode(), place))
                    size += len(path) + len(value)
                    if len(found) >= VALUES_SENT or size >= CHARACTERS_SENT:
                        yield made(batch, found)
                        found, size = [], 0
            if found:
                yield made(batch, found)

    small_batches(rows.sparkSession)
    out = rows.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(run, f"{fields}, key_path string, value string, json_at int")
    return out.withColumn("key_name", F.substring_index("key_path", ".", -1))


def secret_key(name: Column, value: Column) -> Column:
    """Whether a JSON key names a secret and its value may be one."""
    return X.search(name, JSON_KEYS) & (F.length(value) >= 8) & ~F.regexp_like(value, F.lit(X.UNICODE + r"^\p{Nd}+$")) & (X.entropy(value) >= 3.0)


# ---------------------------------------------------------------- JavaScript


_LITERAL = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
_LITERALS, _CHAIN = re.compile(_LITERAL), re.compile(rf"{_LITERAL}(?:[ \t]*\+[ \t]*{_LITERAL})+")


def sums(line: str) -> Iterator[str]:
    """Strings added up: from every place where two are, as far as the sum goes."""
    for start in re.finditer(STRING_SUM, line):
        whole = _CHAIN.match(line, start.start())
        text = "".join(x[1:-1] for x in _LITERALS.findall(whole[0])) if whole else ""
        if len(text) >= LEAST_REBUILT:
            yield text


def rebuilt(line: str) -> Iterator[tuple[str, str]]:
    """(how, text) of strings that JavaScript in this line puts together."""
    for text in sums(line):
        yield "reconstructed_concat", text
    for found in re.finditer(STRING_JOIN, line):
        parts = [m[2] for m in re.finditer(STRING_LITERAL, found[1])]
        if len(parts) > 1 and len(whole := "".join(parts)) >= LEAST_REBUILT:
            yield "reconstructed_join", whole
    for found in re.finditer(TEMPLATE, line):
        if len(found[1]) >= LEAST_REBUILT:
            yield "reconstructed_template", found[1]


def rebuild_strings(rows: DataFrame, text: str = "line_text") -> DataFrame:
    """Rows with tag, decode_at and decoded for each string put together in the line."""
    from .decode import _in_arrow

    c = F.col(text)
    some = rows.where(F.contains(c, F.lit("+")) | F.contains(c, F.lit("join")) | F.contains(c, F.lit("`")))
    return _in_arrow(some, text, rebuilt)


# ---------------------------------------------------------------- endpoints, pages


def endpoint_array(text: Column) -> Column:
    """Endpoints that a text quotes, in the order of the patterns, then of place."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, X.pattern(p), F.lit(1)) for p in ENDPOINTS]))
    return F.when(F.regexp_like(text, F.lit("['\"(:]")), F.filter(found, lambda e: (F.length(e) >= 5) & ~F.regexp_like(e, F.lit(STATIC_ASSET))))


def endpoints(lines: DataFrame, text: str = "line_text", file: str = "file") -> DataFrame:
    """Endpoints in lines, the first of each in a file: pattern order within a line, then place."""
    good = lines.select("*", F.posexplode(endpoint_array(F.col(text))).alias("endpoint_at", "endpoint"))
    # the least (line, place) of each endpoint of a file; partial sums make this cheap
    rest = [c for c in good.columns if c not in (file, "endpoint")]
    first = good.groupBy(file, "endpoint").agg(F.min(F.struct("line", "endpoint_at", *[c for c in rest if c not in ("line", "endpoint_at")])).alias("__f"))
    return first.select(file, "endpoint", *[F.col(f"__f.{c}").alias(c) for c in rest])


def scripts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Script bodies of pages with their number, blank ones left out but counted."""
    bodies = pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), X.pattern(SCRIPT), F.lit(2))).alias("__at", "script"))
    return bodies.where(X.strip(F.col("script")) != "").withColumn("script_no", F.col("__at") + 1).drop("__at", html)


def source_map_refs(rows: DataFrame, text: str = "text") -> DataFrame:
    """References to source maps."""
    refs = F.transform(F.regexp_extract_all(F.col(text), F.lit(SOURCE_MAP), F.lit(1)), X.strip)
    return rows.select("*", F.posexplode(refs).alias("ref_at", "source_map"))


def inline_source_map(uri: Column) -> Column:
    """JSON text of a data: URI, Base64 or percent-encoded; null if it can't be read."""
    body = F.regexp_replace(uri, r"(?s)^[^,]*,", "")
    head = F.substring_index(uri, ",", 1)
    raw = F.when(F.contains(head, F.lit("base64")), F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))
    return F.when(F.contains(uri, F.lit(",")) & F.startswith(uri, F.lit("data:")), raw)


def source_files(maps: DataFrame, text: str = "source_map_text") -> DataFrame:
    """Original sources that a source map carries; empty ones are left out."""
    parsed = F.from_json(text, "sources ARRAY<STRING>, sourcesContent ARRAY<STRING>")
    zipped = F.arrays_zip(parsed["sources"].alias("name"), parsed["sourcesContent"].alias("content"))
    each = maps.select("*", F.posexplode(zipped).alias("source_at", "__s"))
    return each.where("length(__s.content) > 0 and __s.name is not null").select(*maps.columns, "source_at", F.col("__s.name").alias("source_name"), F.col("__s.content").alias("source_text"))


def script_urls(rows: DataFrame, text: str = "text") -> DataFrame:
    """Absolute URLs of scripts that a text quotes."""
    return rows.select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), X.pattern(SCRIPT_URL), F.lit(1)))).alias("script_url")).drop(text)


def crawled_scripts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Script URLs in crawled pages: absolute ones, and those without a scheme as https; relative ones are dropped."""
    each = rows.select("*", F.explode(F.regexp_extract_all(F.col(text), X.pattern(CRAWLED_SCRIPT), F.lit(1))).alias("__u")).drop(text)
    url = F.when(F.startswith(F.col("__u"), F.lit("//")), F.concat(F.lit("https:"), F.col("__u"))).when(F.regexp_like(F.col("__u"), F.lit("^https?://")), F.col("__u"))
    return each.withColumn("script_url", url).drop("__u").where("script_url is not null").distinct()


def crawl(seeds: DataFrame, fetched: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """Script URLs reached from `seeds` (url) through `fetched` (url, text), level by
    level, with the level; a URL counts where it is met first.  cap: URLs a level takes."""
    from ..sources.shared import staged

    frontier = seeds.select("url").distinct().withColumn("level", F.lit(0))
    if cap is not None:
        frontier = frontier.orderBy("url").limit(cap)
    seen = frontier = staged(frontier)
    for level in range(1, depth + 1):
        found = script_urls(fetched.join(frontier.select("url"), "url"), "text").select(F.col("script_url").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level))
        frontier = staged(found.orderBy("url").limit(cap) if cap is not None else found)
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return seen


def with_source_maps(files: DataFrame, name: str = "file") -> DataFrame:
    """Script files with the name of the map that stands next to them, if one does."""
    maps = files.select(F.col(name).alias("__map")).where(F.endswith(F.col("__map"), F.lit(".map"))).distinct()
    own = F.concat(F.col(name), F.lit(".map"))
    return files.where(~F.endswith(F.col(name), F.lit(".map"))).join(maps, own == F.col("__map"), "left").withColumn("map_file", F.col("__map")).drop("__map")
