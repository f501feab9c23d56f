"""Decoders: what a line says once it is decoded, to be scanned again.

Base64 and hexadecimal stay in Catalyst.  Percent and \\u escapes, whose matches are
replaced one by one, compressed content and the recursive pipeline run in Arrow
batches, on the few lines that hold something to decode.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import small_batches

# Candidates and limits must be as they are for right results.
BASE64_CANDIDATE = r"\b[A-Za-z0-9+/]{32,}={0,2}(?!\w)"
HEX_CANDIDATE = r"\b(?:[0-9a-fA-F]{2}){10,}\b"
UNICODE_ESCAPE = r"\\u([0-9a-fA-F]{4})"
PERCENT_ESCAPE = r"%([0-9a-fA-F]{2})"
MAX_DEPTH = 4
LEAST_COMPRESSED = 64


def base64_text(raw: Column) -> Column:
    """Strictly padded Base64 as UTF-8 text; null if it isn't that."""
    core = F.rtrim(raw, F.lit("="))
    marks = F.length(raw) - F.length(core)
    odd = F.length(core) % 4
    whole = F.when(odd == 0, core).when((odd == 2) & (marks >= 2), F.concat(core, F.lit("=="))).when((odd == 3) & (marks >= 1), F.concat(core, F.lit("=")))
    data = F.try_to_binary(whole, F.lit("base64"))
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def hex_text(raw: Column) -> Column:
    """Hexadecimal of one case as UTF-8 text; null if it isn't that."""
    mixed = F.regexp_like(raw, F.lit("[a-f]")) & F.regexp_like(raw, F.lit("[A-F]"))
    text = F.unhex(raw).cast("string")
    bare = F.regexp_replace(F.lower(X.strip(text)), "^x+|x+$", "")
    return F.when(~mixed & F.is_valid_utf8(text) & ~bare.isin("", "hex"), text)


def decoded_array(text: Column, tag: str) -> Column:
    """Structs (tag, decode_at, text) of what the Base64 or hexadecimal strings of a text say."""
    candidate, decode, run = {"base64": (BASE64_CANDIDATE, base64_text, "[A-Za-z0-9+/]{32}"), "hex": (HEX_CANDIDATE, hex_text, "[0-9a-fA-F]{20}")}[tag]
    made = F.transform(F.regexp_extract_all(text, X.pattern(candidate), F.lit(0)), lambda raw, i: F.struct(F.lit(tag).alias("tag"), i.alias("decode_at"), decode(raw).alias("text")))
    good = F.filter(made, lambda x: x["text"].isNotNull() & X.printable(x["text"]))
    # the plain run of characters is a cheap condition that every candidate fulfils
    return F.when(F.regexp_like(text, F.lit(run)), good).otherwise(F.array().cast("array<struct<tag:string,decode_at:int,text:string>>"))


def _decoded(rows: DataFrame, text: str, tag: str) -> DataFrame:
    return rows.select("*", F.explode(decoded_array(F.col(text), tag)).alias("__d")).select(*rows.columns, "__d.tag", "__d.decode_at", F.col("__d.text").alias("decoded"))


def decode_base64(rows: DataFrame, text: str = "line_text") -> DataFrame:
    """Rows with tag, decode_at and decoded for each Base64 string in the text."""
    return _decoded(rows, text, "base64")


def decode_hex(rows: DataFrame, text: str = "line_text") -> DataFrame:
    return _decoded(rows, text, "hex")


# ---------------------------------------------------------------- in Arrow batches


def _shown(text: str) -> bool:
    return sum(c.isprintable() or c in "\n\r\t" for c in text) >= len(text) // 2


def _texts(candidates: Iterator[str], decode) -> Iterator[str]:
    for raw in candidates:
        try:
            text = decode(raw).decode("utf-8")
        except ValueError:
            continue
        if _shown(text):
            yield text


def step(tag: str, text: str) -> list[str]:
    """What one decoder makes of a text."""
    if tag in ("unicode", "url"):
        p = UNICODE_ESCAPE if tag == "unicode" else PERCENT_ESCAPE
        out = re.sub(p, lambda m: chr(int(m[1], 16)), text)
        return [out] if out != text else []
    if tag == "base64":
        return list(_texts(re.findall(BASE64_CANDIDATE, text), base64.b64decode))
    one_case = (x for x in re.findall(HEX_CANDIDATE, text) if x in (x.lower(), x.upper()))
    return [x for x in _texts(one_case, bytes.fromhex) if x.strip().lower().strip("x") not in ("", "hex")]


def chain(text: str, depth: int = MAX_DEPTH) -> Iterator[tuple[str, str]]:
    """(tag of the last decoder, decoded text), depth first."""
    if depth:
        for tag in ("unicode", "url", "base64", "hex"):
            for decoded in step(tag, text):
                yield tag, decoded
                yield from chain(decoded, depth - 1)


def _safe(text: str) -> str:
    """Lone surrogates can't leave Python; they become the replacement character."""
    return text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _in_arrow(rows: DataFrame, text: str, made) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(text)).to_pylist()
            at, tags, places, texts = [], [], [], []
            for i, value in enumerate(source):
                for place, (tag, decoded) in enumerate(made(value or "")):
                    at.append(i)
                    tags.append(tag)
                    places.append(place)
                    texts.append(_safe(decoded))
            if at:
                taken = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tags), pa.array(places, pa.int32()), pa.array(texts)], names=[*batch.schema.names, "tag", "decode_at", "decoded"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"{fields}, tag string, decode_at int, decoded string")


def decode_escapes(rows: DataFrame, text: str = "line_text") -> DataFrame:
    """One decoding of \\u escapes and one of percent escapes (a byte each, as Latin-1)."""
    some = rows.where(F.contains(F.col(text), F.lit("\\u")) | F.contains(F.col(text), F.lit("%")))
    return _in_arrow(some, text, lambda x: [(tag, y) for tag in ("unicode", "url") for y in step(tag, x)])


def decode_chain(rows: DataFrame, text: str = "line_text", depth: int = MAX_DEPTH) -> DataFrame:
    """All decodings up to a depth, each tagged with the decoder that came last."""
    c = F.col(text)
    some = rows.where(F.contains(c, F.lit("\\u")) | F.contains(c, F.lit("%")) | F.regexp_like(c, F.lit("[A-Za-z0-9+/]{20}")))
    return _in_arrow(some, text, lambda x: chain(x, depth))


def with_decoded(rows: DataFrame, stages: list[str], text: str, skip: str, numbers: dict[str, int]) -> DataFrame:
    """Rows with `decoded`, an array of (stage, tag, decode_at, unit) of what the stages make of
    the text: escapes, javascript, chain.  One pass over Arrow batches; skip: a column of rows
    that only escapes apply to."""
    from .structured import rebuilt

    made = {"escapes": lambda x: [(tag, y) for tag in ("unicode", "url") for y in step(tag, x)], "javascript": rebuilt, "chain": chain}
    # what a text must hold for a stage to make anything of it
    marks = {"escapes": re.compile(r"\\u|%"), "javascript": re.compile(r"\+|join|`"), "chain": re.compile(r"\\u|%|[A-Za-z0-9+/]{20}")}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kind = pa.list_(pa.struct([("stage", pa.int32()), ("tag", pa.string()), ("decode_at", pa.int32()), ("unit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, skipped = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, skip))
            out = []
            for value, large in zip(texts, skipped, strict=True):
                found = []
                for stage in stages:
                    if (stage == "escapes" or not large) and marks[stage].search(value):
                        found += [{"stage": numbers[stage], "tag": tag, "decode_at": at, "unit": _safe(decoded)} for at, (tag, decoded) in enumerate(made[stage](value))]
                out.append(found or None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "decoded"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"{fields}, decoded array<struct<stage:int,tag:string,decode_at:int,unit:string>>")


#: Bytes of a piece of what compressed content holds; what holds more comes in pieces of whole lines.  A line that is
#: longer than a piece is cut, and OVERLAP bytes of it come twice, so that no shorter match is lost.
PIECE, OVERLAP = 64 << 20, 1 << 20


def _inflated(data: bytes, window: int) -> Iterator[bytes]:
    """What all members of a stream hold, bit by bit; an error where they are no such stream."""
    while data:
        one = zlib.decompressobj(window)
        while not one.eof and data:
            yield one.decompress(data, 1 << 22)
            data = one.unconsumed_tail
        if not one.eof:
            yield one.flush()
        if not one.eof:
            raise EOFError("compressed content is cut short")
        data = one.unused_data.lstrip(b"\0") if window > zlib.MAX_WBITS else b""


def inflate(data: bytes | None) -> Iterator[tuple[int, str]]:
    """(lines before, text) of the pieces of gzip, zlib or raw deflate data; nothing if it is none of these.

    Memory is bounded by a piece, whatever the data holds: it is read once to see that it is whole, and
    once more for the pieces if there are several."""
    if data is None or len(data) <= LEAST_COMPRESSED:
        return
    for window in (zlib.MAX_WBITS + 16, zlib.MAX_WBITS, -zlib.MAX_WBITS):
        held, size = [], 0
        try:
            for part in _inflated(data, window):
                size += len(part)
                held = [*held, part] if size <= PIECE else []
        except (EOFError, zlib.error):
            continue
        yield from [(0, b"".join(held).decode("utf-8", "replace"))] if size <= PIECE else _pieces(_inflated(data, window))
        return


def _pieces(parts: Iterator[bytes]) -> Iterator[tuple[int, str]]:
    lines, held = 0, b""
    for part in parts:
        held += part
        if len(held) > PIECE:
            cut = held.rfind(b"\n") + 1
            text = (held[:cut] or held).decode("utf-8", "replace")
            yield lines, text
            lines += len(text.splitlines()) if cut else 0
            held = held[cut:] if cut else held[-OVERLAP:]
    if held:
        yield lines, held.decode("utf-8", "replace")


def decompress(files: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Files whose content is compressed, with the text that it holds instead of the content; a row a piece, and in
    lines_before the number of lines of the pieces before."""
    kept = [f for f in files.schema if f.name not in (content, "lines_before")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [*(f.name for f in kept), out, "lines_before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            for i, data in enumerate(batch.column(batch.schema.get_field_index(content))):
                for before, text in inflate(data.as_py()):
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in columns), pa.array([text], pa.string()), pa.array([before], pa.int64())], names=names)

    small_batches(files.sparkSession)
    return files.select(*[F.col(f"`{f.name}`") for f in kept], content).mapInArrow(run, f"{fields}, {out} string, lines_before long")
