"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and long texts are split at safe boundaries, so
that no call holds more than about BATCH_BYTES of text.  A boundary is safe
before a space that stands alone between two characters that aren't white space:
byte-level pre-tokenizers start a new piece there.  Files with another
pre-tokenizer, with a normalizer, or with an added string that holds white space
have no such boundaries; their texts stay whole.

`.json` files go to the `tokenizers` library, `.model` files to `sentencepiece`
(whole texts: its dummy prefix belongs to the text).  No begin, end or added special tokens, no truncation or padding; special strings inside texts are
handled as the library does by default.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes that one call of the library gets.
BATCH_BYTES = 1 << 20
#: Texts longer than this (characters) are split.
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to token counts; loaded once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether the file's pieces start at lone spaces, whatever stands around them."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain and not spec.get("normalizer") and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])))


def split_safely(text: str, limit: int = PART_CHARS) -> list[str]:
    """Parts of about `limit` characters whose token counts add up to the text's."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


def count_batch(texts: list[str], path: str, split: bool = True) -> np.ndarray:
    """Token counts of the texts, by calls balanced by bytes; equal parts of a batch are encoded once."""
    splittable = split and splits_at_spaces(path)
    owners, parts = [], []
    for i, text in enumerate(texts):
        for part in split_safely(text) if splittable and len(text) > PART_CHARS else (text,):
            owners.append(i)
            parts.append(part)
    distinct = list(dict.fromkeys(parts))
    counts: dict[str, int] = {}
    count = _counter(path)
    batch, size = [], 0
    for part in distinct:
        batch.append(part)
        size += len(part.encode())
        if size >= BATCH_BYTES:
            counts.update(zip(batch, count(batch), strict=True))
            batch, size = [], 0
    counts.update(zip(batch, count(batch) if batch else [], strict=True))
    out = np.zeros(len(texts), np.int64)
    np.add.at(out, np.array(owners, np.int64), np.array([counts[p] for p in parts], np.int64))
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document; one narrow pass, no shuffle."""
    C.small_batches(docs.sparkSession)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.octet_length("text").alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.byte_slices(batches, "text"):
            n = count_batch(["" if x is None else x for x in batch.column(1).to_pylist()], tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int64()).fill_null(0), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return counted.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
