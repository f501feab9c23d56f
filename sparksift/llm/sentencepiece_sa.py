"""SentencePiece encoding and decoding by suffix-array matching.

The text is escaped as the model says (a leading mark, spaces as marks) and cut in
segments that no piece crosses: before a mark that follows another character, and
around characters that no piece of several characters holds.  The distinct new
segments of a batch are concatenated and indexed by a suffix array (prefix
doubling up to the longest piece); every piece is binary-searched in it for its
occurrence range; the ranges' occurrences are edges (start, length, piece), sorted by position.
Then the edges are relaxed: for BPE models the best-scored merge whose result is an
edge is taken in all segments at once, until none is left; for unigram models a
forward pass keeps the best path to each position.  Characters without a piece
become byte pieces, or the unknown piece.

Texts of more than INDEXED characters are indexed in parts that overlap by the
longest piece.  In segments of more than LONG characters the same edges are relaxed
in the same order through a heap, so that their time stays near linear.  A bounded
cache of two generations holds segments that were encoded.

Defined results: a null text gives null ids and a null decoded text; an empty text
gives no ids; repeated rows encode alike; an empty table gives no rows; other
columns pass through, but for those that are added.  A mark (U+2581) in a text
decodes as a space, as with the library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
#: Characters indexed by one suffix array, and in the longest segment whose merges are made together with the others'.
INDEXED, LONG = 300_000, 400
CACHED = 80_000


class Model:
    """Pieces and scores of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalization and prefix marks are supported")
        if spec.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe = spec.trainer_spec.model_type == 2
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        self.unk = self.library.unk_id()
        kinds = [p.type for p in spec.pieces]
        self.text = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        if any(k in (4, 5) for k in kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.scores = np.array([p.score for p in spec.pieces])
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i, k in enumerate(kinds) if k in (2, 3)}
        self.odd = np.array([p.type != 1 for p in spec.pieces])
        # equal scores have equal ranks: the leftmost merge goes first then
        order = np.unique(-self.scores, return_inverse=True)[1]
        self.rank = order.astype(np.int64)
        self.several = sorted(((p, i) for p, i in self.ids.items() if len(p) > 1))
        self.longest = max([1, *(len(p) for p, _ in self.several)])
        joined = {c for p, _ in self.several for c in p}
        if any(MARK in p.lstrip(MARK) or (p.strip(MARK) and p.startswith(MARK * 2)) for p, _ in self.several):
            raise ValueError("pieces with marks inside are not supported")
        inner = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        self.segments = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[\\s\\S]" if inner else f"{MARK}+|[\\s\\S]")
        # dense codes of the characters that pieces of several characters hold; 0 ends a segment
        self.code = {ord(c): i + 1 for i, c in enumerate(sorted(joined))}
        self.table = np.zeros(0x110000, np.uint32)
        for c, i in self.code.items():
            self.table[c] = i
        codes = np.zeros((len(self.several), self.longest), np.uint32)
        for row, (p, _) in enumerate(self.several):
            codes[row, : len(p)] = [self.code[ord(c)] for c in p]
        self.piece_codes = codes
        self.piece_ids = np.array([i for _, i in self.several], np.int64)
        self.piece_lengths = np.array([len(p) for p, _ in self.several], np.int64)

    def escape(self, text: str) -> str:
        return (MARK if self.dummy and text else "") + text.replace(" ", MARK)

    def single(self, char: str) -> list[int]:
        """Ids of a character that is no part of a longer piece here."""
        if (i := self.ids.get(char)) is not None:
            return [i]
        if self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8")]
        return [self.unk]


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the `depth` codes that follow (prefix doubling)."""
    rank = codes.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] if width < len(rank) else 0
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty_like(rank)
        rank[order] = new
        width *= 2
        if new[-1] == len(rank):
            break
    return order


def occurrences(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, length, id) of all pieces of several characters, sorted by position."""
    order = suffix_array(codes, model.longest)
    padded = np.concatenate([codes, np.zeros(model.longest, np.uint32)])
    heads = np.lib.stride_tricks.sliding_window_view(padded, model.longest)[order].astype(np.uint32)
    width = model.longest
    # numpy compares these as strings of code points
    texts = np.ascontiguousarray(heads).view(f"U{width}").ravel()
    low = np.searchsorted(texts, model.piece_codes.view(f"U{width}").ravel(), "left")
    last = model.piece_codes.copy()
    last[np.arange(width)[None, :] >= model.piece_lengths[:, None]] = len(model.code) + 1
    high = np.searchsorted(texts, last.view(f"U{width}").ravel(), "right")
    counts = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
    start, length = order[place], model.piece_lengths[which]
    by = np.argsort(start * (width + 1) + length, kind="stable")
    return start[by], length[by], model.piece_ids[which][by]


def edges_of(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All edges, by a suffix array for each INDEXED codes and what a piece may reach beyond them."""
    if len(codes) <= INDEXED + model.longest:
        return occurrences(model, codes)
    found = []
    for low in range(0, len(codes), INDEXED):
        start, length, ids = occurrences(model, codes[low : low + INDEXED + model.longest])
        own = start < INDEXED
        found.append((start[own] + low, length[own], ids[own]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merge(model: Model, codes: np.ndarray, bounds: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mask of positions where a symbol starts after all merges; bounds are the segments' starts and the end."""
    width = model.longest + 1
    starts = np.ones(len(codes) + 1, bool)
    live = np.flatnonzero(codes > 0)  # symbols of segments that may still merge; 0 stands after each segment
    if not len(live):
        return starts
    table = np.full((len(codes), width), -1, np.int32)
    table[edges[0], edges[1]] = edges[2]
    segment = np.searchsorted(bounds, live, "right") - 1
    ends = bounds[1:] - 1
    while len(live) > 1:
        # a symbol ends where the next one of its segment starts, or at the segment's end
        stop = np.where(np.append(segment[1:] == segment[:-1], False), np.append(live[1:], 0), ends[segment])
        pair = np.flatnonzero(segment[1:] == segment[:-1])
        length = stop[pair + 1] - live[pair]
        fits = length < width
        pair, length = pair[fits], length[fits]
        piece = table[live[pair], length]
        good = piece >= 0
        pair, piece = pair[good], piece[good]
        if not len(pair):
            break
        key = (model.rank[piece] << 32) | pair
        head = np.flatnonzero(np.concatenate([[True], segment[pair][1:] != segment[pair][:-1]]))
        best = np.minimum.reduceat(key, head) if len(head) else np.zeros(0, np.int64)
        chosen = best & 0xFFFFFFFF
        starts[live[chosen + 1]] = False
        busy = np.zeros(len(bounds), bool)
        busy[segment[chosen]] = True
        keep = busy[segment]
        keep[chosen + 1] = False
        live, segment = live[keep], segment[keep]
    return starts


def _best_path(model: Model, size: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], begin: int, chars: str) -> list[tuple[int, int]]:
    """Unigram models: spans of the best path over one segment, edges relaxed by position."""
    penalty = float(model.scores.min()) - 10.0
    best, back = [-np.inf] * (size + 1), [0] * (size + 1)
    best[0] = 0.0
    low, high = np.searchsorted(edges[0], [begin, begin + size])
    own = list(zip((edges[0][low:high] - begin).tolist(), edges[1][low:high].tolist(), model.scores[edges[2][low:high]].tolist(), strict=True))
    own += [(i, 1, float(model.scores[model.ids[c]]) if c in model.ids else penalty) for i, c in enumerate(chars)]
    for start, length, score in sorted(own):
        if start + length <= size and best[start] + score > best[start + length]:
            best[start + length], back[start + length] = best[start] + score, start
    spans, at = [], size
    while at:
        spans.append((back[at], at))
        at = back[at]
    return spans[::-1]


def _heap_merge(model: Model, size: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], begin: int) -> list[int]:
    """Starts of symbols after the BPE merges of one long segment, its edges relaxed through a heap of pairs."""
    low, high = np.searchsorted(edges[0], [begin, begin + size])
    first = np.searchsorted(edges[0][low:high], np.arange(begin, begin + size + 1)).tolist()
    lengths, ids = edges[1][low:high], edges[2][low:high]
    rank = model.rank[ids]
    after, before, width = list(range(1, size + 1)), list(range(-1, size - 1)), [1] * size
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < size:
            both = width[i] + width[j]
            for at in range(first[i], first[i + 1]):
                if lengths[at] == both:
                    heapq.heappush(heap, (int(rank[at]), i, both))

    for i in range(size):
        offer(i)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if not width[i] or j >= size or width[i] + width[j] != length:
            continue
        width[i], width[j], after[i] = length, 0, after[j]
        if after[j] < size:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [i for i in range(size) if width[i]]


def encode_segments(model: Model, segments: list[str]) -> dict[str, bytes]:
    """Little-endian int32 ids of each distinct segment."""
    out: dict[str, bytes] = {}
    group: list[str] = []
    size = 0

    def finish() -> None:
        joined = "\0".join(group) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = model.table[points]
        lengths = np.fromiter(map(len, group), np.int64, len(group)) + 1
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        edges = edges_of(model, codes)
        if model.bpe:
            apart = [i for i, text in enumerate(group) if len(text) > LONG]
            quick = codes
            if apart:
                quick = codes.copy()
                for i in apart:
                    quick[bounds[i] : bounds[i + 1]] = 0
            starts = _merge(model, quick, bounds, edges)
            for i in apart:
                starts[bounds[i] : bounds[i + 1] - 1] = False
                starts[[bounds[i] + x for x in _heap_merge(model, len(group[i]), edges, int(bounds[i]))]] = True
        else:
            starts = np.zeros(len(codes) + 1, bool)
            for text, begin in zip(group, bounds.tolist(), strict=False):
                starts[[begin + a for a, _ in _best_path(model, len(text), edges, begin, text)]] = True
            starts[bounds[1:] - 1] = True
        at = np.flatnonzero(starts[:-1])
        length = np.append(at[1:], len(codes)) - at
        # the id of each symbol of several characters is that of its edge; edges are sorted by place and length
        width = model.longest + 1
        ids = np.full(len(at), -1, np.int32)
        several = np.flatnonzero(length > 1)
        ids[several] = edges[2][np.searchsorted(edges[0] * width + edges[1], at[several] * width + length[several])]
        alone = np.flatnonzero(length == 1)
        kinds, row = np.unique(points[at[alone]], return_inverse=True)
        single = [model.single(chr(c)) if c else [] for c in kinds.tolist()]
        ids[alone] = np.array([x[0] if len(x) == 1 else -1 for x in single], np.int32)[row]
        ends = np.searchsorted(at, bounds)
        many = {int(alone[i]): single[row[i]] for i in np.flatnonzero(np.array([len(x) > 1 for x in single])[row])} if single else {}
        plain = ids.tobytes()
        for k, text in enumerate(group):
            a, b = int(ends[k]), int(ends[k + 1]) - 1  # the last one is the separator
            raw = plain[4 * a : 4 * b]
            if many and (ids[a:b] < 0).any():
                raw = np.array([x for i in range(a, b) for x in ([int(ids[i])] if ids[i] >= 0 else many[i])], "<i4").tobytes()
            out[text] = raw

    for text in segments:
        if len(text) == 1 and ord(text) not in model.code:
            out[text] = np.array(model.single(text), "<i4").tobytes()
        else:
            if group and size + len(text) >= INDEXED:
                finish()
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
    if group:
        finish()
    return out


class Encoder:
    """Encodes batches, with a bounded cache of segments."""

    def __init__(self, path: str):
        # two generations: what the older one held and is met again moves to the newer one
        self.model, self.cache, self.older = load(path), {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.model.segments.findall(self.model.escape(t)) for t in texts]
        missing = set().union(*cut).difference(self.cache) if cut else set()
        again = missing.intersection(self.older)
        self.cache.update((s, self.older[s]) for s in again)
        self.cache.update(encode_segments(self.model, list(missing - again)))
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), "<i4") for c in cut]
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [decode(self.model, x) for x in ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process, so that its cache outlives a task."""
    return Encoder(path)


def decode(model: Model, ids: np.ndarray) -> str:
    """Text of the ids: pieces joined, byte pieces as UTF-8 (what isn't valid as U+FFFD, byte by byte)."""
    if not model.odd[ids].any():
        out = "".join(map(model.text.__getitem__, ids.tolist()))
        return (out[1:] if model.dummy and out.startswith(MARK) else out).replace(MARK, " ")
    parts: list[str] = []
    run = bytearray()
    byte_of, text = model.byte_of, model.text

    def close() -> None:
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    parts.append(bytes(run[at : at + size]).decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    if size == 4:
                        parts.append("�")
                        at += 1
        run.clear()

    for i in ids.tolist():
        if (b := byte_of.get(i)) is not None:
            run.append(b)
            continue
        if run:
            close()
        if i == model.unk:
            parts.append(" ⁇ ")
        elif i not in model.special:
            parts.append(text[i])
    if run:
        close()
    out = "".join(parts)
    if model.dummy and out.startswith(MARK):
        out = out[1:]
    return out.replace(MARK, " ")


def encode(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """Documents with n_tokens, ids (array of int) and round_trip (decoding gives the text again; null without check)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("n_tokens", "ids", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in C.byte_slices(batches, "text"):
            # the whole slice at once: searching every piece costs the same for a small one
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = own.encode([t or "" for t in texts])
            same = [None if t is None or not check else a == t.replace(MARK, " ") for t, a in zip(texts, own.decode(ids) if check else texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if t is None else len(x) for t, x in zip(texts, ids, strict=True)], pa.int64()), lists, pa.array(same, pa.bool_())], names=[*batch.schema.names, "n_tokens", "ids", "round_trip"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, n_tokens long, ids array<int>, round_trip boolean")


def digest(encoded: DataFrame) -> DataFrame:
    """ids as a SHA-256 over their decimal numbers joined by one space."""
    return encoded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256))
