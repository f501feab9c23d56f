"""The match operator: rules met with lines by an index of what their matches hold.

Each distinct pattern is evaluated once and fans out to the rules that share it.  From
a pattern come the literals of which every match has one, or another necessary
condition.  A literal's rarest 3-gram is its key in the index.  A line's keys are its own
3-grams, and one look-up - an equi-join with the index - finds the patterns that it may
match; they are tried if the whole literal is there.  So the plan has no rule in it,
and thousands of rules cost a line no more than a few; rules may be a table.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import Rule
from ..sources.shared import small_batches, spread, staged

#: Rules whose matches must also look like a secret.
CHECKED = ("generic_secret", "dotenv_secret", "basic_auth_header", "wakatime_api_key", "airtable_api_key")
_RUN = 22
_RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_HEX = frozenset("0123456789abcdefABCDEF")


@dataclass(frozen=True)
class Need:
    """A condition that holds on every text with a match."""

    literals: tuple[str, ...] = ()  # one of them
    folded: bool = False
    run: str = ""  # name of a shared condition


def _members(items) -> frozenset[str] | None:
    out = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value))
        elif op is sre.RANGE and value[1] < 128:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return frozenset(out)


def _literal_runs(tree, now: str = "") -> list[tuple[str, ...]]:
    """Alternatives of literals, one list for each part that every match has; `now` stands before the tree."""
    found: list[tuple[str, ...]] = []

    def lead(branch) -> str:
        out = ""
        for op, value in branch:
            if op is not sre.LITERAL:
                break
            out += chr(value)
        return out

    for op, value in tree:
        if op is sre.LITERAL:
            now += chr(value)
            continue
        before, now = now, ""
        if op is sre.SUBPATTERN and not (value[1] | value[2]) & re.IGNORECASE:
            found += _literal_runs(value[3], before)
        elif op is sre.BRANCH:
            if before:
                found.append(tuple(before + lead(branch) for branch in value[1]))
            options = [_literal_runs(branch) for branch in value[1]]
            if all(options):
                best = [max(o, key=lambda alts: min(map(len, alts))) for o in options]
                found.append(tuple(x for alts in best for x in alts))
        else:
            if before:
                found.append((before,))
            if op is sre.MAX_REPEAT and value[0] >= 1:
                found += _literal_runs(value[2])
    if now:
        found.append((now,))
    return found


def surest(pattern: str, least: int = 1) -> tuple[tuple[str, ...], bool]:
    """The most selective literals of at least so many characters of which every match has one, and whether
    without regard to case (they are in lower case then); none if that can't be said."""
    tree = sre_parse.parse(pattern)
    folded = bool(tree.state.flags & re.IGNORECASE)
    literals = [alts for alts in _literal_runs(tree) if min(map(len, alts)) >= least]
    best = max(literals, key=lambda alts: (min(map(len, alts)), -len(alts)), default=())
    return tuple(x.lower() if folded else x for x in best), folded


def need(pattern: str) -> Need | None:
    """The most selective condition that can be derived, or None."""
    best, folded = surest(pattern, 2)
    if best and min(map(len, best)) >= 3:
        return Need(best, folded)
    tree = sre_parse.parse(pattern)
    classes = [(value[0], _members(value[2][0][1])) for op, value in tree if op is sre.MAX_REPEAT and len(value[2]) == 1 and value[2][0][0] is sre.IN]
    sizes = [(least, members) for least, members in classes if members]
    if any(least >= _RUN and members <= _RUN_CHARS for least, members in sizes):
        return Need(run="run")
    if len(sizes) == 5 and [s for s, _ in sizes] == [8, 4, 4, 4, 12] and all(m <= _HEX for _, m in sizes):
        return Need(run="uuid")
    if any(least >= 6 and members <= frozenset("0123456789") for least, members in sizes):
        return Need(run="digits")
    return Need(best, folded) if best else None


#: What most secrets have and prose has not: so many of these characters in a row.
TOKEN_RUN = 16
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.")
TOKEN = rf"(?<![A-Za-z0-9_\-+/=.])[A-Za-z0-9_\-+/=.]{{{TOKEN_RUN}}}"
#: Letters outside ASCII that match ASCII ones where case is ignored, and these.
_ODD, _PLAIN = "ſıİK", "siik"
#: Characters one of which many patterns ask for, and prose seldom has.
_MARKS = frozenset(":=-_@")


def all_marks(pattern: str, known: frozenset[str] = _MARKS) -> list[frozenset[str]]:
    """Sets of a few known characters; every match has one of each set."""
    found = []

    def look(tree) -> None:
        for op, value in tree:
            own = frozenset(chr(value)) if op is sre.LITERAL else _members(value) if op is sre.IN else None
            if own and own <= known:
                found.append(own)
            elif op is sre.SUBPATTERN:
                look(value[3])
            elif op is sre.MAX_REPEAT and value[0]:
                look(value[2])

    look(sre_parse.parse(pattern))
    return found


def marks(pattern: str) -> frozenset[str]:
    """A few characters one of which every match has; none if that can't be said."""
    return min(all_marks(pattern), key=lambda x: (len(x), sorted(x)), default=frozenset())


def sure_run(pattern: str) -> int:
    """How many token characters in a row every match has, at least."""

    def follow(tree, now: int) -> tuple[int, int]:
        """(longest run, run at the end) after the parts of the tree, with a run of `now` before them."""
        best = now
        for op, value in tree:
            if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue
            if op is sre.LITERAL and chr(value) in _TOKEN_CHARS or op is sre.IN and (_members(value) or {""}) <= _TOKEN_CHARS:
                now += 1
            elif op is sre.SUBPATTERN:
                inner, now = follow(value[3], now)
                best = max(best, inner)
            elif op is sre.MAX_REPEAT and len(value[2]) == 1 and value[2][0][0] in (sre.IN, sre.LITERAL) and follow(value[2], 0) == (1, 1):
                now += value[0]
            elif op is sre.BRANCH:
                ends = [follow(branch, now) for branch in value[1]]
                best, now = max(best, min(e[0] for e in ends)), min(e[1] for e in ends)
            else:
                now = 0
            best = max(best, now)
        return best, now

    return follow(sre_parse.parse(pattern), 0)[0]


def _holds_one(literals: list[str]) -> Callable[[Column], Column]:
    some = F.expr(f"array({', '.join(map(_sql, literals))})")
    return lambda text: F.exists(some, lambda x: F.contains(text, x))


def gate(active: list[tuple[int, Rule]]) -> Callable[[Column], Column]:
    """A cheap condition that every text with a match fulfils: a run of token characters, an odd
    letter that may stand for one, or what the patterns without such a run need."""
    groups: dict[tuple, list[Need | None]] = {}
    for p, _ in distinct_patterns(active):
        if sure_run(p) < TOKEN_RUN:
            n = need(p)
            groups.setdefault((tuple(sorted(marks(p))), bool(n and n.folded)), []).append(n)

    def any_of(text: Column, marks: tuple[str, ...]) -> Column:
        out = F.contains(text, F.lit(marks[0]))
        for x in marks[1:]:
            out = out | F.contains(text, F.lit(x))
        return out

    def holds(text: Column) -> Column:
        out = F.regexp_like(text, F.lit(TOKEN)) | any_of(text, tuple(_ODD))
        for (few, folded), needs in sorted(groups.items()):
            if None in needs:
                return F.lit(True)
            one = F.lit(False)
            for run in sorted({n.run for n in needs if n.run}):
                one = one | F.regexp_like(text, F.lit(RUNS[run]))
            if literals := sorted({x for n in needs for x in n.literals}):
                one = one | F.exists(F.array(F.lower(text) if folded else text), _holds_one(literals))  # the array binds the unit, so that it is computed once
            out = out | (any_of(text, few) & one if few else one)
        return out

    return holds


#: Shared conditions by name, as patterns.
RUNS = {"run": r"[A-Za-z0-9_\-]{22}", "uuid": r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-", "digits": r"[0-9]{6}"}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------- the index

#: Characters of a key; in tables of rules, keys of literals that are long enough have LONGEST_GRAM, else LONG_GRAM, so
#: that with many rules a key still stands for few of them.  Keys that start
#: with a mark stand for a shared condition, or for all texts.
GRAM, LONG_GRAM, LONGEST_GRAM = 3, 6, 9
_MARK, ANY = "\x00", "\x00any"
#: Entries that go to all tasks at once; a larger index is dealt out by its keys, and only texts that hold one meet it.
ENTRIES_SENT = 200_000
#: Keys, 8 bytes each, by which one pass over the texts looks for those that hold one.
KEYS_SENT = 8_000_000
#: Bytes of text looked through at once.
CHUNK = 1 << 20
#: Entries of the index: texts with the key may match the pattern, if they hold the literal and none of those before it.
ENTRY = "key string, p int, pattern string, literal string, earlier array<string>, folded boolean, rules array<struct<rule_ord:int,rule:string,severity:string>>"
_ENTRY = pa.schema(
    [
        ("key", pa.string()), ("p", pa.int32()), ("pattern", pa.string()), ("literal", pa.string()), ("earlier", pa.list_(pa.string())), ("folded", pa.bool_()),
        ("rules", pa.list_(pa.struct([("rule_ord", pa.int32()), ("rule", pa.string()), ("severity", pa.string())]))),
    ]
)
#: Letters in the order of how often prose has them.
_COMMON = "etaoinshrdlucmfwygpbvkxqjz"


def anchor(literal: str, sizes: tuple[int, ...] = (GRAM,)) -> str | None:
    """The key of a literal: of its ASCII parts of the first size that it has, in lower case, that which prose has least;
    None if it has none."""
    low = literal.lower()
    options = next((found for n in sizes if (found := [low[i : i + n] for i in range(len(low) - n + 1) if low[i : i + n].isascii()])), [])
    return max(options, key=lambda g: (sum(not c.isalpha() for c in g), sum(_COMMON.find(c) for c in g)), default=None)


def entries(p: int, pattern: str, rules: list[tuple[int, str, str]], sizes: tuple[int, ...] = (GRAM,)) -> list[dict]:
    """The index entries of a pattern with its rules (place, name, severity): one for each literal that a match may have."""
    n = need(pattern)
    base = {"p": p, "pattern": X.UNICODE + pattern, "literal": None, "earlier": [], "folded": False, "rules": [dict(zip(("rule_ord", "rule", "severity"), r, strict=True)) for r in rules]}
    if n is None:
        return [base | {"key": ANY}]
    if n.run:
        return [base | {"key": _MARK + n.run}]
    keys = [anchor(x, sizes) for x in n.literals]
    if None in keys:
        return [base | {"key": ANY}]
    return [base | {"key": key, "literal": x, "earlier": list(n.literals[:i]), "folded": n.folded} for i, (key, x) in enumerate(zip(keys, n.literals, strict=True))]


def index_of(spark: SparkSession, active: list[tuple[int, Rule]], sweeps: list[tuple[str, str, Column]] = ()) -> DataFrame:
    """The index of rules with their places, and of sweeps (their p is below 0)."""
    rows = [e for p, (pattern, rules) in enumerate(distinct_patterns(active)) for e in entries(p, pattern, [(place, r.name, r.severity) for place, r in rules])]
    rows += [{"key": f"{_MARK}{i}", "p": -1 - i, "pattern": "(?!)", "literal": None, "earlier": [], "folded": False, "rules": [{"rule_ord": -1, "rule": name, "severity": severity}]} for i, (name, severity, _) in enumerate(sweeps)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, _ENTRY), ENTRY)


def index_table(rules: DataFrame) -> DataFrame:
    """The index of a table of rules (rule_ord, name, severity, pattern), made by the executors; a pattern that Python
    can't read is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for r in batch.to_pylist() for e in entries(r["rule_ord"], r["pattern"], [(r["rule_ord"], r["name"], r["severity"])], (LONGEST_GRAM, LONG_GRAM, GRAM))]
            yield pa.RecordBatch.from_pylist(rows, _ENTRY)

    rows = rules.select(F.col("rule_ord").cast("int"), "name", "severity", "pattern")
    return spread(rows, "rule_ord").mapInArrow(run, ENTRY)


def _marks(text: Column) -> Column:
    """The keys of the shared conditions that a text fulfils, and that of all texts."""
    return F.array_compact(F.array(F.lit(ANY), *[F.when(F.regexp_like(text, F.lit(p)), F.lit(_MARK + name)) for name, p in RUNS.items()]))


_PRIME, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes in a row."""
    n = len(data) - size + 1
    code = data[:n].astype(np.uint64)
    for i in range(1, size):
        code *= _PRIME
        code += data[i : i + n]
    return code


def hashed_keys(keys: Iterable[str]) -> dict[int, bytes]:
    """Hashes of keys by their number of bytes."""
    some: dict[int, list[bytes]] = {}
    for k in keys:
        some.setdefault(len(k), []).append(k.encode())
    return {n: _codes(np.frombuffer(b"".join(ks), np.uint8), n)[::n].tobytes() for n, ks in some.items()}


class _Known:
    """Hashes in order, and a table of those that may be there, so that most looks end with one step."""

    def __init__(self, hashes: bytes):
        self.sorted = np.unique(np.frombuffer(hashes, np.uint64))
        bits = min(26, max(20, (32 * len(self.sorted)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self._places(self.sorted)] = True

    def _places(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _SPREAD) >> self.shift

    def where(self, codes: np.ndarray) -> np.ndarray:
        place = np.flatnonzero(self.table[self._places(codes)])
        some = codes[place]
        at = np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)
        return place[self.sorted[at] == some]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def known_grams(batches: Iterator[pa.RecordBatch], column: str, keys: dict[int, bytes], all_rows: bool) -> Iterator[pa.RecordBatch]:
    """The rows with __grams: those of the keys that the text holds, without regard to case.

    keys: as `hashed_keys` has them.  A byte of text costs a look-up in a table, however many keys there are.
    all_rows: rows without any come too.  Rows that a column __may, if there is one, rules out aren't looked through."""
    known = {size: _Known(hashes) for size, hashes in keys.items()}
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).fill_null(b"").to_pylist()
        if "__may" in batch.schema.names:
            texts = [x if may else b"" for x, may in zip(texts, batch.column(batch.schema.get_field_index("__may")).to_pylist(), strict=True)]
        texts = [x if x.isascii() else _plain(x) for x in texts]
        data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        ends = np.cumsum([len(t) for t in texts])
        found: list[set[str]] = [set() for _ in texts]
        for size, own in known.items():
            for start in range(0, len(data) - size + 1, CHUNK):
                codes = _codes(data[start : start + CHUNK + size - 1], size)
                place = own.where(codes)
                owner = np.searchsorted(ends, place + start, "right")
                inside = place + start + size <= ends[owner]
                place, owner = place[inside], owner[inside]
                # each key of a text once
                order = np.lexsort((codes[place], owner))
                place, owner = place[order], owner[order]
                first = np.ones(len(place), bool)
                first[1:] = (owner[1:] != owner[:-1]) | (codes[place[1:]] != codes[place[:-1]])
                for x, i in zip((place[first] + start).tolist(), owner[first].tolist(), strict=True):
                    found[i].add(data[x : x + size].tobytes().decode("ascii", "replace"))
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(f) for f in found], pa.list_(pa.string()))], names=[*batch.schema.names, "__grams"])
        yield out if all_rows else out.take(pa.array([i for i, f in enumerate(found) if f], pa.int64()))


def _plain(text: bytes) -> bytes:
    for odd, plain in zip(_ODD, _PLAIN, strict=True):
        text = text.replace(odd.encode(), plain.encode())
    return text


def _with_grams(rows: DataFrame, text: str, keys: dict[int, bytes], all_rows: bool) -> DataFrame:
    if all_rows and not keys:
        return rows.withColumn("__grams", F.array().cast("array<string>"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "__grams array<string>"])
    small_batches(rows.sparkSession)
    if sum(map(len, keys.values())) > CHUNK:
        sent = rows.sparkSession.sparkContext.broadcast(keys)
        return rows.mapInArrow(lambda batches: known_grams(batches, text, sent.value, all_rows), kinds)
    return rows.mapInArrow(lambda batches: known_grams(batches, text, keys, all_rows), kinds)


def fold(text: Column) -> Column:
    """In lower case, with ASCII letters for those that match them where case is ignored."""
    return F.lower(F.when(F.regexp_like(text, F.lit(f"[{_ODD}]")), F.translate(text, _ODD, _PLAIN)).otherwise(text))


def _look_up(rows: DataFrame, index: DataFrame, text: str, sweeps: list[tuple[str, str, Column]] = (), may: Column | None = None, grams_only: bool = False) -> DataFrame:
    """Rows with __p, __pattern, __rules and __m, the matches of a pattern that has some: an equi-join of a text's keys
    with the index, which goes to all tasks, then the literal, then the pattern itself.

    Rows have the index's grams that they hold in a column __grams.  may: a condition that all texts
    with a match fulfil; the keys of others aren't made.  grams_only: the index is large and has grams only; both
    sides are dealt out by the key."""
    kind = "array<struct<__key:string,__found:array<string>>>"
    grams = F.col("__grams")
    own = grams if grams_only else F.concat(grams, _marks(F.col(text)))
    keys = F.transform(own if may is None else F.when(may, own).otherwise(F.array().cast("array<string>")), lambda k: F.struct(k.alias("__key"), F.lit(None).cast("array<string>").alias("__found"))).cast(kind)
    swept = [F.struct(F.lit(f"{_MARK}{i}").alias("__key"), secrets.alias("__found")) for i, (_, _, secrets) in enumerate(sweeps)]
    if swept:
        keys = F.concat(keys, F.filter(F.array(*swept).cast(kind), lambda x: F.size(x["__found"]) > 0))
    each = rows.where(F.col(text).isNotNull()).withColumn("__folded", fold(F.col(text))).select("*", F.inline(keys))
    index = index.select(F.col("key").alias("__entry"), *[F.col(c).alias(f"__{c}") for c in ("p", "pattern", "literal", "earlier", "rules")], F.col("folded").alias("__any_case"))
    met = each.join(index.hint("shuffle_merge") if grams_only else F.broadcast(index), F.col("__key") == F.col("__entry"))
    hay = F.when(F.col("__any_case"), F.col("__folded")).otherwise(F.col(text))
    held = F.col("__literal").isNull() | (F.contains(hay, F.col("__literal")) & ~F.exists("__earlier", lambda x: F.contains(hay, x)))
    found = met.where(held).withColumn("__m", F.coalesce("__found", F.regexp_extract_all(F.col(text), F.col("__pattern"), F.lit(0))))
    return found.where(F.size("__m") > 0).drop("__folded", "__grams", "__key", "__found", "__entry", "__literal", "__earlier", "__any_case")


def distinct_patterns(active: list[tuple[int, Rule]]) -> list[tuple[str, list[tuple[int, Rule]]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for place, rule in active:
        out.setdefault(rule.pattern, []).append((place, rule))
    return list(out.items())


def _matches(found: DataFrame, text: str, check: bool | Column) -> DataFrame:
    """One row for each rule and match of what was found, with rule, severity, rule_ord, match_at, secret and column."""
    m = F.col("__m")
    # columns of the matches: lengths of what lies between them, for the few rows that matched
    each = found.withColumn("__gaps", F.split(F.col(text), F.col("__pattern"), -1)).select("*", F.posexplode(m).alias("match_at", "secret"))
    before = F.aggregate(F.when(F.col("match_at") > 0, F.sequence(F.lit(0), F.col("match_at") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, j: acc + F.length(F.get(m, j)) + F.length(F.get(F.col("__gaps"), j)))
    place = 1 + F.length(F.get(F.col("__gaps"), F.col("match_at"))) + before
    each = each.withColumn("column", F.when(F.col("__p") >= 0, place).otherwise(F.instr(F.col(text), F.col("secret"))).cast("int"))
    out = each.withColumn("__rule", F.explode("__rules")).select("*", "__rule.rule_ord", "__rule.rule", "__rule.severity").drop("__p", "__pattern", "__m", "__gaps", "__rules", "__rule")
    if check is not False:
        where = F.lit(True) if check is True else check
        out = out.where(~(where & F.col("rule").isin(*CHECKED)) | X.likely_secret(X.after_separators(F.col("secret")), 12, 3.2))
    return out


def match_rules(rows: DataFrame, active: list[tuple[int, Rule]], text: str = "line_text", check: bool | Column = True, sweeps: list[tuple[str, str, Column]] | None = None, gated: bool = False) -> DataFrame:
    """Rows with rule, severity, rule_ord, match_at, secret and column for each match in the text column.

    check: where to apply the secret's likeness to the rules that ask for it.
    sweeps: further (rule, severity, array of secrets) to find in the same pass;
    their column is the first place of the secret.
    gated: the texts have passed `gate` already."""
    sweeps = sweeps or []
    rows = rows.where(F.col(text).isNotNull()).drop("__grams").withColumn("__may", F.lit(True) if gated else gate(active)(F.col(text)))
    keys = {e["key"] for p, (pattern, _) in enumerate(distinct_patterns(active)) for e in entries(p, pattern, [])}
    held = _with_grams(rows, text, hashed_keys(sorted(k for k in keys if not k.startswith(_MARK))), True)
    return _matches(_look_up(held, index_of(rows.sparkSession, active, sweeps), text, sweeps, F.col("__may")), text, check).drop("__may")


def _key_hashes(index: DataFrame) -> dict[int, bytes]:
    """Hashes of the keys of an index, made by the executors; 8 bytes a key come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = hashed_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array(list(made.values()), pa.binary())], names=["size", "hashes"])

    some: dict[int, list[bytes]] = {}
    for r in index.select("key").distinct().mapInArrow(run, "size int, hashes binary").toLocalIterator():
        some.setdefault(r["size"], []).append(bytes(r["hashes"]))
    return {size: b"".join(hashes) for size, hashes in some.items()}


def match_table(rows: DataFrame, rules: DataFrame, text: str = "line_text", check: bool | Column = False) -> DataFrame:
    """As `match_rules`, for a table of rules (rule_ord, name, severity, pattern) of any size: the plan doesn't depend on
    the rules.

    An index of more than ENTRIES_SENT entries is dealt out by its keys, and so are texts, once for each key that they
    hold: most hold none and stay.  Only rules without a literal, which any text may match, are met in parts by all rows."""
    index = staged(index_table(rules))
    rows = rows.where(F.col(text).isNotNull()).drop("__grams")
    marked = F.startswith("key", F.lit(_MARK))
    n, free = index.agg(F.count("*"), F.count_if(marked)).first()
    if n <= ENTRIES_SENT:
        held = _with_grams(rows, text, _key_hashes(index.where(~marked)), free > 0)
        return _matches(_look_up(held, index, text), text, check)
    found = []
    parts = -(-free // ENTRIES_SENT)
    for i in range(parts):
        part = index.where(marked & (F.pmod(F.xxhash64("key", "p"), F.lit(parts)) == i))
        found.append(_look_up(rows.withColumn("__grams", F.array().cast("array<string>")), part, text))
    parts = -(-(n - free) // KEYS_SENT)
    for i in range(parts):
        part = index.where(~marked & (F.pmod(F.xxhash64("key"), F.lit(parts)) == i))
        found.append(_look_up(_with_grams(rows, text, _key_hashes(part), False), part, text, grams_only=True))
    return _matches(reduce(DataFrame.unionByName, found), text, check)
