"""Text expressions: lines, entropy, secrets' likeness, context. All are Catalyst built-ins.

Patterns get the prefix (?U), so that classes and word boundaries are Unicode ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNICODE = "(?U)"
#: Line ends of whole texts, and those of large files that are read line by line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
PLAIN_LINE_END = "\r\n|[\n\r]"
_SPACE = r"[\s\u001c-\u001f\u0085]"

# The patterns below must be as they are for right results.
ENTROPY_TOKEN = r"[A-Za-z0-9+/=_\-]{32,}"
ENTROPY_EXCLUDE = r"(?i)(?:ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789\+/|MDU6[A-Za-z0-9+/=]{10,})"
SECRET_CONTEXT = (
    r"(?i)\b(?:api[_-]?key|apikey|secret|secret[_-]?key|password|passwd|pwd|token|bearer|auth(?:orization)?|credential|private[_-]?key|access[_-]?key|"
    r"client[_-]?(?:id|secret)|aws|gcp|azure|s3|encryption[_-]?key|signing[_-]?key|jwt|oauth|ssh[_-]?key)\b"
)
BUNDLER_CHUNK = r'import\{[A-Za-z, ]+\}from"\./(?:chunk-|polyfills|main)'


def pattern(p: str) -> Column:
    return F.lit(UNICODE + p)


def search(text: Column, p: str) -> Column:
    return F.regexp_instr(text, pattern(p)) > 0


def strip(text: Column) -> Column:
    """Without white space at both ends (all that Unicode counts)."""
    return F.regexp_replace(text, F.lit(f"{UNICODE}^{_SPACE}+|{_SPACE}+$"), F.lit(""))


def split_lines(text: Column, end: str = LINE_END) -> Column:
    """Lines of a text; an end of line at the text's end makes no further line."""
    # bound by a lambda, so that the text is split once
    whole = F.transform(F.array(F.split(text, end, -1)), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))
    return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.get(whole, F.lit(0)))


def lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a line, with its number from 1 and up to two lines of context on both sides.

    The context is taken from the array of lines before it is taken apart, so it needs no window."""
    split = texts.withColumn("__lines", split_lines(F.col(text)))
    return with_context(split, "__lines").drop(text)


def with_context(split: DataFrame, column: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a line of the array column, with number and context; keep: the condition on lines that go on.

    All is made within the array, so that no row carries the other lines along."""
    around = lambda start, n: F.array_join(F.slice(F.col(column), start, n), "\n")
    numbered = F.transform(F.col(column), lambda line, at: F.struct(at.alias("at"), line.alias("t")))
    if keep is not None:
        numbered = F.filter(numbered, lambda x: keep(x["t"]))

    def row(x: Column) -> Column:
        at = x["at"]
        before = F.when(at > 0, around(F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))).otherwise("")
        after = F.when(at < F.size(column) - 1, around(at + 2, F.lit(2))).otherwise("")
        return F.struct(x["t"].alias("line_text"), before.alias("context_before"), after.alias("context_after"), (at + 1).cast("int").alias("line"))

    return split.select(*[F.col(f"`{c}`") for c in split.columns if c != column], F.inline(F.transform(numbered, row)))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits, to three places; 0 for an empty text."""
    size = F.length(text).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    total = F.aggregate(F.transform(F.array_distinct(F.split(text, "")), share), F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.round(total, 3))


def likely_secret(text: Column, least_length: int = 20, least_entropy: float = 3.5) -> Column:
    """Long enough, not all digits, at least three kinds of characters, and of high entropy."""
    bare = F.regexp_replace(strip(text), r"^['\"`)]+|['\"`)]+$", "")
    kinds = sum((F.regexp_like(bare, F.lit(UNICODE + p)).cast("int") for p in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[+/=_\-@$!%^&*()]")), F.lit(0))
    return F.when(F.length(bare) < least_length, False).when(F.regexp_like(bare, F.lit(UNICODE + r"^\p{Nd}+$")), False).when(kinds < 3, False).otherwise(entropy(bare) >= least_entropy)


def after_separators(text: Column) -> Column:
    """What follows the first '=', and of that the part after the first ':', without quotes around it."""
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)^[^=]*=", ""), r"(?s)^[^:]*:", "")
    return F.regexp_replace(strip(rest), r"^['\"]+|['\"]+$", "")


def context(line: Column) -> Column:
    return F.left(strip(line), F.lit(200))


def redact(secret: Column) -> Column:
    """Stars, but for the ends: 2 and 2 characters up to 16, else 4 and 4; none up to 8."""
    n = F.length(secret)
    shown = lambda k: F.concat(F.left(secret, F.lit(k)), F.repeat(F.lit("*"), n - 2 * k), F.right(secret, F.lit(k)))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).when(n <= 16, shown(2)).otherwise(shown(4))


def fingerprint(rule: Column, secret: Column, file: Column) -> Column:
    """16 hex digits of the SHA-256 of rule, start of the secret, and file name."""
    return F.left(F.sha2(F.concat_ws(":", rule, F.left(secret, F.lit(60)), F.substring_index(file, "/", -1)), 256), F.lit(16))


def printable(text: Column) -> Column:
    """Whether at least half of the characters (rounded down) are printable, tab or line end."""
    hidden = F.length(F.regexp_replace(text, r"[^\p{C}\p{Z}]|[ \n\r\t]", ""))
    return (F.length(text) - hidden) >= F.floor(F.length(text) / 2)


def minified(name: Column, text: Column) -> Column:
    """Bundled JavaScript, on which the entropy sweep is wasted."""
    base, n = F.lower(F.substring_index(name, "/", -1)), F.length(text)
    ends = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    by_name = F.regexp_like(base, F.lit(r"(\.min\.js|\.bundle\.js|\.min\.mjs)$"))
    dense = (ends <= 3) | (n / F.greatest(ends, F.lit(1)) > 2000) | search(text, BUNDLER_CHUNK)
    return by_name | (F.regexp_like(base, F.lit(r"\.m?js$")) & (n >= 5000) & dense)
