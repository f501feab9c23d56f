"""Table functions for SQL: scan_line, decode_rescan and json_walk, to be used with LATERAL.

    SELECT t.id, f.* FROM t, LATERAL scan_line(t.line) f

They are for single lines within SQL; tables go through `sparksift.plans.scan`."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..model import builtin_rules
from ..operators import decode, structured

_COMPILED: list[tuple[str, str, re.Pattern]] = []


def _rules() -> list[tuple[str, str, re.Pattern]]:
    if not _COMPILED:
        _COMPILED.extend((r.name, r.severity, re.compile(r.pattern)) for r in builtin_rules())
    return _COMPILED


def _found(line: str):
    for name, severity, pattern in _rules():
        for m in pattern.finditer(line):
            yield name, severity, m[0], m.start() + 1


class ScanLine:
    """Matches of the built-in rules in a line, in the order of the rules; none for null."""

    def eval(self, line: str):
        yield from _found(line) if line is not None else ()


class DecodeRescan:
    """Matches in what the line says once it is decoded, with the decoder that came last."""

    def eval(self, line: str):
        for tag, decoded in decode.chain(line) if line is not None else ():
            for name, severity, secret, _ in _found(decoded):
                yield tag, f"{tag}_{name}", severity, secret


class JsonWalk:
    """Texts of a JSON document with their key paths; none for null or what isn't JSON."""

    def eval(self, text: str):
        import json

        try:
            yield from structured.walk(json.loads(text)) if text is not None else ()
        except (ValueError, RecursionError):
            return


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, handler, returns in (
        ("scan_line", ScanLine, "rule string, severity string, secret string, column int"),
        ("decode_rescan", DecodeRescan, "tag string, rule string, severity string, secret string"),
        ("json_walk", JsonWalk, "key_path string, value string"),
    ):
        spark.udtf.register(name, udtf(handler, returnType=returns))
