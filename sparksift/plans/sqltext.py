"""DuckDB SQL for the registered queries, put together from the same rules and patterns."""

from __future__ import annotations

from ..functions import text as X
from ..model import SEVERITIES, ScanOptions
from ..operators.match import CHECKED, distinct_patterns

#: Ends of lines, as RE2 writes them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines(source: str) -> str:
    """CTE body: lines (file, line, line_text, parts) of a source with file and text."""
    return f"""SELECT file, CAST(i AS INTEGER) AS line, parts[i] AS line_text, parts FROM (
    SELECT file, CASE WHEN text = '' THEN [] WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS parts
    FROM (SELECT file, text, string_split_regex(text, {quoted(LINE_END)}) AS p FROM {source} WHERE text IS NOT NULL)), unnest(range(1, len(parts) + 1)) AS t(i)"""


def entropy(x: str) -> str:
    share = f"((length({x}) - length(replace({x}, c, ''))) / CAST(length({x}) AS DOUBLE))"
    return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE round(coalesce(-list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: {share} * log2({share}))), 0), 3) END"


def likely(x: str, size: int, least: float) -> str:
    bare = f"trim(trim({x}), chr(39) || '\"`)')"
    kinds = " + ".join(f"CAST(regexp_matches({bare}, {quoted(p)}) AS INTEGER)" for p in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[+/=_\-@$!%^&*()]"))
    return f"(length({bare}) >= {size} AND NOT regexp_matches({bare}, '^[0-9]+$') AND ({kinds}) >= 3 AND {entropy(bare)} >= {least})"


def named_secret(x: str) -> str:
    """Whether the value of a JSON key that names a secret may be one, as `structured.secret_key` has it."""
    return f"(length({x}) >= 8 AND NOT regexp_full_match({x}, '\\p{{Nd}}+') AND {entropy(x)} >= 3.0)"


def candidate(x: str) -> str:
    return f"trim(trim(regexp_replace(regexp_replace({x}, '^[^=]*=', ''), '^[^:]*:', '')), chr(39) || '\"')"


def hits(source: str, text: str, options: ScanOptions, keep: str = "file, line", check: bool = True) -> str:
    """CTE body: (keep, secret, rule, severity, rule_ord, col) of all rules on a text column."""
    patterns = distinct_patterns(options.active())
    parts, names = [], []
    for i, (p, rules) in enumerate(patterns):
        m, g = f"regexp_extract_all({text}, {quoted(p)})", f"string_split_regex({text}, {quoted(p)})"
        parts.append(f"SELECT {keep}, {text} AS unit, {i} AS p, {m} AS m, {g} AS g FROM {source} WHERE regexp_matches({text}, {quoted(p)})")
        names += [f"({i}, {place}, {quoted(r.name)}, {quoted(r.severity)})" for place, r in rules]
    where = f"WHERE rule NOT IN ({', '.join(map(quoted, CHECKED))}) OR {likely(candidate('secret'), 12, 3.2)}" if check else ""
    col = "CAST(1 + length(g[j]) + coalesce(list_sum(list_transform(range(1, j), lambda k: length(m[k]) + length(g[k]))), 0) AS INTEGER)"
    return f"""SELECT * FROM (SELECT {keep}, unit, m[j] AS secret, {col} AS col, j, rule, severity, rule_ord
    FROM ({' UNION ALL '.join(parts)}), unnest(range(1, len(m) + 1)) AS t(j) JOIN (VALUES {', '.join(names)}) AS n(np, rule_ord, rule, severity) ON np = p) {where}"""


def rank(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " ELSE 99 END"


def once(source: str) -> str:
    """CTE body: the first of each file, line, rule and start of the secret."""
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY file, line, rule, left(secret, 30) ORDER BY rule_ord, j) = 1"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '')"


SECRET_CONTEXT = quoted(X.SECRET_CONTEXT)
