"""Reports: JSON, CSV, SARIF, Markdown, HTML and text, and chat messages.

A report is one document by nature, but Spark makes it: a column expression turns each finding into
its piece of text, in the order of the report, between a head with the counts (one aggregate) and an end.
`write_report` has tasks write their pieces and joins the parts under one name; no row passes through
the driver.  `PIECES` gives the same text piece by piece, for a terminal.  Secrets are redacted unless asked for.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import COLUMNS, SEVERITIES, rank_column
from ..sources.shared import staged
from .document import write_document

TOOL, VERSION = "sparksift", "0.1.0"
# SARIF levels by severity, and the columns of CSV, must be as they are for right results.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "none"}
CSV_COLUMNS = ["file", "line", "column", "rule", "severity", "secret", "context", "context_before", "context_after", "entropy"]
SHOWN = 10


def shown(findings: DataFrame, redact: bool = True) -> DataFrame:
    """Findings in the public schema, with secrets redacted."""
    return findings.withColumn("secret", X.redact(F.col("secret")) if redact else F.col("secret")).select(COLUMNS)


def write_json(findings: DataFrame, path: str, redact: bool = True) -> None:
    shown(findings, redact).write.mode("overwrite").json(path)


def write_csv(findings: DataFrame, path: str, redact: bool = True) -> None:
    shown(findings, redact).select(CSV_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(findings: DataFrame, path: str, redact: bool = True) -> None:
    shown(findings, redact).write.mode("overwrite").parquet(path)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule, level, rule_index): rules in the order in which they first appear."""
    from pyspark.sql import Window

    from ..model import rank_column

    order = F.struct(rank_column(F.col("severity")).alias("r"), "file", "line", "column", "secret")
    first = findings.groupBy("rule").agg(F.min(order).alias("o"), F.min_by("severity", order).alias("severity"))
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    # as many rows as there are rules
    return first.select("rule", F.coalesce(levels[F.col("severity")], F.lit("warning")).alias("level"), (F.row_number().over(Window.orderBy("o", "rule")) - 1).alias("rule_index"))


def _counts(findings: DataFrame) -> tuple[int, int, list[tuple[str, int]]]:
    rows = findings.groupingSets([[F.col("severity")], []], F.col("severity")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    by = {r["severity"]: r["n"] for r in rows if r["severity"] is not None}
    whole = next((r for r in rows if r["severity"] is None), None)
    return (whole["n"], whole["files"], [(s, by[s]) for s in SEVERITIES if s in by]) if whole else (0, 0, [])


def sarif_results(findings: DataFrame, redact: bool = True) -> DataFrame:
    """(result): the SARIF result of each finding as JSON text, with the place of its rule in `sarif_rules`."""
    rules = sarif_rules(findings)
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    level = F.coalesce(levels[F.col("severity")], F.lit("warning"))
    region = F.struct(F.col("line").alias("startLine"), F.when(F.col("column") > 0, F.col("column")).alias("startColumn"), F.col("line").alias("endLine"), F.struct(F.left("context", F.lit(200)).alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"), F.struct("secret", "entropy").alias("properties"))
    message = F.struct(F.concat(F.lit("The rule "), "rule", F.lit(" matches here.")).alias("text"))
    result = F.struct(F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), message.alias("message"), F.array(place).alias("locations"))
    named = shown(findings, redact).join(rules.select("rule", "rule_index"), "rule")
    from ..model import rank_column

    return named.orderBy(rank_column(F.col("severity")), "file", "line", "column", "rule", "secret").select(F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, redact: bool = True) -> None:
    """A line for each result, and the rules beside them, written by Spark."""
    sarif_results(findings, redact).write.mode("overwrite").text(f"{path}/results")
    sarif_rules(findings).write.mode("overwrite").json(f"{path}/rules")


# ---------------------------------------------------------------- documents


@dataclass
class Document:
    """A head, pieces (column `piece`, in order) with something between them, and an end."""

    head: str
    rows: DataFrame
    between: str
    end: str


def _by_file(findings: DataFrame, redact: bool) -> DataFrame:
    """Findings in the order of reports - files by their worst severity, then name - with whether one is the first of
    its file, and the first of all."""
    rows = staged(shown(findings, redact).withColumn("__id", F.monotonically_increasing_id()))
    place = F.struct(rank_column(F.col("severity")).alias("r"), "line", "column", "rule", "secret", F.col("__id").alias("i"))
    files = rows.groupBy(F.col("file").alias("__f")).agg(F.min(place).alias("__first"))
    top = files.agg(F.min(F.struct("__first.r", "__f")).alias("t")).first()["t"]
    own = F.col("__first.i") == F.col("__id")
    marked = rows.join(files, F.col("file") == F.col("__f")).withColumn("opens", own).withColumn("first", own & (F.col("file") == F.lit(top["__f"] if top else None)))
    return marked.orderBy("__first.r", "file", rank_column(F.col("severity")), "line", "column", "rule", "secret", "__id").select(*COLUMNS, "opens", "first")


def _words(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def json_document(findings: DataFrame, redact: bool = True) -> Document:
    """One array of findings."""
    rows = shown(findings, redact).select(F.concat(F.lit("\n  "), F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})).alias("piece"))
    return Document("[", rows, ",", "\n]\n")


def csv_document(findings: DataFrame, redact: bool = True) -> Document:
    def cell(name: str) -> Column:
        value = _words(F.col(name))
        return F.when(F.regexp_like(value, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    line = F.concat(*[x for i, c in enumerate(CSV_COLUMNS) for x in ((F.lit(","), cell(c)) if i else (cell(c),))], F.lit("\r\n"))
    return Document(",".join(CSV_COLUMNS) + "\r\n", shown(findings, redact).select(line.alias("piece")), "", "")


def sarif_document(findings: DataFrame, redact: bool = True) -> Document:
    rules = [{"id": r["rule"], "shortDescription": {"text": f"Strings that the rule {r['rule']} describes"}, "defaultConfiguration": {"level": r["level"]}} for r in sarif_rules(findings).orderBy("rule_index").collect()]
    driver = json.dumps({"driver": {"name": TOOL, "version": VERSION, "rules": rules}})
    head = f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {driver}, "results": ['
    return Document(head, sarif_results(findings, redact).select(F.concat(F.lit("\n"), "result").alias("piece")), ",", "\n]}]}\n")


def markdown_document(findings: DataFrame, redact: bool = True, generated: str = "") -> Document:
    """A sentence, a table of counts, and one table of all findings by place."""
    total, files, by = _counts(findings)
    head = "# Exposed strings\n\n" + (f"{total} in {files} file(s)" if total else "None were found") + (f", {generated}" if generated else "") + ".\n"
    if total:
        head += "\n| " + " | ".join(s.capitalize() for s, _ in by) + " |\n|" + "--:|" * len(by) + "\n| " + " | ".join(str(n) for _, n in by) + " |\n"
        head += "" if redact else "\nSecrets stand here in full: keep this document as safe as they are.\n"
        head += "\n| Place | What | Text | Bits |\n|---|---|---|--:|\n"
    cell = lambda c: F.regexp_replace(F.replace(_words(c), F.lit("|"), F.lit("\\|")), "[\r\n]", " ")
    place = F.concat_ws(":", cell(F.col("file")), F.col("line"), F.when(F.col("column") > 0, F.col("column")))
    piece = F.concat(F.lit("| "), place, F.lit(" | "), F.lower("severity"), F.lit(": "), "rule", F.lit(" | `"), cell(F.col("secret")), F.lit("` | "), _words(F.col("entropy")), F.lit(" |\n"))
    return Document(head, _by_file(findings, redact).select(piece.alias("piece")), "", "")


def html_document(findings: DataFrame, redact: bool = True, generated: str = "") -> Document:
    total, files, by = _counts(findings)
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Scan report</title></head><body>\n<h1>Scan report</h1><p>{html.escape(generated)}</p>\n"
    head += f"<p>{total} findings in {files} files: {', '.join(f'{n} {s}' for s, n in by) or 'none'}</p>\n"

    def safe(value: Column) -> Column:
        out = _words(value)
        for mark in "&<>\"'":
            out = F.replace(out, F.lit(mark), F.lit(html.escape(mark)))
        return out

    cells = [F.col("line"), F.when(F.col("column") > 0, F.col("column")), *(F.col(c) for c in ("severity", "rule", "secret", "entropy", "context"))]
    row = F.concat(F.lit("<tr class='"), safe(F.col("severity")), F.lit("'>"), *[x for c in cells for x in (F.lit("<td>"), safe(c), F.lit("</td>"))], F.lit("</tr>\n"))
    title = F.concat(F.when(F.col("first"), "").otherwise("</table>\n"), F.lit("<h2>"), safe(F.col("file")), F.lit("</h2><table><tr><th>Line</th><th>Col</th><th>Severity</th><th>Rule</th><th>Secret</th><th>Entropy</th><th>Context</th></tr>\n"))
    rows = _by_file(findings, redact).select(F.concat(F.when(F.col("opens"), title).otherwise(""), row).alias("piece"))
    return Document(head, rows, "", ("</table>\n" if total else "") + "</body></html>\n")


def text_document(findings: DataFrame, redact: bool = True) -> Document:
    total, files, by = _counts(findings)
    if not total:
        return Document("No secrets found.\n", findings.select(F.lit("").alias("piece")).limit(0), "", "")
    own = F.format_string("  %s:%s  %-8s %s  %s  (entropy %s)\n      %s\n", _words(F.col("line")), _words(F.col("column")), "severity", "rule", _words(F.col("secret")), _words(F.col("entropy")), _words(F.col("context")))
    rows = _by_file(findings, redact).select(F.concat(F.when(F.col("opens"), F.concat("file", F.lit("\n"))).otherwise(""), own).alias("piece"))
    return Document("", rows, "", "\n".join(["", f"Files with findings: {files}", f"Total findings: {total}", *(f"  {s:<10} {n}" for s, n in by)]) + "\n")


DOCUMENTS: dict[str, Callable[..., Document]] = {"json": json_document, "csv": csv_document, "sarif": sarif_document, "markdown": markdown_document, "html": html_document, "text": text_document}


def _pieces(form: str, findings: DataFrame, redact: bool = True) -> Iterator[str]:
    made = DOCUMENTS[form](findings, redact)
    yield made.head
    before = ""
    for row in made.rows.toLocalIterator():
        yield before + row["piece"]
        before = made.between
    yield made.end


PIECES: dict[str, Callable[..., Iterator[str]]] = {form: partial(_pieces, form) for form in DOCUMENTS}


def write_report(findings: DataFrame, form: str, path: str, redact: bool = True) -> None:
    """The report as one file, whose parts the tasks write."""
    made = DOCUMENTS[form](findings, redact)
    write_document(made.rows, path, made.head, made.between, made.end)


def report(findings: DataFrame, form: str, redact: bool = True) -> str:
    """A report as one text, for those that fit."""
    return "".join(PIECES[form](findings, redact))


# ---------------------------------------------------------------- messages


@dataclass
class Digest:
    """What a message says: how many findings of how many files, by severity and by rule, and SHOWN of the worst."""

    total: int
    files: int
    by: list[tuple[str, int]]
    rules: list[tuple[str, int]]
    worst: list[str]


def digest(findings: DataFrame, redact: bool = True) -> Digest:
    """Counts by Spark, and SHOWN lines; no more reaches the driver."""
    total, files, by = _counts(findings)
    rules = findings.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(SHOWN).collect()
    line = F.concat_ws(" ", F.concat_ws(":", "file", "line"), "rule", F.left("secret", F.lit(100)))
    top = shown(findings, redact).orderBy(rank_column(F.col("severity")), "file", "line", "rule", "secret").limit(SHOWN).select(line.alias("w")).collect()
    return Digest(total, files, by, [(r["rule"], r["n"]) for r in rules], [r["w"] for r in top])


def _summary(d: Digest) -> str:
    return f"{d.total} exposed strings, {d.files} files. " + ", ".join(f"{s.lower()} {n}" for s, n in d.by) if d.total else "Nothing exposed."


def _plain(lines: list[str]) -> str:
    """Lines as preformatted text of a chat, which three backticks would end."""
    return "```\n" + "\n".join(x.replace("`", "'") for x in lines) + "\n```"


def slack_message(findings: DataFrame, redact: bool = True) -> dict:
    """The summary, the rules that hit most as fields, and the worst lines as one preformatted text."""
    d = digest(findings, redact)
    text = lambda t: {"type": "mrkdwn", "text": t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")}
    blocks = [{"type": "section", "text": text(_summary(d))}]
    if d.total:
        blocks[0]["fields"] = [text(f"{n} x {rule}") for rule, n in d.rules]
        blocks.append({"type": "section", "text": text(_plain(d.worst)[:2900])})
    return {"text": _summary(d), "blocks": blocks}


def discord_message(findings: DataFrame, redact: bool = True) -> dict:
    """One embed: the summary as its title, rules and worst lines in its text."""
    d = digest(findings, redact)
    rules = "; ".join(f"{rule} ({n})" for rule, n in d.rules)
    return {"embeds": [{"title": _summary(d)[:256], "description": (f"{rules}\n{_plain(d.worst)}" if d.total else "")[:4000]}], "allowed_mentions": {"parse": []}}


def json_message(findings: DataFrame, redact: bool = True) -> dict:
    """All findings in one message, as its receiver wants them; a table is better served by `streaming.alerts`."""
    rows = shown(findings, redact).select("file", "line", "rule", "severity", "secret", "context", "entropy").toLocalIterator()
    items = [r.asDict() for r in rows]
    return {"findings": items, "total": len(items)}


MESSAGES = {"slack": slack_message, "discord": discord_message, "json": json_message}


def send(message: dict, transport, tries: int = 3, wait=None) -> bool:
    """Hand a message to transport(message) -> bool, three times at most, after waits of 1 and 2 seconds."""
    import time

    for i in range(tries):
        try:
            if transport(message):
                return True
        except OSError:
            pass
        if i + 1 < tries:
            (wait or time.sleep)(2**i)
    return False
