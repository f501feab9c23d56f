"""Reports as documents that tasks write, against plain Python."""

import csv
import html
import io
import json

import pytest
from pyspark.sql import functions as F

from sparksift.model import COLUMNS, FINDING, SEVERITIES
from sparksift.sinks import document, reports


@pytest.fixture(scope="module")
def findings(spark):
    rows = []
    for i in range(300):
        file = f"f{i % 7}<&>.py" if i % 5 else f'a|"b\', {i % 3}.txt'
        rows.append((file, i % 40, f"rule_{i % 4}", SEVERITIES[(i // 7) % 5], f"se`cret|{i}\n<x>", f"ctx, \"{i}\"\r\n'é'", 3.5 + i % 3, i % 6, "b\n1", ""))
    return spark.createDataFrame([*rows, rows[0]], FINDING).repartition(6)


def ordered(rows):
    worst = {}
    for r in rows:
        worst[r.file] = min(worst.get(r.file, 9), SEVERITIES.index(r.severity))
    return sorted(rows, key=lambda r: (worst[r.file], r.file, SEVERITIES.index(r.severity), r.line, r.column, r.rule, r.secret))


@pytest.mark.parametrize("form", sorted(reports.DOCUMENTS))
def test_sink_writes_what_the_pieces_say(spark, findings, tmp_path, form):
    sorted_rows = findings.orderBy(*COLUMNS)
    for rows in (sorted_rows, findings.limit(0)):
        reports.write_report(rows, form, str(tmp_path / "r"), redact=False)
        assert (tmp_path / "r").read_bytes().decode() == reports.report(rows, form, redact=False)
        assert [p.name for p in tmp_path.iterdir()] == ["r"]


def test_documents_hold_all_findings_in_order(findings):
    rows = findings.collect()
    items = json.loads(reports.report(findings, "json", redact=False))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in items), key=key) == sorted((tuple(r) for r in rows), key=key)
    table = list(csv.DictReader(io.StringIO(reports.report(findings, "csv", redact=False), newline="")))
    assert sorted((r["file"], r["secret"], r["context"], r["entropy"]) for r in table) == sorted((r.file, r.secret, r.context, str(r.entropy)) for r in rows)
    text = reports.report(findings, "html", redact=False)
    assert text.count("<table>") == text.count("</table>") == len({r.file for r in rows}) and text.count("<tr class=") == 301
    assert [x.split("</td>")[0] for x in text.split("<td>")[5::7]] == [html.escape(r.secret) for r in ordered(rows)]
    assert [x.split("</h2>")[0] for x in text.split("<h2>")[1:]] == list(dict.fromkeys(html.escape(r.file) for r in ordered(rows)))
    markdown = reports.report(findings, "markdown", redact=False).split("|--:|\n")[-1].splitlines()
    assert [x.split("` |")[0].split("| `")[1] for x in markdown] == [r.secret.replace("|", "\\|").replace("\n", " ") for r in ordered(rows)]
    plain = reports.report(findings, "text", redact=False)
    assert plain.count("entropy") == 301 and f"Total findings: {301}" in plain
    sarif = json.loads(reports.report(findings, "sarif", redact=False))["runs"][0]
    assert len(sarif["results"]) == 301 and all(sarif["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in sarif["results"])


def test_a_failed_report_leaves_nothing(spark, findings, tmp_path):
    rows = spark.range(1000).repartition(5).select(F.when(F.col("id") == 700, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("piece"))
    with pytest.raises(Exception, match="lost"):
        document.write_document(rows, str(tmp_path / "r"), "h", ",", "e")
    assert not (tmp_path / "r").exists()
