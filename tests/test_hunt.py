"""The stage chain, names, and the table functions."""

import base64
import json

from pyspark.sql import functions as F

from sparksift.functions import tables
from sparksift.model import ScanOptions
from sparksift.operators import post
from sparksift.plans import hunt
from sparksift.sources.files import fetched_name

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def test_live_urls_and_candidates(spark):
    lines = spark.createDataFrame([("https://a/x.js [200] [Title]",), ("  http://b/y.JS\t[404]",), ("",), ("   ",), (None,)], "value string")
    assert {r.url for r in hunt.live_urls(lines).collect()} == {"https://a/x.js", "http://b/y.JS"}
    rows = [("https://a/z.js", 3), ("https://a/b.js", 1), ("ftp://a/c.js", 0), (" https://a/b.js ", 7), ("https://a/page", 2), ("https://out/d.js", 0), (None, 5)]
    urls = spark.createDataFrame(rows, "url string, position int")
    got = lambda **k: [r.url for r in hunt.candidate_urls(urls, hunt.HuntOptions(**k)).orderBy("position").collect()]
    assert got(scope="^https://a/") == ["https://a/b.js", "https://a/z.js"] and got(most=1) == ["https://out/d.js"]
    assert got(scripts_only=False, scope="//a/") == ["https://a/b.js", "https://a/page", "https://a/z.js"]


def test_names_that_collide(spark):
    rows = spark.createDataFrame([(i, f"https://h{i}/a.min.js?v={i}") for i in range(5)] + [(9, "https://h/"), (10, "https://g/?q")], "i int, url string")
    name = fetched_name(F.col("url"))
    want = {"a.min.js", "a.min_1.js", "a.min_2.js", "a.min_3.js", "a.min_4.js", "index.html", "index_1.html"}
    got = {r.i: r.name for r in hunt.collision_names(rows, name, ["url"]).collect()}
    assert set(got.values()) == want and got[0] == "a.min.js" and got[4] == "a.min_4.js" and got[10] == "index.html"
    # a name that a third of all rows share is numbered in order, whatever number of tasks holds it
    many = spark.createDataFrame([(i, f"https://h{i * 7919 % 4000:05}/" + ("" if i % 3 else f"{i}.js")) for i in range(4000)] + [(9999, None)], "i int, url string")
    got = hunt.collision_names(many, name, ["url", "i"]).collect()
    index = [r.name for r in sorted((r for r in got if r.url and r.url.endswith("/")), key=lambda r: r.url)]
    assert index == ["index.html", *(f"index_{k}.html" for k in range(1, len(index)))] and len(index) == 2666 and len(got) == 4001


def test_hunt_goes_on_where_it_stopped(spark, tmp_path):
    inner = json.dumps({"sources": ["src/a.ts", "lib/a.ts", "b.ts"], "sourcesContent": [f"k = '{TOKEN}'", "let second = 1", ""]})
    inline = "data:application/json;base64," + base64.b64encode(inner.encode()).decode()
    pages = [
        ("https://a/1.js", f'import "https://a/2.js"; let apiUrl = "https://api.example/v1/x";\n//# sourceMappingURL={inline}'),
        ("https://a/2.js", 'import "https://a/1.js"; "https://a/3.js"\n//# sourceMappingURL=2.js.map'),
        ("https://a/3.js", 'import "https://a/4.js"'),
        ("https://a/2.js.map", json.dumps({"sources": ["c.ts"], "sourcesContent": ["mail@host.example"]})),
        ("https://b/1.js", f'import "https://a/2.js"; let apiUrl = "https://api.example/v1/x";\n//# sourceMappingURL={inline}'),
        ("https://a/app.js/page.html", f"<script> </script><script>var t = '{TOKEN}';</script>"),
        ("https://a/empty.js", ""),
    ]
    table = spark.createDataFrame(pages, "url string, html string")
    urls = spark.createDataFrame([("https://a/1.js", 0), ("https://b/1.js", 1), ("https://a/app.js/page.html", 2), ("https://a/empty.js", 3)], "url string, position int")
    one = hunt.Hunt(spark, str(tmp_path / "h"), hunt.HuntOptions(depth=2, scan=ScanOptions(entropy=False, json=False)))
    assert one.next_stage() == "urls"
    out = one.run(urls, table)
    assert {(r.url, r.level) for r in out["reached"].collect() if r.level} == {("https://a/2.js", 1), ("https://a/3.js", 2)}
    # equal contents: the first by name stays
    assert {r.file for r in out["files"].collect()} == {"1.js", "2.js", "3.js", "page.html"}
    assert {(r.file, r.text) for r in out["scripts"].collect()} == {("page.inline-2.js", f"var t = '{TOKEN}';")}
    assert {(r.file, r.text) for r in out["sources"].collect()} == {("sources/a.ts", f"k = '{TOKEN}'"), ("sources/a_1.ts", "let second = 1"), ("sources/c.ts", "mail@host.example")}
    report = {(r.category, r.value) for r in out["report"].collect()}
    assert {("emails", "mail@host.example"), ("urls", "https://api.example/v1/x"), ("variables", "apiUrl = https://api.example/v1/x"), ("github_tokens", TOKEN)} <= report
    assert [(r.rule, r.secret) for r in out["findings"].where("rule = 'github_personal_access_token'").collect()] == [("github_personal_access_token", TOKEN)]
    whole = json.loads(hunt.report_json(out["report"]))
    assert whole["total_findings"] == len(report) and "emails" in whole["categories"]
    hunt.write_report(out["report"], str(tmp_path / "r"))
    assert json.loads((tmp_path / "r").read_text()) == whole and list(whole["categories"]) == sorted(whole["categories"])
    hunt.write_report(out["report"].limit(0), str(tmp_path / "r"))
    assert json.loads((tmp_path / "r").read_text()) == {"total_findings": 0, "categories": {}}
    # a stage that is complete isn't made again; one that isn't is
    assert one.next_stage() is None
    (tmp_path / "h" / "report" / "_SUCCESS").unlink()
    assert one.next_stage() == "report"
    again = one.run(urls.limit(0), table.limit(0))
    assert {(r.category, r.value) for r in again["report"].collect()} == report


def test_command_line_of_the_chain(spark, tmp_path):
    pages = [("https://a/1.js", f"k = '{TOKEN}'\n// mail@host.example"), ("https://a/page", "x"), ("https://b/2.js", f"other('{TOKEN}')")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "urls.txt").write_text("https://a/1.js [200] [title]\nhttps://a/page [200]\nhttps://b/2.js\n\n")
    ask = lambda *more: hunt.main([str(tmp_path / "urls.txt"), "--pages", str(tmp_path / "pages"), "--no-entropy", "-f", "json", *more], spark)
    assert ask("-o", str(tmp_path / "one"), "--scope", "//a/", "--redact") == 1
    found = json.loads((tmp_path / "one" / "findings.json").read_text())
    assert [(r["file"], r["rule"]) for r in found if r["rule"] == "github_personal_access_token"] == [("1.js", "github_personal_access_token")] and TOKEN not in {r["secret"] for r in found}
    assert "emails" in json.loads((tmp_path / "one" / "report.json").read_text())["categories"]
    assert ask("-o", str(tmp_path / "two"), "--scope", "//a/page", "--all-files") == 0
    assert ask("-o", str(tmp_path / "one"), "--fail-on", "CRITICAL") == 1  # the stages are there already


def test_maps_beside_scripts(spark):
    files = spark.createDataFrame([("d/a.js", "x"), ("d/a.js.map", "{}"), ("d/b.js", "y"), ("d/bin", "\0zzz https://x.example/y")], "file string, text string")
    got = {(r.category, r.value, r.file) for r in hunt.deep_report(files).collect()}
    assert got == {("sourcemaps", "d/a.js.map", "d/a.js")}


def test_table_functions(spark):
    tables.register(spark)
    coded = base64.b64encode(f"say {TOKEN} now".encode()).decode()
    spark.createDataFrame([(1, f"x {TOKEN}", coded, '{"a": [{"b": "c"}], "n": 1}'), (2, None, None, "{")], "id int, line string, coded string, doc string").createOrReplaceTempView("t")
    assert [(r.id, r.secret, r.column) for r in spark.sql("SELECT t.id, f.* FROM t, LATERAL scan_line(t.line) f WHERE f.rule = 'github_personal_access_token'").collect()] == [(1, TOKEN, 3)]
    assert ("base64", "base64_github_personal_access_token", TOKEN) in {(r.tag, r.rule, r.secret) for r in spark.sql("SELECT f.* FROM t, LATERAL decode_rescan(t.coded) f").collect()}
    assert [tuple(r) for r in spark.sql("SELECT t.id, f.* FROM t, LATERAL json_walk(t.doc) f").collect()] == [(1, "a[0].b", "c")]


def test_content_types_and_ties(spark):
    pages = spark.createDataFrame([("https://a/1.js", "x", "text/javascript"), ("https://a/2.js", "y", "image/png"), ("https://a/3.js", "z", None), ("https://a/4.js", "w", "Application/JSON; charset=x")], "url string, html string, content_type string")
    got = {r.file for r in hunt.fetched_files(pages, hunt.HuntOptions(filter_content_type=True)).collect()}
    assert got == {"1.js", "3.js", "4.js"} and hunt.fetched_files(pages, hunt.HuntOptions()).count() == 4
    key = "ghp_" + "A" * 40
    found = spark.createDataFrame([("f", 1, "github_pat", key + x) for x in ("c", "a", "b")], "file string, line int, rule string, secret string")
    assert [r.secret for r in post.validatable(found).collect()] == [key + "a"]
