"""The registered queries over the driver's tables, and their SQL.

The tables hold few secrets, so some queries scan a seeded corpus: lines made from
the ids of `documents`, the same way here and in SQL.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import ScanOptions
from ..operators import cache, decode, post, recon, structured
from ..operators.match import match_rules, match_table
from ..sinks import reports
from ..sources import files as sources
from ..sources import lines as line_tables
from ..sources.shared import spread
from ..streaming import stream
from . import hunt
from . import sqltext as S
from .scan import finish, scan

#: Texts of tables are scanned whole, whatever their size; only files have the mode for large ones.
RULES_ONLY = ScanOptions(entropy=False, decode_base64=False, json=False, large_file_mode=False)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Tables with long texts, and what they are dealt out by where they are a single file.
_LONG = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table, _LONG[name]) if name in _LONG else table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_table(_table(spark, sf_dir, "documents"), "text", "doc_id", "doc:{}")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("file"), "text")


_DOCUMENTS = "docs AS (SELECT 'doc:' || doc_id AS file, text FROM documents)"
_PAGES = "docs AS (SELECT url AS file, html AS text FROM pages WHERE length(html) > 0)"
_TURNS = "docs AS (SELECT 'conv:' || conv_id || '-' || turn AS file, text || chr(10) || 'use ghp_' || left(sha256(conv_id || '-' || turn), 36) AS text FROM conversations)"
_TOLD = "docs AS (SELECT 'doc:' || doc_id AS file, text || chr(10) || 'token ' || to_base64(unhex(sha256(CAST(doc_id AS VARCHAR)))) AS text FROM documents)"
_LINKED = """docs AS (SELECT url AS file, html || chr(10) || 'fetch("/api/v1/item/' || page_id || '"); let u = "https://h' || (page_id % 7) || '.example/graphql";' AS text FROM pages WHERE length(html) > 0)"""

# ---------------------------------------------------------------- the seeded corpus


def _base64(text: Column) -> Column:
    """Base64 on one line; Spark's own breaks lines after 76 characters."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")


#: Carriers by doc_id modulo 8; h is the SHA-256 of the id in hex.
_CARRIERS = (
    ("AWS_ID = AKIA{U16} # and AKIA{U16}", "conf/app.env"),
    ('token: "ghp_{H36}"', "src/main.py"),
    ('api_key = "Zq{H38}"', "tests/case.py"),
    ("blob {B} end", "data/blob.txt"),
    ("hex {X} end", "data/hex.log"),
    ("see https://user:pw{H8}@host.example/path for example", "docs/readme.md"),
    ("url %67%68%70%5f{H36} end", "web/a.html"),
    ("nothing to see in line {H4}", "src/clean.py"),
)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, text): three lines for each document, the middle one with a carrier."""
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    token = F.concat(F.lit("key ghp_"), F.left(h, F.lit(36)), F.lit(" end of it"))
    values = {"{U16}": F.upper(F.left(h, F.lit(16))), "{H36}": F.left(h, F.lit(36)), "{H38}": F.left(h, F.lit(38)), "{H8}": F.left(h, F.lit(8)), "{H4}": F.left(h, F.lit(4)), "{B}": _base64(token), "{X}": F.lower(F.hex(token.cast("binary")))}
    text = file = F.lit(None).cast("string")
    for i, (carrier, path) in enumerate(_CARRIERS):
        filled: Column = F.lit(carrier)
        for mark, value in values.items():
            if mark in carrier:
                filled = F.replace(filled, F.lit(mark), value)
        on = F.col("doc_id") % len(_CARRIERS) == i
        text, file = F.when(on, filled).otherwise(text), F.when(on, F.lit(path)).otherwise(file)
    documents = _table(spark, sf_dir, "documents").select("doc_id")
    return documents.select("doc_id", F.concat(F.lit("repo/"), F.col("doc_id").cast("string"), F.lit("/"), file).alias("file"), F.concat(F.lit("# first line\n"), text, F.lit("\nlast line\n")).alias("text"))


def _seeded_sql() -> str:
    h = "sha256(CAST(doc_id AS VARCHAR))"
    token = f"('key ghp_' || left({h}, 36) || ' end of it')"
    values = {"{U16}": f"upper(left({h}, 16))", "{H36}": f"left({h}, 36)", "{H38}": f"left({h}, 38)", "{H8}": f"left({h}, 8)", "{H4}": f"left({h}, 4)", "{B}": f"to_base64(encode({token}))", "{X}": f"lower(hex({token}))"}
    text = file = ""
    for i, (carrier, path) in enumerate(_CARRIERS):
        filled = S.quoted(carrier)
        for mark, value in values.items():
            if mark in carrier:
                filled = f"replace({filled}, '{mark}', {value})"
        text += f" WHEN {i} THEN {filled}"
        file += f" WHEN {i} THEN '{path}'"
    n = len(_CARRIERS)
    return f"docs AS (SELECT doc_id, 'repo/' || doc_id || '/' || CASE doc_id % {n}{file} END AS file, '# first line' || chr(10) || CASE doc_id % {n}{text} END || chr(10) || 'last line' || chr(10) AS text FROM documents)"


_SEEDED = _seeded_sql()
_FOUND = f"lines AS ({S.lines('docs')}), hits AS ({S.hits('lines', 'line_text', RULES_ONLY)}), found AS ({S.once('hits')})"
_ROWS = f"file, line, rule, severity, secret, {S.entropy('secret')} AS entropy, col AS \"column\""


def _rows(findings: DataFrame) -> DataFrame:
    return findings.select("file", "line", "rule", "severity", "secret", "entropy", "column")


# ---------------------------------------------------------------- scans


@query(f"WITH {_SEEDED}, {_FOUND} SELECT rule, severity, count(*) AS n, count(DISTINCT file) AS files FROM found GROUP BY ALL")
def seeded_scan(spark, sf_dir):
    """Findings by rule in the seeded corpus."""
    return scan(seeded(spark, sf_dir).select("file", "text"), RULES_ONLY).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@query(f"WITH {_SEEDED}, {_FOUND} SELECT {_ROWS} FROM found WHERE {S.rank('severity')} <= 1")
def seeded_scan_severity_high(spark, sf_dir):
    """Findings of the rules that are HIGH at least; milder rules aren't tried."""
    return _rows(scan(seeded(spark, sf_dir).select("file", "text"), ScanOptions("HIGH", False, False, json=False)))


@query(f"WITH {_DOCUMENTS}, {_FOUND} SELECT {_ROWS} FROM found")
def rule_hits_documents(spark, sf_dir):
    return _rows(scan(_documents(spark, sf_dir), RULES_ONLY))


@query(f"WITH {_PAGES}, {_FOUND} SELECT {_ROWS} FROM found")
def rule_hits_pages(spark, sf_dir):
    return _rows(scan(sources.from_pages(_table(spark, sf_dir, "pages")), RULES_ONLY))


@query(f"WITH {_TURNS}, {_FOUND} SELECT {_ROWS} FROM found")
def rule_hits_conversations(spark, sf_dir):
    """Rules on all turns, each with one more line that holds a token."""
    key = F.sha2(F.substring_index("file", ":", -1).cast("binary"), 256)
    return _rows(scan(_turns(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nuse ghp_"), F.left(key, F.lit(36)))), RULES_ONLY))


_K = "left(sha256('c' || c_custkey), 8)"
_CREDENTIALS = f"""docs AS (SELECT 'doc:' || doc_id AS file, text || chr(10) || CASE doc_id % 5
    WHEN 0 THEN 'use tk' || k || '_' || left(s, 12) || ' or tk' || k || '_' || right(s, 12) WHEN 1 THEN 'X-' || upper(k) || '-KEY:  ' || upper(left(s, 16))
    WHEN 2 THEN 'post to https://' || k || '.example/hook/' || left(s, 9) || '.' WHEN 3 THEN 'id ' || k || ':' || (1000000 + doc_id) || ' end' ELSE 'tk' || k || '-' || s END AS text
  FROM (SELECT doc_id, text, left(sha256('c' || (1 + doc_id % 1500)), 8) AS k, sha256('s' || doc_id) AS s FROM documents))"""


def made_rules(customers: DataFrame) -> DataFrame:
    """Four rules a customer: (rule_ord, name, severity, pattern), for credentials that hold the customer's key."""
    k = F.left(F.sha2(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).cast("binary"), 256), F.lit(8))
    forms = (("token", "HIGH", r"\btk", r"_[0-9a-f]{12}\b"), ("header", "CRITICAL", "(?i)x-", r"-key:\s*[a-z0-9]{16}"), ("hook", "MEDIUM", "https://", r"\.example/hook/[A-Za-z0-9]+"), ("account", "LOW", r"\b", r":[0-9]{6,}\b"))
    each = [F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(s).alias("severity"), F.concat(F.lit(a), k, F.lit(b)).alias("pattern")) for i, (n, s, a, b) in enumerate(forms)]
    rows = customers.select("c_custkey", F.explode(F.array(*each)).alias("r"))
    return rows.select((F.col("c_custkey") * 4 + F.col("r.i")).cast("int").alias("rule_ord"), F.concat(F.col("r.n"), F.lit("_"), F.col("c_custkey").cast("string")).alias("name"), "r.severity", "r.pattern")


@query(rf"""WITH {_CREDENTIALS}, lines AS ({S.lines('docs')}), c AS (SELECT c_custkey, {_K} AS k FROM customer),
form AS (SELECT * FROM (VALUES ('token', 'HIGH', '\b(tk([0-9a-f]{{8}})_[0-9a-f]{{12}})\b', false), ('header', 'CRITICAL', '((?i:x-([0-9a-f]{{8}})-key:\s*[a-z0-9]{{16}}))', true),
  ('hook', 'MEDIUM', '(https://([0-9a-f]{{8}})\.example/hook/[A-Za-z0-9]+)', false), ('account', 'LOW', '\b(([0-9a-f]{{8}}):[0-9]{{6,}})\b', false)) AS t(n, severity, p, folded)),
hit AS (SELECT file, line, n, severity, folded, unnest(regexp_extract_all(line_text, p, 1)) AS secret, unnest(regexp_extract_all(line_text, p, 2)) AS k FROM lines, form)
SELECT file, line, n || '_' || c_custkey AS rule, severity, secret FROM hit JOIN c ON c.k = CASE WHEN folded THEN lower(hit.k) ELSE hit.k END""")
def rules_as_data(spark, sf_dir):
    """Some thousand rules made from the customers, on all lines of the documents, each of which has one more line."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    docs = _table(spark, sf_dir, "documents").withColumn("s", sha(F.concat(F.lit("s"), F.col("doc_id").cast("string")))).withColumn("k", F.left(sha(F.concat(F.lit("c"), (1 + F.col("doc_id") % 1500).cast("string"))), F.lit(8)))
    line = F.expr("""CASE doc_id % 5 WHEN 0 THEN 'use tk' || k || '_' || left(s, 12) || ' or tk' || k || '_' || right(s, 12) WHEN 1 THEN 'X-' || upper(k) || '-KEY:  ' || upper(left(s, 16))
        WHEN 2 THEN 'post to https://' || k || '.example/hook/' || left(s, 9) || '.' WHEN 3 THEN 'id ' || k || ':' || (1000000 + doc_id) || ' end' ELSE 'tk' || k || '-' || s END""")
    texts = sources.from_table(docs.select("doc_id", F.concat("text", F.lit("\n"), line).alias("text")), "text", "doc_id", "doc:{}")
    lines = texts.select("file", F.posexplode(X.split_lines(F.col("text"))).alias("at", "line_text")).select("file", (F.col("at") + 1).alias("line"), "line_text")
    rules = made_rules(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return match_table(lines, rules).select("file", "line", "rule", "severity", "secret")


@query(f"""WITH {_TOLD}, lines AS ({S.lines('docs')}),
ok AS (SELECT file FROM docs WHERE regexp_matches(text, {S.SECRET_CONTEXT})),
tokens AS (SELECT file, line, line_text, unnest(regexp_extract_all(line_text, {S.quoted(X.ENTROPY_TOKEN)})) AS secret FROM lines SEMI JOIN ok USING (file) WHERE regexp_matches(line_text, {S.SECRET_CONTEXT}))
SELECT DISTINCT file, line, secret, {S.entropy('secret')} AS entropy, CAST(strpos(line_text, secret) AS INTEGER) AS "column" FROM tokens
WHERE NOT regexp_matches(secret, {S.quoted(X.ENTROPY_EXCLUDE)}) AND {S.likely('secret', 32, 4.5)}""")
def entropy_sweep(spark, sf_dir):
    """High-entropy tokens on lines that speak of secrets; each document has one more line with a random string."""
    digest = F.unhex(F.sha2(F.substring_index("file", ":", -1).cast("binary"), 256))
    texts = _documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\ntoken "), F.base64(digest)))
    found = scan(texts, ScanOptions(decode_base64=False, json=False, large_file_mode=False, rules=()))
    return found.select("file", "line", "secret", "entropy", "column")


@query()
def full_scan(spark, sf_dir):
    """All stages on the seeded corpus, documents, pages and conversations, in the order of the command line."""
    options = ScanOptions(decode_hex=True, decode_unicode=True, js_reconstruct=True, endpoints=True, large_file_mode=False)
    return finish(scan(_texts(spark, sf_dir).unionByName(_turns(spark, sf_dir)), options), "cli")


@query(f"WITH {_DOCUMENTS}, lines AS ({S.lines('docs')}) SELECT file, line, length(line_text) AS size, md5(line_text) AS digest FROM lines")
def line_split(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("file", F.posexplode(X.split_lines(F.col("text"))).alias("at", "t"))
    return lines.select("file", (F.col("at") + 1).alias("line"), F.length("t").cast("long").alias("size"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(f"""WITH {_DOCUMENTS}, lines AS ({S.lines('docs')})
SELECT file, line, md5(array_to_string(parts[greatest(1, line-2):line-1], chr(10))) AS before, md5(array_to_string(parts[line+1:line+2], chr(10))) AS after FROM lines""")
def context_window(spark, sf_dir):
    """Up to two lines before and after each line, from the array of lines: no window, no shuffle."""
    lines = X.lines(_documents(spark, sf_dir))
    return lines.select("file", "line", F.md5(F.col("context_before").cast("binary")).alias("before"), F.md5(F.col("context_after").cast("binary")).alias("after"))


@query(f"""WITH {_DOCUMENTS}, lines AS ({S.lines('docs')}), n AS (SELECT file, line, line_text, row_number() OVER (PARTITION BY file ORDER BY line) AS place FROM lines)
SELECT file, CAST(place AS BIGINT) AS line, md5(line_text) AS digest, md5(concat_ws(chr(10), lag(line_text, 2) OVER w, lag(line_text) OVER w)) AS before, md5(concat_ws(chr(10), lead(line_text) OVER w, lead(line_text, 2) OVER w)) AS after
FROM n WINDOW w AS (PARTITION BY file ORDER BY place)""")
def line_table_context(spark, sf_dir):
    """Context for a table whose rows are lines in no order, as logs are: numbered in ranges without their texts, then halos between blocks."""
    rows = _documents(spark, sf_dir).select("file", F.posexplode(X.split_lines(F.col("text"))).alias("at", "line_text"))
    lines = line_tables.with_line_context(line_tables.with_numbers(rows, "file", ["at"]))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return lines.select("file", "line", digest("line_text").alias("digest"), digest("context_before").alias("before"), digest("context_after").alias("after"))


_IDS = "(SELECT doc_id, 'x AKIA' || upper(left(sha256(CAST(doc_id AS VARCHAR)), 16)) || ' é ghp_' || left(sha256(CAST(doc_id AS VARCHAR)), 36) || ' AKIA' || upper(right(sha256(CAST(doc_id AS VARCHAR)), 16)) AS line_text FROM documents)"


@query(f"WITH docs AS {_IDS}, hits AS ({S.hits('docs', 'line_text', RULES_ONLY, 'doc_id')}) SELECT doc_id, rule, secret, col AS \"column\" FROM hits WHERE rule IN ('aws_access_key_id', 'github_personal_access_token')")
def match_columns(spark, sf_dir):
    """Places of several matches on one line, in characters."""
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    text = F.concat(F.lit("x AKIA"), F.upper(F.left(h, F.lit(16))), F.lit(" é ghp_"), F.left(h, F.lit(36)), F.lit(" AKIA"), F.upper(F.right(h, F.lit(16))))
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.alias("line_text"))
    active = [(i, r) for i, r in RULES_ONLY.active() if r.name in ("aws_access_key_id", "github_personal_access_token")]
    return match_rules(rows, active).select("doc_id", "rule", "secret", "column")


@query(f"""WITH {_DOCUMENTS}, lines AS ({S.lines('docs')}), tokens AS (SELECT file, line, unnest(regexp_extract_all(line_text, '[A-Za-z0-9+/=_\\-]{{12,}}')) AS token FROM lines)
SELECT token, {S.entropy('token')} AS entropy, {S.likely('token', 12, 3.2)} AS likely, count(*) AS n FROM tokens GROUP BY ALL""")
def entropy_tokens(spark, sf_dir):
    """Entropy and likeness of long tokens."""
    lines = X.lines(_documents(spark, sf_dir))
    tokens = lines.select(F.explode(F.regexp_extract_all("line_text", F.lit(r"[A-Za-z0-9+/=_\-]{12,}"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", X.entropy(F.col("token")).alias("entropy"), X.likely_secret(F.col("token"), 12, 3.2).alias("likely"), "n")


# ---------------------------------------------------------------- after the scan


def _findings(spark, sf_dir):
    return scan(seeded(spark, sf_dir).select("file", "text"), RULES_ONLY)


_CONTEXT = f"left({S.strip('unit')}, 200)"
_FIRST = f"first AS (SELECT *, {_CONTEXT} AS context, count(*) OVER (PARTITION BY rule, secret) AS n FROM found QUALIFY row_number() OVER (PARTITION BY rule, secret ORDER BY {S.rank('severity')}, file, line, rule_ord, j) = 1)"


@query(f"WITH {_DOCUMENTS}, {_FOUND}, {_FIRST} SELECT file, line, rule, secret, CASE WHEN n > 1 THEN context || '  [also found in ' || (n - 1) || ' other file(s)]' ELSE context END AS context FROM first")
def dedup_findings(spark, sf_dir):
    """One finding for each rule and secret."""
    return post.deduplicate(scan(_documents(spark, sf_dir), RULES_ONLY)).select("file", "line", "rule", "secret", "context")


@query(f"WITH {_SEEDED}, {_FOUND} SELECT severity, rule, count(*) AS n, count(DISTINCT file) AS files FROM found GROUP BY GROUPING SETS ((severity), (rule), ())")
def summary_grouping_sets(spark, sf_dir):
    return post.summary(_findings(spark, sf_dir))


@query(f"WITH {_SEEDED}, {_FOUND} SELECT rule, count(*) AS n FROM found GROUP BY rule ORDER BY n DESC, rule LIMIT 10")
def top_rules(spark, sf_dir):
    return post.by_rule(_findings(spark, sf_dir)).orderBy(F.desc("n"), "rule").limit(10)


_MILDER = "CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' WHEN 'LOW' THEN 'INFO' ELSE severity END"
_OFF = f"list_has_any(string_split(file, '/'), [{', '.join(map(S.quoted, post.NON_PRODUCTION))}])"


@query(f"WITH {_SEEDED}, {_FOUND} SELECT file, line, rule, secret, CASE WHEN regexp_matches({_CONTEXT}, {S.quoted(post.PLACEHOLDER)}) THEN 'INFO' WHEN {_OFF} THEN {_MILDER} ELSE severity END AS severity FROM found")
def fp_downgrade(spark, sf_dir):
    return post.downgrade(_findings(spark, sf_dir)).select("file", "line", "rule", "secret", "severity")


@query(f"WITH {_SEEDED}, {_FOUND} SELECT file, rule, CASE WHEN length(secret) <= 8 THEN repeat('*', length(secret)) WHEN length(secret) <= 16 THEN left(secret, 2) || repeat('*', length(secret) - 4) || right(secret, 2) ELSE left(secret, 4) || repeat('*', length(secret) - 8) || right(secret, 4) END AS shown FROM found")
def redacted(spark, sf_dir):
    return _findings(spark, sf_dir).select("file", "rule", X.redact(F.col("secret")).alias("shown"))


_FP = "left(sha256(rule || ':' || left(secret, 60) || ':' || string_split(file, '/')[-1]), 16)"


@query(f"WITH {_SEEDED}, {_FOUND} SELECT file, rule, secret, {_FP} AS fingerprint FROM found")
def fingerprints(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return found.select("file", "rule", "secret", X.fingerprint(F.col("rule"), F.col("secret"), F.col("file")).alias("fingerprint"))


@query(f"WITH {_SEEDED}, {_FOUND}, f AS (SELECT file, line, rule, secret, {_FP} AS fp FROM found) SELECT file, line, rule, secret FROM f WHERE left(fp, 1) NOT IN ('0', '1', '2', '3')")
def ignore_antijoin(spark, sf_dir):
    """Findings that aren't on the ignore list, here the fingerprints that begin with 0 to 3."""
    found = _findings(spark, sf_dir)
    listed = found.select(X.fingerprint(F.col("rule"), F.col("secret"), F.col("file")).alias("fingerprint")).where(F.left("fingerprint", F.lit(1)) < "4")
    return post.suppress(found, listed).select("file", "line", "rule", "secret")


@query(f"WITH {_SEEDED}, {_FOUND} SELECT coalesce(bool_or({S.rank('severity')} <= 0), false) AS failed FROM found")
def exit_code(spark, sf_dir):
    return post.failing(_findings(spark, sf_dir), "CRITICAL")


@query(f"""WITH {_SEEDED}, {_FOUND} SELECT rule, secret, 'aws_sts' AS validator FROM found WHERE rule = 'aws_access_key_id' GROUP BY ALL""")
def validation_plan(spark, sf_dir):
    """What could be validated, once each; nothing is sent."""
    return post.validatable(_findings(spark, sf_dir))


@query(f"""WITH {_SEEDED}, {_FOUND}, f AS (SELECT rule, min((100 + {S.rank('severity')}) || file || chr(1) || (1000 + line) || chr(1) || (1000 + col) || chr(1) || secret) AS o FROM found GROUP BY rule),
l AS (SELECT DISTINCT rule, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END AS level FROM found)
SELECT rule, level, CAST(row_number() OVER (ORDER BY o, rule) - 1 AS INTEGER) AS rule_index FROM f JOIN l USING (rule)""")
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(_findings(spark, sf_dir))


_WHOLE = f"docs AS (SELECT 'doc:' || doc_id AS file, text FROM documents UNION ALL SELECT url, html FROM pages WHERE length(html) > 0 UNION ALL SELECT file, text FROM ({_TURNS.removeprefix('docs AS (').removesuffix(')')}))"
_SHOWN = "CASE WHEN length(secret) <= 8 THEN repeat('*', length(secret)) WHEN length(secret) <= 16 THEN left(secret, 2) || repeat('*', length(secret) - 4) || right(secret, 2) ELSE left(secret, 4) || repeat('*', length(secret) - 8) || right(secret, 4) END"
_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END"


def _whole_findings(spark, sf_dir):
    """Findings in whole documents, pages and conversations; each turn has one more line that holds a token."""
    key = F.sha2(F.substring_index("file", ":", -1).cast("binary"), 256)
    turns = _turns(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nuse ghp_"), F.left(key, F.lit(36))))
    texts = _documents(spark, sf_dir).unionByName(sources.from_pages(_table(spark, sf_dir, "pages"))).unionByName(turns)
    return scan(texts, RULES_ONLY)


@query(f"WITH {_WHOLE}, {_FOUND} SELECT file, line, rule, CASE WHEN regexp_matches({_CONTEXT}, {S.quoted(post.PLACEHOLDER)}) THEN 'INFO' WHEN {_OFF} THEN {_MILDER} ELSE severity END AS severity, {_SHOWN} AS shown, {_FP} AS fingerprint FROM found")
def reported_texts(spark, sf_dir):
    """What becomes of the findings of whole texts: severities, redacted secrets, fingerprints."""
    mark = X.fingerprint(F.col("rule"), F.col("secret"), F.col("file")).alias("fingerprint")
    return post.downgrade(_whole_findings(spark, sf_dir)).select("file", "line", "rule", "severity", X.redact(F.col("secret")).alias("shown"), mark)


@query(f"""WITH {_WHOLE}, {_FOUND}, f AS (SELECT rule, min((100 + {S.rank('severity')}) || file || chr(1) || (100000 + line) || chr(1) || (100000 + col) || chr(1) || secret) AS o FROM found GROUP BY rule),
r AS (SELECT rule, CAST(row_number() OVER (ORDER BY o, rule) - 1 AS INTEGER) AS rule_index FROM f)
SELECT rule, rule_index, {_LEVEL} AS level, file AS uri, CAST(line AS INTEGER) AS start_line, CAST(CASE WHEN col > 0 THEN col END AS INTEGER) AS start_column, {_CONTEXT} AS snippet, {_SHOWN} AS shown FROM found JOIN r USING (rule)""")
def sarif_results(spark, sf_dir):
    """The results of a SARIF report over whole texts, read back from their JSON."""
    made = reports.sarif_results(_whole_findings(spark, sf_dir))
    kind = """ruleId string, ruleIndex int, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>,
        region: struct<startLine: int, startColumn: int, snippet: struct<text: string>>>, properties: struct<secret: string>>>"""
    r = made.select(F.from_json("result", kind).alias("r")).select("r.*").withColumn("at", F.col("locations")[0])
    region = "at.physicalLocation.region"
    return r.select(
        F.col("ruleId").alias("rule"), F.col("ruleIndex").alias("rule_index"), "level", F.col("at.physicalLocation.artifactLocation.uri").alias("uri"), F.col(f"{region}.startLine").alias("start_line"),
        F.col(f"{region}.startColumn").alias("start_column"), F.col(f"{region}.snippet.text").alias("snippet"), F.col("at.properties.secret").alias("shown"),
    )


# ---------------------------------------------------------------- decoders

_ONE_RULE = [(i, r) for i, r in RULES_ONLY.active() if r.name == "github_personal_access_token"]
_GHP = S.quoted(_ONE_RULE[0][1].pattern)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of all seeded rows, documents and pages."""
    pages = sources.from_pages(_table(spark, sf_dir, "pages"))
    return seeded(spark, sf_dir).select("file", "text").unionByName(_documents(spark, sf_dir)).unionByName(pages)


_ALL = f"{_SEEDED.replace('docs AS', 'seeds AS', 1)}, docs AS (SELECT file, text FROM seeds UNION ALL SELECT 'doc:' || doc_id, text FROM documents UNION ALL SELECT url, html FROM pages WHERE length(html) > 0), lines AS ({S.lines('docs')})"
_RAW = "SELECT file, line, unnest(regexp_extract_all(line_text, '{}')) AS raw FROM lines WHERE regexp_matches(line_text, '{}')"


@query(f"""WITH {_ALL}, c AS ({_RAW.format('[A-Za-z0-9+/]{32,}=*', '[A-Za-z0-9+/]{32}')}),
whole AS (SELECT file, rtrim(raw, '=') AS core, length(raw) - length(rtrim(raw, '=')) AS marks FROM c),
d AS (SELECT file, TRY(decode(from_base64(core || CASE length(core) % 4 WHEN 2 THEN '==' WHEN 3 THEN '=' ELSE '' END))) AS decoded FROM whole WHERE length(core) % 4 <> 1 AND marks >= (4 - length(core) % 4) % 4)
SELECT file, decoded, unnest(regexp_extract_all(decoded, {_GHP})) AS secret FROM d""")
def base64_rescan(spark, sf_dir):
    """Tokens in Base64, in all seeded rows, documents and pages."""
    rows = X.lines(_texts(spark, sf_dir))
    return match_rules(decode.decode_base64(rows), _ONE_RULE, "decoded", check=False).select("file", "decoded", "secret")


@query(f"""WITH {_ALL}, c AS ({_RAW.format('[A-Za-z0-9_]+', '[0-9a-fA-F]{20}')}),
d AS (SELECT file, TRY(decode(unhex(raw))) AS decoded FROM c WHERE regexp_full_match(raw, '(?:[0-9a-fA-F]{{2}}){{10,}}') AND NOT (regexp_matches(raw, '[a-f]') AND regexp_matches(raw, '[A-F]')))
SELECT file, decoded, unnest(regexp_extract_all(decoded, {_GHP})) AS secret FROM d""")
def hex_rescan(spark, sf_dir):
    """Tokens in hexadecimal, in all seeded rows, documents and pages."""
    rows = X.lines(_texts(spark, sf_dir))
    return match_rules(decode.decode_hex(rows), _ONE_RULE, "decoded", check=False).select("file", "decoded", "secret")


_PERCENT = "regexp_extract_all(line_text, '%[0-9a-fA-F]{2}|[^%]+|%')"


@query(f"""WITH {_ALL}, d AS (SELECT file, line_text, array_to_string(list_transform({_PERCENT}, lambda x: CASE WHEN length(x) = 3 AND regexp_full_match(x, '%[0-9a-fA-F]{{2}}') THEN chr(CAST('0x' || x[2:3] AS INTEGER)) ELSE x END), '') AS decoded FROM lines WHERE contains(line_text, '%'))
SELECT file, decoded, unnest(regexp_extract_all(decoded, {_GHP})) AS secret FROM d WHERE decoded <> line_text""")
def url_rescan(spark, sf_dir):
    """Tokens in percent escapes, in all seeded rows, documents and pages."""
    rows = X.lines(_texts(spark, sf_dir))
    return match_rules(decode.decode_escapes(rows).where("tag = 'url'"), _ONE_RULE, "decoded", check=False).select("file", "decoded", "secret")


@query("SELECT doc_id, 'ghp_' || left(sha256(CAST(doc_id AS VARCHAR)), 36) AS secret FROM documents")
def unicode_rescan(spark, sf_dir):
    """Every character as a \\u escape."""
    token = F.concat(F.lit("ghp_"), F.left(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.lit(36)))
    escaped = F.array_join(F.transform(F.split(token, ""), lambda c: F.concat(F.lit("\\u00"), F.lower(F.hex(c.cast("binary"))))), "")
    rows = _table(spark, sf_dir, "documents").select("doc_id", escaped.alias("line_text"))
    return match_rules(decode.decode_escapes(rows), _ONE_RULE, "decoded", check=False).select("doc_id", "secret")


@query("SELECT doc_id, 'base64' AS tag, 'ghp_' || left(sha256(CAST(doc_id AS VARCHAR)), 36) AS secret FROM documents")
def recursive_rescan(spark, sf_dir):
    """A token in Base64 in Base64, found by the chain of decoders."""
    token = F.concat(F.lit("key ghp_"), F.left(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.lit(36)), F.lit(" end"))
    twice = _base64(F.concat(F.lit("x "), _base64(token), F.lit(" y")))
    rows = _table(spark, sf_dir, "documents").select("doc_id", twice.alias("line_text"))
    return match_rules(decode.decode_chain(rows), _ONE_RULE, "decoded", check=False).select("doc_id", "tag", "secret").distinct()


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def gzip_texts(spark, sf_dir):
    """Texts that were compressed under a long name, as gzip keeps it in its header, read again."""

    def pack(batches):
        for batch in batches:
            data = [named_gzip(x.encode(), f"archive-of-the-table-documents-column-text-row-{i}.txt") for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "content"])

    packed = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInArrow(pack, "doc_id long, content binary")
    return decode.decompress(packed).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, unnest(['base64', 'hex']) AS tag, unnest([md5(text), md5(text)]) AS digest FROM documents WHERE octet_length(encode(text)) >= 24")
def decoded_documents(spark, sf_dir):
    """Whole texts in Base64 and in hexadecimal, read again; shorter ones have too few characters for a candidate."""
    raw = F.col("text").cast("binary")
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("a "), _base64(F.col("text")), F.lit(" b")).alias("b"), F.lower(F.hex(raw)).alias("h"))
    both = decode.decode_base64(rows.select("doc_id", F.col("b").alias("line_text"))).unionByName(decode.decode_hex(rows.where("length(h) >= 48").select("doc_id", F.col("h").alias("line_text"))))
    return both.select("doc_id", "tag", F.md5(F.col("decoded").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE octet_length(encode(text)) >= 24")
def chained_documents(spark, sf_dir):
    """Whole texts in Base64 in Base64, read again by the chain of decoders."""
    twice = _base64(F.concat(F.lit("x "), _base64(F.col("text")), F.lit(" y")))
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), twice.alias("line_text"))
    out = decode.decode_chain(rows).select("doc_id", "digest", F.md5(F.col("decoded").cast("binary")).alias("made"))
    return out.where("made = digest").select("doc_id", "digest").distinct()


@query("SELECT doc_id, unnest(['a.text', 'a.list[1][0]']) AS key_path, unnest([md5(text), md5(text)]) AS digest FROM documents WHERE length(text) > 0")
def json_documents(spark, sf_dir):
    """Whole texts within JSON documents, with their key paths."""
    text = F.col("text")
    doc = F.to_json(F.struct(F.struct(text.alias("text"), F.array(F.array(F.lit("")), F.array(text)).alias("list")).alias("a"), F.lit(1).alias("n")))
    values = structured.json_values(_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", doc.alias("text")))
    return values.select("doc_id", "key_path", F.md5(F.col("value").cast("binary")).alias("digest"))


def named_gzip(data: bytes, name: str) -> bytes:
    with io.BytesIO() as out:
        with gzip.GzipFile(name, "wb", fileobj=out, mtime=0) as file:
            file.write(data)
        return out.getvalue()


# ---------------------------------------------------------------- structured content, recon


@query("SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_keys(spark, sf_dir):
    """Values of the events' JSON, by Catalyst."""
    return _table(spark, sf_dir, "events").select("event_id", F.lit("$.k").alias("path"), F.get_json_object("props", "$.k").alias("value")).where("value is not null")


@query(f"""WITH v AS (SELECT doc_id, 'Aa1-' || left(sha256(CAST(doc_id AS VARCHAR)), 20) AS x FROM documents), o AS (SELECT *, {S.named_secret('x')} AS ok FROM v)
SELECT doc_id, unnest(['db.password', 'list[0].api_key', 'plain']) AS key_path, unnest([x, x, x]) AS value, unnest([ok, ok, false]) AS named FROM o""")
def json_walk(spark, sf_dir):
    """Texts in nested JSON with their key paths, and whether the key names a secret and the value may be one."""
    x = F.concat(F.lit("Aa1-"), F.left(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.lit(20)))
    doc = F.to_json(F.struct(F.struct(x.alias("password")).alias("db"), F.array(F.struct(x.alias("api_key"))).alias("list"), x.alias("plain"), F.lit(7).alias("n")))
    values = structured.json_values(_table(spark, sf_dir, "documents").select("doc_id", doc.alias("text")))
    return values.select("doc_id", "key_path", "value", structured.secret_key(F.col("key_name"), F.col("value")).alias("named"))


@query("SELECT doc_id, 'reconstructed_concat' AS tag, 'ghp_' || left(sha256(CAST(doc_id AS VARCHAR)), 36) AS secret FROM documents UNION ALL SELECT doc_id, 'reconstructed_join', 'ghp_' || left(sha256(CAST(doc_id AS VARCHAR)), 36) FROM documents UNION ALL SELECT doc_id, 'reconstructed_template', 'ghp_' || left(sha256(CAST(doc_id AS VARCHAR)), 36) FROM documents")
def js_reconstruct(spark, sf_dir):
    """Tokens split over added strings, joined arrays and templates."""
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    a, b, c = (F.substring(h, i, 12) for i in (1, 13, 25))
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    line = F.concat(F.lit('x = "ghp_"+'), q(a), F.lit(" + "), q(F.concat(b, c)), F.lit('; y = ["ghp_",'), q(a), F.lit(","), q(b), F.lit(","), q(c), F.lit("].join('');z=`ghp_"), a, b, c, F.lit("`"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", line.alias("line_text"))
    return match_rules(structured.rebuild_strings(rows), _ONE_RULE, "decoded", check=False).select("doc_id", "tag", "secret")


_E = " UNION ALL ".join(f"SELECT file, line, {i} AS p, j, e[j] AS endpoint FROM (SELECT file, line, regexp_extract_all(line_text, {S.quoted(p)}, 1) AS e FROM lines), unnest(range(1, len(e) + 1)) AS t(j)" for i, p in enumerate(structured.ENDPOINTS))


@query(f"WITH {_LINKED}, lines AS ({S.lines('docs')}), e AS ({_E}) SELECT file, min(line) AS line, endpoint FROM e WHERE length(endpoint) >= 5 AND NOT regexp_matches(endpoint, {S.quoted(structured.STATIC_ASSET)}) GROUP BY file, endpoint")
def endpoints(spark, sf_dir):
    """Endpoints that pages quote, at the first line; each page has one more line with two."""
    i = F.col("page_id")
    more = F.concat(F.lit('\nfetch("/api/v1/item/'), i.cast("string"), F.lit('"); let u = "https://h'), (i % 7).cast("string"), F.lit('.example/graphql";'))
    pages = _table(spark, sf_dir, "pages").where("length(html) > 0").withColumn("html", F.concat("html", more))
    return structured.endpoints(X.lines(sources.from_pages(pages))).select("file", "line", "endpoint")


@query(f"WITH s AS (SELECT page_id, regexp_extract_all(html, {S.quoted(structured.SCRIPT)}, 2) AS b FROM pages) SELECT page_id, CAST(i AS INTEGER) AS script_no, b[i] AS script FROM s, unnest(range(1, len(b) + 1)) AS t(i) WHERE trim(b[i]) <> ''")
def html_scripts(spark, sf_dir):
    return structured.scripts(_table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""WITH d AS (SELECT doc_id, 'var a=1;' || chr(10) || '//# sourceMappingURL=data:application/json;base64,' || to_base64(encode('{"sources":["a' || doc_id || '.ts","b.ts"],"sourcesContent":["let x=' || doc_id || '",""]}')) AS text FROM documents)
SELECT doc_id, 'a' || doc_id || '.ts' AS source_name, 'let x=' || doc_id AS source_text FROM d""")
def source_maps(spark, sf_dir):
    """Original sources carried by inline source maps."""
    i = F.col("doc_id").cast("string")
    inner = F.concat(F.lit('{"sources":["a'), i, F.lit('.ts","b.ts"],"sourcesContent":["let x='), i, F.lit('",""]}'))
    text = F.concat(F.lit("var a=1;\n//# sourceMappingURL=data:application/json;base64,"), _base64(inner))
    refs = structured.source_map_refs(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    maps = refs.select("doc_id", structured.inline_source_map(F.col("source_map")).alias("source_map_text"))
    return structured.source_files(maps).select("doc_id", "source_name", "source_text")


def _recon_sql(table: str) -> str:
    parts = [f"SELECT file, '{c}' AS category, unnest(list_transform(regexp_extract_all(text, {S.quoted(p)}), lambda v: trim(v))) AS value FROM {table}" for c, (_, p) in recon.CATEGORIES.items()]
    assets = " AND ".join(f"NOT contains(value, '{a}')" for a in recon.ASSETS)
    special = [
        f"SELECT file, 'js_endpoints' AS category, value FROM (SELECT file, unnest(regexp_extract_all(text, {S.quoted(recon.QUOTED_PATH)}, 1)) AS value FROM {table}) WHERE length(value) > 4 AND {assets}",
        f"SELECT file, 'js_variables' AS category, a || ' = ' || b AS value FROM (SELECT file, unnest(regexp_extract_all(text, {S.quoted(recon.VARIABLE)}, 1)) AS a, unnest(regexp_extract_all(text, {S.quoted(recon.VARIABLE)}, 2)) AS b FROM {table})",
        f"SELECT file, 'js_routes' AS category, trim(unnest(regexp_extract_all(text, {S.quoted(recon.ROUTE)})), chr(39) || '\"') AS value FROM {table}",
        f"SELECT file, 'js_urls' AS category, unnest(regexp_extract_all(text, {S.quoted(recon.URL)}, 1)) AS value FROM {table}",
    ]
    return f"SELECT category, value, min(file) AS file FROM (SELECT file, category, value FROM ({' UNION ALL '.join(parts)}) WHERE length(value) >= 4 UNION ALL {' UNION ALL '.join(special)}) GROUP BY category, value"


@query(f"WITH {_PAGES} {_recon_sql('docs')}")
def recon_pages(spark, sf_dir):
    """What pages give away, by category, each value once."""
    return recon.extract(sources.from_pages(_table(spark, sf_dir, "pages"))).select("category", "value", "file")


@query(f"WITH {_DOCUMENTS}, r AS ({_recon_sql('docs')}) SELECT category, count(*) AS n FROM r GROUP BY category")
def recon_totals(spark, sf_dir):
    return recon.totals(recon.extract(_documents(spark, sf_dir))).select("category", "n")


@query(f"WITH u AS (SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '^https?://')) SELECT url FROM u WHERE regexp_matches(url, 'example\\.com')")
def url_scope(spark, sf_dir):
    """URLs within a scope, merged from two lists, sorted."""
    urls = _table(spark, sf_dir, "pages").select("url").where(F.regexp_like("url", F.lit("^https?://")))
    return sources.merged_urls(urls, urls).where(F.regexp_like("url", F.lit(r"example\.com")))


_NAME = "regexp_replace(string_split(string_split(url, '?')[1], '/')[-1], '[^\\p{L}\\p{N}._-]', '', 'g')"


@query(f"SELECT page_id, CASE WHEN {_NAME} = '' THEN 'index.html' ELSE left({_NAME}, 80) END AS name FROM pages")
def fetched_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", sources.fetched_name(F.col("url")).alias("name"))


@query(f"""WITH n AS (SELECT page_id, url, CASE WHEN {_NAME} = '' THEN 'index.html' ELSE left({_NAME}, 80) END AS name FROM pages),
k AS (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY url NULLS FIRST, page_id) - 1 AS k, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext FROM n)
SELECT page_id, CASE WHEN k = 0 THEN name ELSE left(name, length(name) - length(ext)) || '_' || k || ext END AS name FROM k""")
def colliding_names(spark, sf_dir):
    """File names of pages, numbered where they collide."""
    return hunt.collision_names(_table(spark, sf_dir, "pages").select("page_id", "url"), sources.fetched_name(F.col("url")), ["url", "page_id"]).select("page_id", "name")


@query(f"WITH {_PAGES}, {_FOUND} SELECT rule, secret, file, line FROM found QUALIFY row_number() OVER (PARTITION BY rule, left(secret, 60) ORDER BY file, line, rule_ord, j) = 1")
def stream_findings(spark, sf_dir):
    """Findings in fetched pages, once for each rule and start of the secret."""
    return hunt.stream_findings(sources.from_pages(_table(spark, sf_dir, "pages")), RULES_ONLY).select("rule", "secret", "file", "line")


@query("SELECT page_id, string_split(trim(regexp_replace(url || ' [200] [A title]', '\\s+', ' ', 'g')), ' ')[1] AS url FROM pages WHERE length(trim(url)) > 0")
def live_urls(spark, sf_dir):
    """URLs of a prober's lines, made from all pages' URLs with status and title."""
    lines = _table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" [200] [A title]")).alias("value"))
    return hunt.live_urls(lines, keep=["page_id"]).select("page_id", "url")


@query()
def hunt_report(spark, sf_dir):
    """The whole chain over all pages: candidates, script URLs, files, inline scripts, source maps, and the report."""
    from ..sources.shared import shared_folder

    pages = _table(spark, sf_dir, "pages")
    chain = hunt.Hunt(spark, f"{shared_folder(spark)}/hunt-{uuid.uuid4().hex}", hunt.HuntOptions(scripts_only=False, most=None, depth=1, scan=RULES_ONLY))
    return chain.run(pages.select("url", F.col("page_id").alias("position")), pages.select("url", "html"))["report"]


@query("WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT doc_id, digest, doc_id = min(doc_id) OVER (PARTITION BY digest) AS keep, count(*) OVER (PARTITION BY digest) AS copies FROM d")
def exact_dup_documents(spark, sf_dir):
    found = post.exact_duplicates(_table(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select("doc_id", "digest", "keep", "copies")


# ---------------------------------------------------------------- caches, streams


@query("SELECT DISTINCT sha256(url) AS url_hash, url FROM pages WHERE page_id % 3 <> 0 AND sha256(url) NOT IN (SELECT sha256(url) FROM pages WHERE page_id % 3 = 0)")
def url_cache_missing(spark, sf_dir):
    """URLs that must be fetched, as no live entry holds them."""
    pages = _table(spark, sf_dir, "pages")
    cached = pages.where("page_id % 3 = 0").select(cache.url_hash("url").alias("url_hash"), "url", F.lit(1000.0).alias("timestamp"))
    return cache.missing_urls(pages.select("url").distinct(), cached, 1000.0).select(cache.url_hash("url").alias("url_hash"), "url")


@query(f"WITH {_SEEDED}, {_FOUND} SELECT rule, count(*) AS n FROM found GROUP BY rule")
def cached_scan(spark, sf_dir):
    """The second of two scans through the result cache: all contents are known by then."""
    from ..sources.shared import shared_folder

    texts = seeded(spark, sf_dir).select("file", "text")
    store = cache.ResultCache(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    cache.scan_cached(texts, store, RULES_ONLY, now=1000.0)
    return cache.scan_cached(texts, store, RULES_ONLY, now=2000.0).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT doc_id, 'Aa1-' || left(sha256(CAST(doc_id AS VARCHAR)), 20) AS secret FROM documents)
SELECT unnest(['j/' || doc_id || '.json', 'k/' || doc_id || '.json']) AS file, 'json_password' AS rule, secret FROM v WHERE {S.named_secret('secret')}""")
def cached_names(spark, sf_dir):
    """Equal contents under several names, after a first scan of other names: what depends on the name isn't taken from the cache."""
    from ..sources.shared import shared_folder

    value = F.concat(F.lit("Aa1-"), F.left(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.lit(20)))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(value.alias("password"))).alias("text"))
    named = lambda *names: rows.select(F.explode(F.array(*[F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)) for a, b in names])).alias("file"), "text")
    store, options = cache.ResultCache(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"), ScanOptions(entropy=False, decode_base64=False, rules=())
    cache.scan_cached(named(("j/", ".txt")), store, options, now=1000.0)
    return cache.scan_cached(named(("j/", ".txt"), ("j/", ".json"), ("k/", ".json")), store, options, now=2000.0).select("file", "rule", "secret")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return stream.tumbling(_table(spark, sf_dir, "events"))


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def sliding_window(spark, sf_dir):
    return stream.sliding(_table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    return stream.sessions(_table(spark, sf_dir, "events"))


@query("SELECT sha256(text) AS content_hash FROM documents GROUP BY ALL")
def unseen_contents(spark, sf_dir):
    """Contents of documents, each once, as the stream's cache has it."""
    texts = _table(spark, sf_dir, "documents").select("text", F.to_timestamp(F.lit("2024-01-01")).alias("ts"))
    return stream.unseen(texts).select("content_hash")
