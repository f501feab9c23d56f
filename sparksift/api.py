"""Surfaces: a Python API, JSON-RPC and REST request handlers, and a command line."""

from __future__ import annotations

import argparse
import hmac
import json
import os
import sys
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .model import COLUMNS, Rule, ScanOptions, as_options, builtin_rules, parse_size, rank
from .operators import post
from .operators.cache import ResultCache, scan_cached
from .plans.scan import finish, scan, scan_large
from .sinks import reports
from .sinks.registry import PAGE, ScanRegistry
from .sources import files as sources
from .sources.shared import shared_folder, staged

#: transport(validator, secret) -> (valid, detail)
Transport = Callable[[str, str], tuple[bool, str]]
#: Where settings are looked for; later ones win, and --config wins over all.
CONFIG_PATHS = ("~/.config/sparksift/config.json", "~/.sparksiftrc", ".sparksiftrc", ".sparksiftrc.json")
IGNORE_FILE = ".sparksiftignore"
#: What REST and JSON-RPC tell of a finding.
REST_COLUMNS = ("file", "line", "rule", "severity", "secret", "context", "entropy")


@dataclass
class Summary:
    total: int = 0
    by_severity: dict[str, int] = field(default_factory=dict)
    by_rule: dict[str, int] = field(default_factory=dict)
    files_hit: int = 0


@dataclass
class ScanResult:
    findings: DataFrame
    summary: Summary
    duration: float = 0.0
    files_scanned: int = 0


def summarise(findings: DataFrame) -> Summary:
    """Counts by one pass of grouping sets."""
    out = Summary()
    for row in post.summary(findings).collect():
        if row["severity"] is not None:
            out.by_severity[row["severity"]] = row["n"]
        elif row["rule"] is not None:
            out.by_rule[row["rule"]] = row["n"]
        else:
            out.total, out.files_hit = row["n"], row["files"]
    return out


class Scanner:
    """Scans tables, files, strings, pages and git history with one set of options."""

    def __init__(self, spark: SparkSession, options: ScanOptions | None = None, cache: ResultCache | None = None):
        ship(spark)
        self.spark, self.options, self.cache = spark, options or ScanOptions(), cache

    def scan_table(self, texts: DataFrame, mode: str = "sdk", ignored: DataFrame | None = None) -> DataFrame:
        """Findings of a table (file, text)."""
        found = scan_cached(texts, self.cache, self.options) if self.cache else scan(texts, self.options)
        return finish(found, mode, ignored)

    def scan_paths(self, paths: list[str], mode: str = "sdk", exclude: list[str] | None = None, max_bytes: int = sources.LARGEST_FILE, skip_binary: bool = True, ignored: DataFrame | None = None, git: bool = False, follow_symlinks: bool = False) -> ScanResult:
        began = time.time()
        tables = [sources.read_files(self.spark, p, exclude, min(max_bytes, sources.LINES_FROM), skip_binary, follow_symlinks) for p in paths]
        large = [f for p in paths for f in sources.large_files(self.spark, p, exclude, max_bytes, skip_binary, follow_symlinks)]
        texts = tables[0]
        for t in tables[1:]:
            texts = texts.unionByName(t)
        found = scan_cached(texts, self.cache, self.options) if self.cache else scan(texts, self.options)
        if large:
            found = found.unionByName(scan_large(self.spark, large, self.options).select(found.columns))
        if git:
            for p in paths:
                found = found.unionByName(sources.git_findings(sources.git_history(self.spark, p), self.options).select(found.columns))
        done = finish(found, mode, ignored)
        return ScanResult(done, summarise(done), time.time() - began, len(paths))

    def scan_string(self, content: str, source: str = "<stdin>", mode: str = "pipe") -> DataFrame:
        options = replace(self.options, content_gate=False, large_file_mode=False)
        texts = self.spark.createDataFrame([(source, content)], "file string, text string").where("text <> ''")
        return finish(scan(texts, options), mode)

    def scan_file(self, path: str) -> DataFrame:
        """Findings of one file, as they come: no duplicates dropped between lines, nothing downgraded."""
        return finish(scan(sources.read_files(self.spark, path, skip_binary=False), self.options), "raw")

    def scan_url(self, url: str, fetch: Callable[[str], bytes | None]) -> DataFrame:
        """Findings of what fetch(url) gives, under the URL's safe name; none if it gives nothing."""
        body = fetch(url)
        pages = self.spark.createDataFrame([(url, bytearray(body or b""))], "url string, body binary")
        texts = pages.select(sources.fetched_name(F.col("url")).alias("file"), F.make_valid_utf8(F.col("body").cast("string")).alias("text")).where("text <> ''")
        return finish(scan(texts, self.options), "raw")

    def validate(self, findings: DataFrame, transport: Transport | None = None) -> dict[tuple[str, str], dict]:
        """Results by rule and start of the secret; without a transport nothing is sent."""
        return {(v["rule"], v["secret"][:40]): v for v in post.validate(findings, transport)}

    def scan_pages(self, pages: DataFrame, mode: str = "sdk") -> DataFrame:
        return self.scan_table(sources.from_pages(pages), mode)

    def list_rules(self) -> list[dict]:
        return [{"name": r.name, "severity": r.severity, "pattern": r.pattern} for r in self.options.rules]

    def rules_table(self) -> DataFrame:
        rows = [(i, r.name, r.severity, r.rank, r.pattern) for i, r in enumerate(self.options.rules)]
        return self.spark.createDataFrame(rows, "rule_ord int, name string, severity string, rank int, pattern string")


# ---------------------------------------------------------------- JSON-RPC and REST

PARSE_ERROR, INVALID_REQUEST, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32600, -32601, -32602, -1


def _error(code: int, message: str, request_id: object = None) -> dict:
    return {"jsonrpc": "2.0", "error": {"code": code, "message": message}, "id": request_id}


def _listed(findings: DataFrame, redact: bool) -> list[dict]:
    return [{k: r[k] for k in REST_COLUMNS} for r in reports.shown(findings, redact).toLocalIterator()]


def _scanned(spark: SparkSession, params: dict) -> ScanResult:
    names = {"high_entropy_scan": "entropy", "severity": "min_severity"}
    options = ScanOptions(**as_options({names.get(k, k): v for k, v in params.items() if k not in ("paths", "rules")}))
    return Scanner(spark, options).scan_paths(params["paths"])


def _run_scan(spark: SparkSession, params: dict) -> dict:
    result = _scanned(spark, params)
    return {"summary": result.summary.__dict__, "duration": round(result.duration, 2), "findings": _listed(result.findings, params.get("redact", False))}


def handle_rpc(spark: SparkSession, line: str, transport=None) -> dict:
    """Answer to one line of JSON-RPC: health, list_rules, scan, validate."""
    try:
        request = json.loads(line)
    except ValueError as e:
        return _error(PARSE_ERROR, f"Parse error: {e}")
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0":
        return _error(INVALID_REQUEST, "Invalid Request")
    method, params, request_id = request.get("method", ""), request.get("params", {}), request.get("id")
    try:
        if method == "health":
            result: dict = {"status": "ok", "tool": reports.TOOL}
        elif method == "list_rules":
            rules = [{"name": r.name, "severity": r.severity, "pattern": r.pattern} for r in builtin_rules()]
            result = {"rules": rules, "total": len(rules)}
        elif method == "scan":
            if not params.get("paths"):
                return _error(BAD_PARAMS, "No paths provided", request_id)
            result = _run_scan(spark, params)
        elif method == "validate":
            rows = [tuple(f.get(c) for c in ("file", "line", "rule", "secret")) for f in params.get("findings", [])]
            found = post.validate(spark.createDataFrame(rows, "file string, line int, rule string, secret string"), transport)
            result = {"validations": {f"{v['rule']}:{v['secret'][:40]}": v for v in found}}
        else:
            return _error(NO_METHOD, f"Method not found: {method}", request_id)
    except Exception as e:  # noqa: BLE001 - the answer carries it
        return _error(FAILED, str(e), request_id)
    return {"jsonrpc": "2.0", "result": result, "id": request_id}


class RestService:
    """POST /scan, GET /scan/<id>?after=&size=, /rules and /health, with an optional bearer token.

    Results are tables of a registry and live for its time; only ids and the page that is asked for come here."""

    def __init__(self, spark: SparkSession, token: str | None = None, seconds: float = 3600.0, registry: ScanRegistry | None = None):
        self.spark, self.token = spark, token
        self.registry = registry or ScanRegistry(spark, f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}", seconds)

    def _page(self, key: str, now: float, after: int = 0, size: int = PAGE) -> dict | None:
        rows = self.registry.page(key, now, after, size)
        if rows is None:
            return None
        for f in rows:
            f["secret"] = f"{f['secret'][:4]}...{f['secret'][-4:]}"
        return {"findings": [{k: f[k] for k in ("place", *REST_COLUMNS)} for f in rows], "next": rows[-1]["place"] if len(rows) == size else None}

    def handle(self, method: str, path: str, body: str = "", authorization: str | None = None, now: float | None = None) -> tuple[int, dict]:
        now = time.time() if now is None else now
        path, _, query = path.partition("?")
        if path == "/health" and method == "GET":
            return 200, {"status": "ok"}
        if self.token and not hmac.compare_digest(authorization or "", f"Bearer {self.token}"):
            return 401, {"error": "unauthorized"}
        if path == "/rules" and method == "GET":
            return 200, {"rules": [{"name": r.name, "severity": r.severity, "pattern": r.pattern} for r in builtin_rules()]}
        if path == "/scan" and method == "POST":
            try:
                params = json.loads(body or "{}")
            except ValueError:
                return 400, {"error": "invalid JSON"}
            if not params.get("paths"):
                return 400, {"error": "no paths provided"}
            result = _scanned(self.spark, params)
            key = self.registry.put(result.findings, now)
            return 200, {"scan_id": key, "summary": result.summary.__dict__, "duration": round(result.duration, 2), **self._page(key, now)}
        if path.startswith("/scan/") and method == "GET":
            asked = {k: v[-1] for k, v in urllib.parse.parse_qs(query).items()}
            try:
                after, size = int(asked.get("after", 0)), int(asked.get("size", PAGE))
            except ValueError:
                return 400, {"error": "after and size are numbers"}
            page = self._page(path.removeprefix("/scan/"), now, max(0, after), min(max(1, size), PAGE))
            return (200, page) if page is not None else (404, {"error": "not found"})
        return 404, {"error": "not found"}


def serve(service: RestService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of the service; its serve_forever() answers."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            code, result = service.handle(self.command, self.path, body, self.headers.get("Authorization"))
            data = json.dumps(result).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *args) -> None:
            """Requests aren't logged: paths may be secret."""

    return ThreadingHTTPServer((host, port), Handler)


def rpc_loop(spark: SparkSession, lines: Iterable[str], out: TextIO) -> None:
    """Answer a JSON-RPC request a line, until the lines end."""
    for line in lines:
        if line.strip():
            out.write(json.dumps(handle_rpc(spark, line)) + "\n")
            out.flush()


# ---------------------------------------------------------------- command line


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparksift", description="Find exposed secrets in files.")
    p.add_argument("paths", nargs="*")
    p.add_argument("--severity", default="LOW")
    p.add_argument("--format", choices=sorted(reports.PIECES), default="text")
    p.add_argument("-o", "--output")
    p.add_argument("--show-secrets", action="store_true", help="show secrets in full")
    p.add_argument("--no-entropy", action="store_true")
    p.add_argument("--decode-base64", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--decode-hex", action=argparse.BooleanOptionalAction, default=False)
    for name in ("decode-gzip", "decode-unicode", "js-reconstruct", "endpoints", "no-skip-binary", "no-dedup", "git-history", "pipe", "list-rules", "rules-only", "follow-symlinks", "no-cache", "validate", "redact"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--webhook-url", action="append", default=[], help="send a message to this URL; repeatable")
    p.add_argument("--webhook-format", choices=sorted(reports.MESSAGES), default="json")
    for name in ("exclude-file", "rules", "config", "ignore-file", "cache-dir", "fail-on", "add-ignore"):
        p.add_argument(f"--{name}")
    p.add_argument("--serve", type=int, metavar="PORT", help="answer REST requests at this port of this machine")
    p.add_argument("--rpc", action="store_true", help="answer JSON-RPC requests, one a line, from standard input")
    p.add_argument("--max-file-size", default=sources.LARGEST_FILE, type=parse_size)
    return p


def settings(spark: SparkSession, explicit: str | None) -> dict:
    """Settings of all configuration files that can be read, by option name; broken ones are left out."""
    found: dict = {}
    for path in CONFIG_PATHS:
        try:
            with open(os.path.expanduser(path), encoding="utf-8") as file:
                own = json.load(file)
        except (OSError, ValueError):
            continue
        found |= own if isinstance(own, dict) else {}
    if explicit:
        own = json.loads("\n".join(r["value"] for r in spark.read.text(explicit).collect()))
        found |= own if isinstance(own, dict) else {}
    return found


def post_json(url: str) -> Callable[[dict], bool]:
    """A transport of messages to a URL that the caller named."""
    import urllib.request

    def send(message: dict) -> bool:
        request = urllib.request.Request(url, json.dumps(message).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=20) as answer:
            return 200 <= answer.status < 300

    return send


def main(argv: list[str] | None = None, spark: SparkSession | None = None, transport: Transport | None = None, sender: Callable[[str], Callable[[dict], bool]] = post_json) -> int:
    """0 clean, 1 findings (or findings at fail-on and worse), 2 wrong arguments.

    transport validates secrets where --validate asks for it; sender makes what sends messages to a URL."""
    arguments = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparksift").getOrCreate()
    if arguments.rpc:
        rpc_loop(spark, sys.stdin, sys.stdout)
        return 0
    if arguments.serve is not None:
        serve(RestService(spark, os.environ.get("SPARKSIFT_TOKEN")), port=arguments.serve).serve_forever()
        return 0
    stored = as_options(settings(spark, arguments.config), vars(arguments))
    if stored:
        arguments = parser().parse_args(argv, argparse.Namespace(**{**vars(parser().parse_args([])), **stored}))
    if arguments.add_ignore:
        with open(arguments.ignore_file or IGNORE_FILE, "a", encoding="utf-8") as out:
            out.write(arguments.add_ignore.strip() + "\n")
        return 0
    rules: list[Rule] = [] if arguments.rules_only else list(builtin_rules())
    if arguments.rules:
        rules += sources.rules_file(spark, arguments.rules)
    if rank(arguments.severity.upper()) > 4 or not (arguments.paths or arguments.pipe or arguments.list_rules):
        print("nothing to scan, or no such severity", file=sys.stderr)
        return 2
    options = ScanOptions(arguments.severity.upper(), not arguments.no_entropy, arguments.decode_base64, arguments.decode_hex, arguments.decode_gzip, arguments.decode_unicode, arguments.js_reconstruct, arguments.endpoints, rules=tuple(rules))
    scanner = Scanner(spark, options, ResultCache(spark, arguments.cache_dir) if arguments.cache_dir and not arguments.no_cache else None)
    if arguments.list_rules:
        print("\n".join(f"{r['severity']:<9} {r['name']}" for r in scanner.list_rules()))
        return 0
    listed = arguments.ignore_file or ("file://" + os.path.abspath(IGNORE_FILE) if os.path.exists(IGNORE_FILE) else None)
    ignored = sources.ignore_list(spark, listed) if listed else None
    if arguments.pipe:
        found = scanner.scan_string(sys.stdin.read())
        found = post.suppress(found, ignored) if ignored is not None else found
    else:
        mode = "all" if arguments.no_dedup else "cli"
        exclude = [*arguments.exclude, *(sources.exclude_list(spark, arguments.exclude_file) if arguments.exclude_file else [])]
        found = scanner.scan_paths(arguments.paths, mode, exclude, arguments.max_file_size, not arguments.no_skip_binary, ignored, arguments.git_history, arguments.follow_symlinks).findings
    found, redact = staged(found.select(COLUMNS)), arguments.redact or not arguments.show_secrets
    ordered = post.ordered(found)
    if arguments.output:
        reports.write_report(ordered, arguments.format, arguments.output, redact)
    else:
        sys.stdout.writelines(reports.PIECES[arguments.format](ordered, redact))
    if arguments.validate:
        for (rule, _), result in scanner.validate(found, transport).items():
            print(f"{rule}: {'valid' if result['valid'] else 'not valid'} ({result['detail']})", file=sys.stderr)
    if arguments.webhook_url:
        message = reports.MESSAGES[arguments.webhook_format](ordered, redact)
        for url in arguments.webhook_url:
            if not reports.send(message, sender(url)):
                print(f"no message could be sent to {url}", file=sys.stderr)
    return int(post.failing(found, arguments.fail_on.upper() if arguments.fail_on else None).first()["failed"])


if __name__ == "__main__":
    sys.exit(main())
