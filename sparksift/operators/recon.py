"""Reconnaissance: what whole texts give away, by category."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .match import all_marks, fold, surest

# Categories, descriptions and patterns must be as they are for right results.
CATEGORIES = {
    "aws_keys": ("AWS Access Key IDs", r"(AKIA[0-9A-Z]{16}|ABIA[0-9A-Z]{16}|ACCA[0-9A-Z]{16}|ASIA[0-9A-Z]{16})"),
    "google_api_keys": ("Google API Keys", r"AIza[0-9A-Za-z\-_]{35}"),
    "google_recaptcha": ("Google reCAPTCHA Keys", r"6L[0-9A-Za-z\-_]{38}"),
    "firebase_urls": ("Firebase URLs", r"https://[a-zA-Z0-9-]+\.(?:firebaseio\.com|firebase\.com)"),
    "s3_buckets": ("S3 Buckets", r"[a-zA-Z0-9.\-]+\.s3\.amazonaws\.com|s3://[a-zA-Z0-9.\-]+|s3-[a-zA-Z0-9\-]+\.amazonaws\.com/[a-zA-Z0-9.\-]+"),
    "internal_ips": ("Internal IPs", r"(?:10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3})"),
    "slack_webhooks": ("Slack Webhooks", r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+"),
    "github_tokens": ("GitHub Tokens", r"(ghp_[a-zA-Z0-9]{36}|gho_[a-zA-Z0-9]{36}|ghu_[a-zA-Z0-9]{36}|ghs_[a-zA-Z0-9]{36}|ghr_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59})"),
    "private_keys": ("Private Keys", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    "emails": ("Email Addresses", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "graphql_endpoints": ("GraphQL Endpoints", r"/[a-zA-Z0-9/_-]*graphql[a-zA-Z0-9/_-]*"),
    "jwt_tokens": ("JWT Tokens", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "discord_webhooks": ("Discord Webhooks", r"https://discord\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+"),
    "hardcoded_creds": ("Hardcoded Credentials", r"""(?i)(password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[:=]\s*["'][^"']+["']"""),
    "api_endpoints": ("API Endpoints", r"""(?:/api/[^"'\s<>]+|/v[0-9]+/[^"'\s<>]+)"""),
    "amazon_mws": ("Amazon MWS Auth Tokens", r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    "paypal_braintree": ("PayPal Braintree Tokens", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}"),
    "google_oauth_client_id": ("Google OAuth Client IDs", r"[0-9]+-[a-z0-9_]{32}\.apps\.googleusercontent\.com"),
    "google_oauth_client_secret": ("Google OAuth Client Secrets", r"GOCSPX-[A-Za-z0-9_\-]{28}"),
    "aws_cognito": ("AWS Cognito Pool IDs", r"(?:us|eu|ap|sa|ca|me|af)-(?:east|west|south|north|central|southeast|northeast)-[0-9]:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    "aws_appsync": ("AWS AppSync Keys", r"da2-[a-z0-9]{26}"),
    "gitlab_runner": ("GitLab Runner Tokens", r"GR1348941[A-Za-z0-9_\-]{20}"),
    "slack_app_token": ("Slack App Tokens", r"xapp-[0-9]+-[A-Za-z0-9]+-[0-9]+-[A-Za-z0-9]+"),
    "shopify_custom_app": ("Shopify Custom App Tokens", r"shpca_[A-Fa-f0-9]{32}"),
    "new_relic_browser": ("New Relic Browser Keys", r"NRJS-[a-f0-9]{19}"),
    "notion_ntn": ("Notion Integration Tokens", r"ntn_[A-Za-z0-9]{40,}"),
    "instagram": ("Instagram Access Tokens", r"IGQV[A-Za-z0-9_\-]{20,}"),
    "do_spaces": ("DigitalOcean Spaces Keys", r"DO00[A-Z0-9]{36}"),
    "doppler": ("Doppler Tokens", r"dp\.(?:ct|st|sa|scim)\.[A-Za-z0-9_\-]{40,}"),
    "grafana_api": ("Grafana API Keys", r"glc_[A-Za-z0-9_+/]{32,}"),
    "algolia": ("Algolia API Keys", r"algolia[_\-]?(?:api|admin)[_\-]?key\s*[:=]\s*['\"]?[A-Za-z0-9]{32}['\"]?"),
    "credential_url": ("Credential URLs (user:pass@)", r"(?:https?|ftp)://[^\s:@'\"]+:[^\s:@'\"]+@[^\s'\"]+"),
}
QUOTED_PATH = r"""["'](/[a-zA-Z0-9_\-./]+)["']"""
ASSETS = (".js", ".css", ".png", ".jpg", ".svg", ".ico", ".woff")
VARIABLE = r"""(?:var|let|const)\s+(\w+)\s*=\s*["']([^"']+)["']"""
ROUTE = r"""["'][/][a-zA-Z0-9_/-]*(?:admin|dashboard|manage|config|settings|internal|private|debug|api/v[0-9])[a-zA-Z0-9_/-]*["']"""
URL = r"""(https?://[^"'\s<>]+)"""
SPECIAL = {"js_endpoints": "Endpoints in quotes", "js_variables": "Variables with a text", "js_routes": "Routes of interest", "js_urls": "URLs"}
PATTERNS = {"js_endpoints": QUOTED_PATH, "js_variables": VARIABLE, "js_routes": ROUTE, "js_urls": URL}


#: Characters that many patterns ask for and prose seldom has, the rarest first; a text is searched once for each.
MARKS = "/:=_$\"'@-"


def needs(p: str) -> list[tuple[str, ...]]:
    """Sets of texts; every match of the pattern has one of each set.  Those of marks come first."""
    literals, folded = surest(p)
    sets = set(all_marks(p, frozenset(MARKS)))
    if literals and not folded:
        sets |= {frozenset(c) for c in frozenset.intersection(*map(frozenset, literals)) & frozenset(MARKS)}
    marks = sorted((tuple(sorted(some, key=MARKS.index)) for some in sets), key=lambda some: (len(some), [MARKS.index(c) for c in some]))
    return marks + ([literals] if literals and not folded and literals not in marks else [])


def may_match_some(text: str, patterns: list[str]) -> Column:
    """A cheap condition that every text with a match of one of the patterns fulfils.

    It looks at bytes, once for each text asked for, so that most prose is never decoded."""
    firsts = [(needs(p) or [None])[0] for p in patterns]
    if None in firsts:
        return F.lit(True)
    return reduce(or_, [F.contains(F.col(text), F.lit(x)) for x in dict.fromkeys(x for some in firsts for x in some)], F.lit(False))


def _marked(rows: DataFrame, text: str) -> DataFrame:
    """With a column for each mark: whether the text holds it."""
    return rows.select("*", *[F.contains(F.col(text), F.lit(c)).alias(f"__mark{i}") for i, c in enumerate(MARKS)])


def may_match(text: str, p: str) -> Column:
    """A closer condition on a marked text for one pattern: all that its matches need."""

    def holds(x: str) -> Column:
        return F.col(f"__mark{MARKS.index(x)}") if len(x) == 1 and x in MARKS else F.contains(F.col(text), F.lit(x))

    out = reduce(and_, [reduce(or_, map(holds, some)) for some in needs(p)], F.lit(True))
    literals, folded = surest(p)
    if literals and folded:  # the array binds the folded text, so that it is made once
        out = out & F.exists(F.array(fold(F.col(text))), lambda t: reduce(or_, [F.contains(t, F.lit(x)) for x in literals]))
    return out


def from_run_starts(p: str) -> str:
    """The same matches of a pattern that starts with [class]+, tried once a run of the class and not at each character
    of it: a match from within a run means one from the character before, unless the last match ended there."""
    return re.sub(r"^(\[[^\]\[]+\])\+", r"(?:\\G|(?<!\1))\1+", p)


def _all(text: str, p: str, group: int = 0):
    found = F.regexp_extract_all(F.col(text), X.pattern(from_run_starts(p)), F.lit(group))
    return F.when(may_match(text, p), found).otherwise(F.array().cast("array<string>"))


def special(text: str) -> dict:
    """The four extractors that are more than a pattern, as arrays, of marked texts."""
    paths = F.filter(_all(text, QUOTED_PATH, 1), lambda p: (F.length(p) > 4) & ~F.regexp_like(p, F.lit("|".join(a.replace(".", r"\.") for a in ASSETS))))
    pairs = F.zip_with(_all(text, VARIABLE, 1), _all(text, VARIABLE, 2), lambda name, value: F.concat(name, F.lit(" = "), value))
    routes = F.transform(_all(text, ROUTE), lambda r: F.regexp_replace(r, "^[\"']+|[\"']+$", ""))
    return {"js_endpoints": paths, "js_variables": pairs, "js_routes": routes, "js_urls": _all(text, URL, 1)}


def extract(rows: DataFrame, text: str = "text", file: str = "file", categories: list[str] | None = None) -> DataFrame:
    """(category, desc, value, file): each value once in a category, at the first file by name.

    All categories are arrays of one projection; one aggregate takes the first file.  A text meets only
    the patterns whose marks and literals it holds."""
    wanted = {name: p for name, (_, p) in CATEGORIES.items()} | PATTERNS
    wanted = {name: p for name, p in wanted.items() if categories is None or name in categories}
    arrays = []
    for name, (desc, p) in CATEGORIES.items():
        if name in wanted:
            values = F.filter(F.transform(_all(text, p), X.strip), lambda v: F.length(v) >= 4)
            arrays.append((name, desc, values))
    for name, values in special(text).items():
        if name in wanted:
            arrays.append((name, SPECIAL[name], values))

    def told(name: str, desc: str):
        return lambda x: F.struct(F.lit(name).alias("category"), F.lit(desc).alias("desc"), x.alias("value"))

    found = F.flatten(F.array(*[F.transform(F.array_distinct(v), told(n, d)) for n, d, v in arrays]))
    some = rows.where(F.col(text).isNotNull() & may_match_some(text, list(wanted.values())))
    each = _marked(some, text).select(F.col(file).alias("file"), F.explode(found).alias("x"))
    return each.groupBy("x.category", "x.desc", "x.value").agg(F.min("file").alias("file"))


def totals(report: DataFrame) -> DataFrame:
    """Findings of each category, the most first."""
    return report.groupBy("category", "desc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
