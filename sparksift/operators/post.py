"""What happens to findings after the scan: order, duplicates, severity, suppression, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import SEVERITIES, rank_column

# Path parts and words must be as they are for right results.
NON_PRODUCTION = (
    "test", "tests", "spec", "specs", "__tests__", "example", "examples", "demo", "demos", "samples",
    "dummy", "mock", "mocks", "fixtures", "fixture", "stubs", "vendor", "third_party",
)
PLACEHOLDER = r"(?i)\b(?:example|placeholder|changeme|change_me|your[-_](?:key|secret|token|password)|sample|TODO|FIXME|xxxxx|yyyyy|test[-_]?value|dummy)\b"
VALIDATORS = {
    "github_pat": "github", "github_server_token": "github", "github_oauth": "github", "github_app_token": "github", "github_fine_grained_pat": "github",
    "stripe_secret_key": "stripe", "slack_token": "slack", "slack_webhook": "slack_webhook", "sendgrid_api_key": "sendgrid", "anthropic_api_key": "anthropic",
    "openai_api_key": "openai", "openai_project_key": "openai", "google_api_key": "google", "huggingface_token": "huggingface", "gitlab_pat": "gitlab",
    "gitlab_ci_job_token": "gitlab_ci_job", "gitlab_pipeline_trigger": "gitlab_trigger", "perplexity_api_key": "perplexity", "aws_access_key_id": "aws_sts", "discord_bot_token": "discord_bot",
}


def first_of(findings: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; only findings are dealt out, never lines."""
    return findings.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def once_a_file(findings: DataFrame) -> DataFrame:
    """One finding for each line, rule and start of the secret in a file; endpoints whole, and once a file.

    An aggregate rather than a window, as it is combined before the shuffle."""
    endpoint = F.col("rule") == "endpoint"
    line, secret = F.when(endpoint, 0).otherwise(F.col("line")), F.when(endpoint, F.col("secret")).otherwise(F.left("secret", F.lit(30)))
    return _least(findings, [F.col("file"), line, F.col("rule"), secret], F.struct("seq"))


def _least(findings: DataFrame, key: list[Column], order: Column) -> DataFrame:
    names = [f"__k{i}" for i in range(len(key))]
    row = F.struct(order.alias("o"), *[F.col(c) for c in findings.columns])
    least = findings.groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)]).agg(F.min(row).alias("r"))
    return least.select(*[F.col(f"r.{c}").alias(c) for c in findings.columns])


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding for each rule and secret, the first by severity, file, line and
    order; the context says how often it was found besides."""
    order = F.struct(rank_column(F.col("severity")).alias("r"), "file", "line", "seq")
    row = F.struct(order.alias("o"), *[F.col(c) for c in findings.columns])
    least = findings.groupBy(F.col("rule").alias("__rule"), F.col("secret").alias("__secret")).agg(F.min(row).alias("r"), F.count("*").alias("n"))
    out = least.select(*[F.col(f"r.{c}").alias(c) for c in findings.columns], "n")
    more = F.concat("context", F.lit("  [also found in "), F.col("n") - 1, F.lit(" other file(s)]"))
    return out.withColumn("context", F.when(F.col("n") > 1, more).otherwise(F.col("context"))).drop("n")


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, file and line; then in the order in which they were made."""
    last = ["seq"] if "seq" in findings.columns else ["rule", "secret"]
    return findings.orderBy(rank_column(F.col("severity")), "file", "line", *last)


def downgrade(findings: DataFrame) -> DataFrame:
    """One step milder under a path that isn't production, and INFO where the context is a placeholder."""
    steps = F.create_map(*[F.lit(x) for pair in zip(SEVERITIES, SEVERITIES[1:], strict=False) for x in pair])
    milder = F.coalesce(steps[F.col("severity")], F.col("severity"))
    off = F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, NON_PRODUCTION)))
    stepped = F.when(off, milder).otherwise(F.col("severity"))
    return findings.withColumn("severity", F.when(X.search(F.col("context"), PLACEHOLDER), "INFO").otherwise(stepped))


def suppress(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """Without the findings whose fingerprint is in ignored (fingerprint); Spark broadcasts the list if its size allows."""
    marked = findings.withColumn("__fp", X.fingerprint(F.col("rule"), F.col("secret"), F.col("file")))
    return marked.join(ignored.select(F.col("fingerprint").alias("__fp")).distinct(), "__fp", "left_anti").drop("__fp")


def without(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Without the findings whose secret's start was already found in compressed content of the same file."""
    seen = known.select(F.col("file").alias("__f"), F.left("secret", F.lit(60)).alias("__s")).distinct()
    return findings.join(seen, (F.col("file") == F.col("__f")) & (F.left("secret", F.lit(60)) == F.col("__s")), "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    """(severity, rule, n, files): by severity, by rule and in all, in one pass by grouping sets."""
    grouped = findings.groupingSets([[F.col("severity")], [F.col("rule")], []], F.col("severity"), F.col("rule"))
    return grouped.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n"))


def failing(findings: DataFrame, fail_on: str | None) -> DataFrame:
    """One row: whether the scan fails - any finding, or any at least as severe as fail_on."""
    from ..model import rank

    bad = F.lit(True) if fail_on is None else rank_column(F.col("severity")) <= rank(fail_on)
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"))


def validatable(findings: DataFrame) -> DataFrame:
    """What could be validated with a provider: (rule, secret, validator), once for each rule and start of the secret.

    Nothing is sent anywhere; a transport is up to the caller."""
    pairs = [F.lit(x) for kv in VALIDATORS.items() for x in kv]
    named = findings.withColumn("validator", F.create_map(*pairs)[F.col("rule")]).where("validator is not null")
    return named.groupBy("rule", F.left("secret", F.lit(40)).alias("__k")).agg(F.min_by("secret", F.struct("file", "line", "secret")).alias("secret"), F.first("validator").alias("validator")).drop("__k")


def validate(findings: DataFrame, transport) -> list[dict]:
    """Results of transport(validator, secret) -> (valid, detail); without a transport nothing is valid and nothing is sent."""
    out = []
    for row in validatable(findings).toLocalIterator():
        valid, detail = transport(row["validator"], row["secret"]) if transport else (False, "not sent: no transport was given")
        out.append({"rule": row["rule"], "secret": row["secret"], "valid": bool(valid), "detail": detail})
    return out


def exact_duplicates(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Files with digest, kept_path, copies and keep: whether it is the first by path of those with its content.

    Contents are read and hashed once; only paths and digests are dealt out, and no task holds a large group of copies.
    A null content has a null digest and is a group of its own kind; a null path is never the first."""
    from ..sources.shared import skew_join, staged

    hashed = staged(files.select(path, F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")).alias("digest")))
    firsts = hashed.groupBy("digest").agg(F.min(path).alias("kept_path"), F.count("*").alias("size")).withColumn("copies", F.col("size"))
    out = skew_join(hashed, firsts, "digest", "size", hashed.count(), path)
    return out.withColumn("digest", F.nullif("digest", F.lit(""))).withColumn("keep", F.col(path) == F.col("kept_path"))
