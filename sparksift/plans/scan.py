"""The scan: from texts to findings.

    texts (file, text [, content, length])
      -> lines with context, those that may hold anything             narrow
      -> units: lines, what their encoded strings say, endpoints       narrow; one Arrow pass where Python decodes
      -> rules and sweeps on all units                                 narrow
      -> once a file                                                   one shuffle, of findings only
      -> post-processing by mode                                       one shuffle, of findings only

Lines are made once, whatever is looked for.  Values of JSON files are units of a second,
small branch, which only reads files of that name; so are compressed contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import COLUMNS, INTERNAL, ScanOptions
from ..operators import decode, post, structured
from ..operators.match import TOKEN, gate, match_rules
from ..sources import lines as lines_of

#: Order of the stages: of equal findings in a file the earliest stage's stays.
STAGES = {"gzip": 0, "rules": 1, "entropy": 2, "base64": 3, "hex": 4, "escapes": 5, "json": 6, "endpoint": 7, "javascript": 8, "chain": 9}
CONTENT_MAX = 200


def _seq(stage: str, *parts: Column) -> Column:
    """Sortable place of a finding: whether its stage takes whole files, stage or line, and places within."""
    head = [F.lit(0), F.lit(-1)] if stage == "gzip" else [F.lit(1), F.lit(STAGES[stage])]
    return F.array(*[n.cast("int") for n in [*head, F.lit(STAGES[stage]), F.col("line"), *parts]])


def _finding(rows: DataFrame, stage: str, rule: Column, severity: Column, secret: Column, context: Column, seq: list[Column], column: Column | None = None, contexts: bool = False, entropy: Column | None = None) -> DataFrame:
    return rows.select(
        "file",
        F.col("line").cast("int").alias("line"),
        rule.alias("rule"),
        severity.alias("severity"),
        secret.alias("secret"),
        context.alias("context"),
        (X.entropy(secret) if entropy is None else entropy).alias("entropy"),
        (F.lit(0) if column is None else column).cast("int").alias("column"),
        (F.col("context_before") if contexts else F.lit("")).alias("context_before"),
        (F.col("context_after") if contexts else F.lit("")).alias("context_after"),
        _seq(stage, *seq).alias("seq"),
    )


#: What is matched: a text, with where it comes from and how its findings are told.
_UNIT = ("file", "line", "stage", "tag", "decode_at", "unit", "entropy_ok", "small", "context_before", "context_after")
_JSON_KEY, _ENDPOINT = "<key>", "endpoint"


def _decoders(options: ScanOptions) -> list[str]:
    """Stages that decode in Python."""
    on = (("escapes", options.decode_unicode), ("javascript", options.js_reconstruct), ("chain", options.decode_unicode or options.decode_gzip))
    return [stage for stage, wanted in on if wanted]


def _may_hold(options: ScanOptions):
    """A cheap condition that lines with any finding fulfil."""
    ruled = gate(options.active())

    def holds(line: Column) -> Column:
        out = ruled(line)
        for wanted, marks in ((options.decode_unicode or options.decode_gzip, ("\\u", "%")), (options.js_reconstruct, ("+", "join", "`")), (options.endpoints, ("/",))):
            for mark in marks if wanted else ():
                out = out | F.contains(line, F.lit(mark))
        if options.entropy or options.decode_base64 or options.decode_hex or options.decode_unicode or options.decode_gzip or options.js_reconstruct:
            out = out | F.regexp_like(line, F.lit(TOKEN))  # all of these need longer runs than that
        return out

    return holds


def _unit(stage: int, tag: Column, at: Column, text: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), tag.alias("tag"), at.alias("decode_at"), text.alias("unit"))


def _from_decoded(line: Column, tag: str) -> Column:
    return F.transform(decode.decoded_array(line, tag), lambda x: _unit(STAGES[tag], x["tag"], x["decode_at"], x["text"]))


def _units(lines: DataFrame, options: ScanOptions) -> DataFrame:
    """Lines, and all that the encoded strings in them say."""
    line = F.col("line_text")
    units = F.array(_unit(STAGES["rules"], F.lit(""), F.lit(0), line))
    for tag, on in (("base64", options.decode_base64), ("hex", options.decode_hex)):
        if on:
            units = F.concat(units, _from_decoded(line, tag))
    if stages := _decoders(options):
        lines = decode.with_decoded(lines, stages, "line_text", "large", {s: STAGES[s] for s in stages})
        units = F.concat(units, F.coalesce("decoded", F.array().cast(lines.schema["decoded"].dataType)))
    each = lines.select("file", "line", "entropy_ok", "large", "context_before", "context_after", F.explode(units).alias("u"))
    return each.select("file", "line", "u.stage", "u.tag", "u.decode_at", "u.unit", "entropy_ok", (~F.col("large")).alias("small"), "context_before", "context_after")


def _json_units(texts: DataFrame) -> DataFrame:
    """Values of JSON files, with their key paths in the place of the context before."""
    values = structured.json_values(texts.where(F.endswith(F.lower("file"), F.lit(".json"))).select("file", "text"))
    return values.select("file", F.lit(0).alias("line"), F.lit(STAGES["json"]).alias("stage"), F.lit("json").alias("tag"), F.col("json_at").alias("decode_at"), F.col("value").alias("unit"), F.lit(False).alias("entropy_ok"), F.lit(True).alias("small"), F.col("key_path").alias("context_before"), F.lit("").alias("context_after"))


def unit_findings(units: DataFrame, options: ScanOptions) -> DataFrame:
    """Rules on all units; on lines the entropy sweep and endpoints, on JSON values the key
    names.  The latter three have no least severity."""
    plain, json_value = F.col("stage") == STAGES["rules"], F.col("stage") == STAGES["json"]
    key_name = F.substring_index("context_before", ".", -1)
    sweeps = [(_JSON_KEY, "MEDIUM", F.when(json_value & structured.secret_key(key_name, F.col("unit")), F.array(F.left("unit", F.lit(500)))))] if options.json else []
    if options.entropy:
        eligible = plain & F.col("entropy_ok") & F.regexp_like("unit", F.lit(X.ENTROPY_TOKEN)) & X.search(F.col("unit"), X.SECRET_CONTEXT)
        tokens = F.filter(F.regexp_extract_all("unit", F.lit(X.ENTROPY_TOKEN), F.lit(0)), lambda t: ~F.regexp_like(t, F.lit(X.ENTROPY_EXCLUDE)) & X.likely_secret(t, 32, 4.5))
        sweeps.append(("high_entropy_token", "MEDIUM", F.when(eligible, tokens)))
    if options.endpoints:
        sweeps.append((_ENDPOINT, "INFO", F.when(plain & F.col("small"), structured.endpoint_array(F.col("unit")))))
    only_rules = not (_decoders(options) or options.endpoints or options.decode_base64 or options.decode_hex or options.json)
    hits = match_rules(units, options.active(), "unit", check=plain, sweeps=sweeps, gated=only_rules)
    swept, endpoint = F.col("rule_ord") < 0, F.col("rule") == _ENDPOINT
    stage = F.when(plain & endpoint, STAGES["endpoint"]).when(plain & swept, STAGES["entropy"]).otherwise(F.col("stage"))
    rule = F.when(plain, F.col("rule")).when(F.col("rule") == _JSON_KEY, F.concat(F.lit("json_"), key_name)).otherwise(F.concat_ws("_", "tag", "rule"))
    label = F.when(json_value, F.concat(F.lit("json key: "), "context_before")).when(F.col("stage") == STAGES["javascript"], "js reconstructed: ").otherwise(F.concat("tag", F.lit(" decoded: ")))
    context = F.when(plain, X.context(F.col("unit"))).when(json_value, label).otherwise(F.concat(label, F.left("unit", F.lit(CONTENT_MAX))))
    near = lambda name: F.when(plain & ~swept, F.col(name)).otherwise("").alias(name)
    placed = (plain & ~endpoint) | (F.col("stage") == STAGES["javascript"])
    whole = F.when(stage > STAGES["escapes"], 1).otherwise(0)
    order = (whole, F.when(whole == 1, stage).otherwise(F.col("line")), stage, F.when(whole == 1, F.col("line")).otherwise(0), F.col("decode_at"), F.col("rule_ord"), F.col("match_at"))
    return hits.select(
        "file",
        F.col("line").cast("int").alias("line"),
        rule.alias("rule"),
        "severity",
        "secret",
        context.alias("context"),
        F.when(F.col("rule") == _JSON_KEY, X.entropy(F.col("unit"))).when(endpoint, 0.0).otherwise(X.entropy(F.col("secret"))).alias("entropy"),
        F.when(placed, F.col("column")).otherwise(0).cast("int").alias("column"),
        near("context_before"),
        near("context_after"),
        F.array(*[x.cast("int") for x in order]).alias("seq"),
    )


def gzip_findings(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Rules in compressed content, once for each rule and start of the secret in a file."""
    texts = decode.decompress(files.select("file", "content"), "content", "text")
    hits = match_rules(X.lines(texts).withColumn("line", F.col("line") + F.col("lines_before")), options.active(), check=False)
    context = F.concat(F.lit("gzip decoded: "), X.context(F.col("line_text")))
    found = _finding(hits, "gzip", F.concat(F.lit("gzip_"), F.col("rule")), F.col("severity"), F.col("secret"), context, [F.col("rule_ord"), F.col("match_at")], F.col("column"))
    # a secret that another rule already reported is dropped as well: the first by place stays
    first = post._least(found, [F.col("file"), F.left("secret", F.lit(60))], F.struct("seq"))
    return post._least(first, [F.col("file"), F.col("rule"), F.left("secret", F.lit(30))], F.struct("seq"))


def scan(texts: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Findings of texts (file, text), or of files (file, text, content, length), with their order in `seq`."""
    options = options or ScanOptions()
    has = set(texts.columns)
    texts = texts.where(F.col("text").isNotNull())
    size = F.col("length") if "length" in has else F.octet_length("text")
    large = (size > options.large_file_bytes) if options.large_file_mode else F.lit(False)
    base = texts.withColumn("large", large)
    start = F.when(F.col("large"), F.left("text", F.lit(65536))).otherwise(F.col("text"))
    bundled = F.when(F.col("large"), F.regexp_like(F.lower("file"), F.lit(r"(\.min\.js|\.bundle\.js|\.min\.mjs)$"))).otherwise(X.minified(F.col("file"), F.col("text")))
    if options.entropy:
        spoken = X.search(start, X.SECRET_CONTEXT) if options.content_gate else F.lit(True)
        base = base.withColumn("entropy_ok", F.regexp_like("text", F.lit(X.ENTROPY_TOKEN)) & ~bundled & spoken)
    else:
        base = base.withColumn("entropy_ok", F.lit(False))
    plain = F.when(F.col("large"), X.split_lines(F.col("text"), X.PLAIN_LINE_END)).otherwise(X.split_lines(F.col("text")))
    lines = X.with_context(base.select("file", "large", "entropy_ok", plain.alias("__lines")), "__lines", _may_hold(options))
    units = _units(lines.withColumn("context_after", F.when(F.col("large"), "").otherwise(F.col("context_after"))), options)
    if options.json:
        units = units.unionByName(_json_units(base.where(~F.col("large"))))
    findings = post.once_a_file(unit_findings(units, options))
    if options.decode_gzip and "content" in has:
        zipped = gzip_findings(base.where(~F.col("large")), options)
        # only what rules and entropy find in the file's own lines gives way
        own = F.col("seq")[2].isin(STAGES["rules"], STAGES["entropy"])
        findings = post.without(findings.where(own), zipped).unionByName(findings.where(~own)).unionByName(zipped)
    return findings.select(INTERNAL)


def scan_large(spark: SparkSession, files: list[tuple[str, str, int]], options: ScanOptions | None = None, range_bytes: int = lines_of.RANGE_BYTES) -> DataFrame:
    """Findings of large files (uri, path, bytes), read by lines, with the reduced set of operators and no context after."""
    options = options or ScanOptions()
    lines, before = lines_of.large_file_lines(spark, files, range_bytes)
    bundled = F.regexp_like(F.lower("file"), F.lit(r"(\.min\.js|\.bundle\.js|\.min\.mjs)$"))
    wanted = lines.where(_may_hold(options)(F.col("line_text")))
    placed = wanted.join(before, ["file", "range"])  # only lines that may hold something are dealt out
    ok = ~bundled & (F.col("spoken") if options.content_gate else F.lit(True)) if options.entropy else F.lit(False)
    rows = placed.select("file", (F.col("before") + F.col("at") + 1).cast("int").alias("line"), "line_text", F.lit(True).alias("large"), ok.alias("entropy_ok"), "context_before", F.lit("").alias("context_after"))
    return post.once_a_file(unit_findings(_units(rows, options), options)).select(INTERNAL)


#: What follows the scan, by the surface that asks.
MODES = {"cli": ("downgrade", "deduplicate"), "all": ("downgrade",), "pipe": ("deduplicate", "downgrade"), "sdk": ("deduplicate",), "raw": ()}


def finish(findings: DataFrame, mode: str = "cli", ignored: DataFrame | None = None) -> DataFrame:
    """Post-processing in the order of the surface, then sorted, in the public schema."""
    for step in MODES[mode]:
        findings = getattr(post, step)(findings)
    if ignored is not None and mode in ("cli", "all", "pipe"):
        findings = post.suppress(findings, ignored)
    return post.ordered(findings).select(COLUMNS)
