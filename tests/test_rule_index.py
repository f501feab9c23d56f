"""The index of rules misses no match, and rules may be a table."""

import random
import re
import re._constants as sre
import re._parser as sre_parse

import pytest
from pyspark.sql import functions as F

from sparksift.model import builtin_rules
from sparksift.operators import match as M
from sparksift.plans import catalogue

RULE = "rule_ord int, name string, severity string, pattern string"


def plain(lines, rules):
    compiled = [(name, re.compile(pattern)) for name, pattern in rules]
    return {(line, name, m[0], m.start() + 1) for line in lines if line is not None for name, pattern in compiled for m in pattern.finditer(line)}


def found(df, text="t"):
    return {(r[text], r.rule, r.secret, r.column) for r in df.collect()}


def example(tree, rng):
    """A text that the parsed pattern matches, but for what it asks of the text around."""
    out = ""
    for op, value in tree:
        if op is sre.LITERAL:
            out += chr(value)
        elif op in (sre.NOT_LITERAL, sre.ANY):
            out += "~"
        elif op is sre.IN:
            out += rng.choice(members(repr(value), lambda: sre_compile([(op, value)])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "".join(example(value[2], rng) for _ in range(value[0] + rng.randrange(3) * (value[1] > value[0])))
        elif op is sre.SUBPATTERN:
            out += example(value[3], rng)
        elif op is sre.BRANCH:
            out += example(rng.choice(value[1]), rng)
    return out


MEMBERS = {}


def members(name, compiled):
    if name not in MEMBERS:
        one = compiled()
        MEMBERS[name] = [c for c in map(chr, [10, *range(32, 127)]) if one.match(c)]
    return MEMBERS[name]


def sre_compile(part):
    state = sre_parse.State()
    state.str = ""
    return re._compiler.compile(sre_parse.SubPattern(state, part))


def examples(pattern, rng):
    texts = [example(sre_parse.parse(pattern), rng) for _ in range(2)]
    return [t for x in texts for t in (x, f"a {x.upper()} b") if re.search(pattern, t)]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    out = []
    for pattern, _ in M.distinct_patterns(list(enumerate(builtin_rules()))):
        out += examples(pattern, rng)
    return out + [f"{a} {b}" for a, b in zip(rng.sample(out, 60), rng.sample(out, 60), strict=True)] + [None, "", "ab", "plain words", "ſeCret_Key = Abcdefghij0123456789"]


def test_no_match_is_missed(samples):
    """Each text with a match has a key of the pattern, with the literal that belongs to it."""
    for p, (pattern, _) in enumerate(M.distinct_patterns(list(enumerate(builtin_rules())))):
        entries = M.entries(p, pattern, [])
        assert M.ANY not in {e["key"] for e in entries}
        for text in filter(None, samples):
            if re.search(pattern, text):
                folded = text.translate(str.maketrans(M._ODD, M._PLAIN)).lower()
                held = [e for e in entries if (re.search(M.RUNS[e["key"][1:]], text) if e["key"][0] == M._MARK else e["key"] in folded and e["literal"] in (folded if e["folded"] else text))]
                assert held, (pattern, text)
                assert sum(not any(x in (folded if e["folded"] else text) for x in e["earlier"]) for e in held) == 1


def test_index_finds_what_python_finds(spark, samples):
    lines = spark.createDataFrame([(t,) for t in samples], "t string")
    got = found(M.match_rules(lines, list(enumerate(builtin_rules())), "t", check=False))
    expected = plain(set(samples), [(r.name, r.pattern) for r in builtin_rules()])
    assert got == expected and len({name for _, name, *_ in expected}) > 150
    plan = M.match_rules(lines, list(enumerate(builtin_rules())), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in M.match_rules(lines, list(enumerate(builtin_rules())), "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ghp_") <= 1


@pytest.mark.parametrize("sent", [200_000, 700])
def test_rules_from_a_table(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "ENTRIES_SENT", sent)
    rng = random.Random(8)
    key = lambda: "".join(rng.choices("abcdefgh0123", k=7))
    forms = (r"\b{}[0-9]{{3}}\b", r"(?i)name_{}\s*=", r"(?:{}|zz{})\d", r"x{}é+", "{}")
    rules = [(i, f"r{i}", "LOW", rng.choice(forms).replace("{}", k).replace("{{", "{").replace("}}", "}")) for i, k in enumerate(key() for _ in range(1500))]
    rules += [(2000, "digits only", "LOW", r"[0-9]{9}"), (2001, "no literal", "LOW", r"[^ -~]{2}"), (2002, "short", "LOW", "q7"), (2003, "odd", "LOW", "(?i)straße[0-9]"), (2004, "group", "LOW", "(?i:SeCret)-[0-9]")]
    lines = []
    for _, _, _, pattern in rng.sample(rules[:1500], 200):
        k = re.search(r"[a-h0-3]{7}", pattern)[0]
        lines += [f"say {k}123 and", f"NAME_{k.upper()} = 1", f"zz{k}5 {k}7", f"x{k}éé", f"{k}{k}", k[:6]]
    lines += [None, "", "a", "aé", "ßß", "123456789", "q7", "STRASSE1 Straße2 ſtraße3", "secret-1 SECRET-2"] + [" ".join(key() for _ in range(40))] * 2
    table = spark.createDataFrame(rules, RULE)
    rows = spark.createDataFrame([(t,) for t in lines], "t string").withColumn("__grams", F.lit(1)).withColumn("key", F.lit(2)).withColumn("pattern", F.lit(3))
    got = M.match_table(rows, table, "t")
    assert found(got) == plain(set(lines), [(r[1], r[3]) for r in rules]) and got.count() > 500
    assert M.match_table(rows, spark.createDataFrame([], RULE), "t").count() == 0
    assert M.match_table(rows.limit(0), table, "t").count() == 0


def test_the_plan_does_not_grow_with_the_rules(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    size = lambda n: len(M.match_table(rows, spark.range(n).select(F.col("id").cast("int").alias("rule_ord"), F.lit("n").alias("name"), F.lit("LOW").alias("severity"), F.concat(F.lit("key"), "id").alias("pattern")), "t")._jdf.queryExecution().executedPlan().toString())
    assert abs(size(3000) - size(3)) < 300
    rules = catalogue.made_rules(spark.createDataFrame([(1,), (2,)], "c_custkey long")).collect()
    assert len(rules) == 8 and len({r.pattern for r in rules}) == 8
