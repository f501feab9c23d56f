"""Faults that the review of round 3 found, each on the least rows that show it."""

import duckdb
import pytest

from sparksift.operators import match
from sparksift.plans import catalogue


def by_sql(sql: str, folder: str, *names: str) -> list[tuple]:
    with duckdb.connect() as connection:
        for name in names:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        return sorted(connection.execute(sql).fetchall())


@pytest.fixture
def weak(spark, tmp_path):
    """Documents of which the ids 1069 and 10271 make values whose entropy is below 3."""
    spark.createDataFrame([(1, "a"), (1069, "b"), (10271, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_json_walk_is_its_sql_for_values_of_low_entropy(spark, weak):
    got = sorted(tuple(r) for r in catalogue.json_walk(spark, weak).collect())
    assert got == by_sql(catalogue.ORACLES["json_walk"], weak, "documents")
    assert {(r[0], r[1]) for r in got if r[3]} == {(1, "db.password"), (1, "list[0].api_key")} and len(got) == 9


def test_cached_names_are_their_sql_for_values_of_low_entropy(spark, weak):
    got = sorted(tuple(r) for r in catalogue.cached_names(spark, weak).collect())
    assert got == by_sql(catalogue.ORACLES["cached_names"], weak, "documents")
    assert [r[0] for r in got] == ["j/1.json", "k/1.json"]


def test_large_rule_tables_meet_texts_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(match, "ENTRIES_SENT", 10)
    rules = catalogue.made_rules(spark.range(1, 101).withColumnRenamed("id", "c_custkey")).collect()
    key = rules[0].pattern.removeprefix(r"\btk")[:8]
    lines = spark.createDataFrame([(f"id {key}:1234567 end",), (f"id {key}:1 end",), (None,)], "line_text string")
    found = match.match_table(lines, spark.createDataFrame(rules))
    assert [r.rule for r in found.collect()] == ["account_1"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["chained_documents", "json_documents", "gzip_texts"])
def test_python_gets_few_texts_at_once(spark, tmp_path, name):
    # a worker holds a batch, and some times as much while it decodes it
    at = "spark.sql.execution.arrow.max"
    spark.conf.set(f"{at}RecordsPerBatch", "10000")
    spark.conf.set(f"{at}BytesPerBatch", str(256 << 20))
    spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 10) || id AS text").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.QUERIES[name](spark, str(tmp_path))
    assert int(spark.conf.get(f"{at}RecordsPerBatch")) <= 1000 and int(spark.conf.get(f"{at}BytesPerBatch")) <= 8 << 20
    assert made.select("doc_id").distinct().count() == 3000


def test_keys_of_texts_are_not_made_one_a_character(spark):
    # a page of one line of 100,000 characters holds thousands of 3-grams, of which the index knows few
    line = "".join(chr(97 + i * i * 7 % 26) for i in range(100_000)) + " ghp_" + "aB3d" * 9
    found = match.match_rules(spark.createDataFrame([(line,), ("",), (None,)], "line_text string"), catalogue._ONE_RULE, check=False)
    assert [r.secret for r in found.collect()] == ["ghp_" + "aB3d" * 9]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "(?=(.{3}))" not in plan


def test_a_sweep_without_rules_makes_no_keys(spark, weak):
    plan = catalogue.entropy_sweep(spark, weak)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=(.{3}))" not in plan and "MapInArrow" not in plan
