"""Faults that the review of round 4 found, each on the least rows that show it."""

import json

import duckdb
import pytest

from sparksift.operators import structured
from sparksift.plans import catalogue


def by_sql(sql: str, folder: str, *names: str) -> list[tuple]:
    with duckdb.connect() as connection:
        for name in names:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        return sorted(connection.execute(sql).fetchall())


SECRET = "q9Zr+Tb3kLw7Xc/Vm2Np8Hs5Jd4Gf6Ye"


@pytest.fixture
def large(spark, tmp_path):
    """Documents on both sides of 1 MiB; the larger ones speak of secrets after 64 KiB only, or have line ends that are those of whole texts."""
    filler = "plain words " * 100_000
    texts = [(1, f"a\x85token {SECRET} b"), (2, f"{filler}\ntoken {SECRET}"), (3, f"token\x85{filler} token {SECRET}\x0bend"), (4, filler), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_entropy_sweep_is_its_sql_for_large_texts(spark, large):
    got = sorted(tuple(r) for r in catalogue.entropy_sweep(spark, large).collect())
    assert got == by_sql(catalogue.ORACLES["entropy_sweep"], large, "documents")
    assert [r[:2] for r in got if r[2] == SECRET] == [("doc:1", 2), ("doc:2", 2), ("doc:3", 3)] and len({r[0] for r in got}) == 4


def test_rules_on_documents_are_their_sql_for_large_texts(spark, tmp_path):
    texts = [(1, f"{'plain words ' * 100_000}\x85key ghp_{'aB3d' * 9}\x0bend")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.rule_hits_documents(spark, str(tmp_path)).collect())
    assert got == by_sql(catalogue.ORACLES["rule_hits_documents"], str(tmp_path), "documents") and {r[1] for r in got} == {2}


def test_json_documents_are_their_sql_for_large_texts(spark, tmp_path):
    # the JSON of the first has more than 10 Mi characters
    texts = [(1, "Ähnlich \"so\"\n" * 450_000), (2, "b"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.json_documents(spark, str(tmp_path)).collect())
    assert got == by_sql(catalogue.ORACLES["json_documents"], str(tmp_path), "documents") and [r[0] for r in got] == [1, 1, 2, 2]


def test_json_values_have_no_size_that_is_too_much(spark):
    # many texts, deep ones, long numbers, and the paths of empty keys
    many, deep = [f"t{i}" for i in range(25_000)], "[" * 2000 + '"x"' + "]" * 2000
    rows = [("many", json.dumps(many)), ("deep", deep), ("long", f'{{"n": {"9" * 5000}, "a": {{"b": [1, "x"]}}}}'), ("empty", '{"": {"": "x", "a": ["", "y"]}, "b": {"": "z"}}'), ("none", "[1"), ("null", None)]
    got = structured.json_values(spark.createDataFrame(rows, "id string, text string")).collect()
    by = {k: [(r.key_path, r.value) for r in sorted(got, key=lambda r: r.json_at) if r.id == k] for k, _ in rows}
    assert by["many"] == [(f"[{i}]", t) for i, t in enumerate(many)]
    assert by["deep"] == [("[0]" * 2000, "x")] and by["long"] == [("a.b[1]", "x")]
    assert by["empty"] == [("", "x"), ("a[1]", "y"), ("b.", "z")] and not by["none"] and not by["null"]
