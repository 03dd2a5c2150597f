"""Queries over orders whose case ids repeat, as they do beyond 1,000,000 order keys."""

from __future__ import annotations

import os

import duckdb
import pytest
from helpers import SF, TABLES, assert_same

from attestor.operators import scoring as S
from attestor.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Tables with three orders for each case id: the repeats differ in customer, status and priority."""
    folder = tmp_path_factory.mktemp("repeated")
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    n = duckdb.execute(f"SELECT max(o_orderkey) + 1 FROM '{SF}/orders.parquet'").fetchone()[0]
    duckdb.execute(
        f"""COPY (SELECT a.o_orderkey + 1000000 * i AS o_orderkey, b.* EXCLUDE (o_orderkey) FROM '{SF}/orders.parquet' a, (SELECT unnest(range(3)) AS i), '{SF}/orders.parquet' b
WHERE b.o_orderkey = (a.o_orderkey + 7 * i) % {n}) TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("name", ["d4_error_groups", "d5_case_outcomes", "d8_release_gate", "d9_regressions", "k1_canonical_jsonl"])
def test_same_as_sql(spark, repeated, name):
    assert_same(QUERIES[name](spark, repeated), ORACLE[name], repeated)


def test_listed_twice(spark):
    scores = spark.createDataFrame([("a", "correct", None, None), ("a", "wrong_decision", None, None), ("b", "correct", None, None)], "case_id string, classification_reason string, difficulty string, traps string")
    listed = spark.createDataFrame([("a", True, False), ("a", None, True), ("b", None, None)], "case_id string, golden boolean, adversarial boolean")
    got = sorted((r.case_id, r.correct, r.golden, r.adversarial) for r in S.outcomes(scores, listed).collect())
    assert got == [("a", False, True, True), ("a", True, True, True), ("b", True, False, False)]


def test_regressions_of_repeated_ids_are_pairs(spark):
    schema = "case_id string, correct boolean, golden boolean, adversarial boolean"
    was = spark.createDataFrame([("a", True, True, True), ("a", True, False, True), ("a", False, True, True), ("b", True, True, False)], schema)
    now = spark.createDataFrame([("a", False, False, False), ("a", None, False, False), ("a", True, False, False), ("b", True, False, False)], schema)
    assert sorted(map(tuple, S.regressions(was, now).collect())) == [("adversarial", "a")] * 4 + [("golden", "a")] * 2
