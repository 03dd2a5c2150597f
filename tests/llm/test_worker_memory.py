from __future__ import annotations

import gc
import os

import pyarrow as pa
from helpers import SF

from attestor.llm import common, token_store, wordpiece
from attestor.llm.common import in_batches, local_rows, table


def test_workers_let_go_of_other_operators_tables(spark):
    def held(batches):
        """The process of a task, and how many tables of other operators it has."""
        for batch in batches:
            n = sum(type(x).__name__ in ("ChunkEncoder", "Matcher") for x in gc.get_objects())
            yield pa.record_batch([pa.array([os.getpid()]), pa.array([n], pa.int64())], names=["pid", "n"])

    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id").repartition(16)
    for use in (token_store.digest, wordpiece.token_counts):
        assert use(docs).count() and use(docs).agg({"n_tokens": "sum"}).head()[0] > 0
        assert {r.n for r in in_batches(rows, held, "pid long, n long").collect()} == {0}


def test_kept_once_for_an_operator(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    a = common.kept("a", 1, object)
    assert common.kept("a", 1, list) is a
    common.let_go("a")
    assert common.kept("a", 1, list) is a
    common.let_go("b")
    assert common.kept("a", 1, list) == []


def test_local_rows_start_no_python(spark):
    rows = [(["s", "t"], 1, 0.5, None), ([], 2, float("inf"), 3)]
    schema = "a array<string>, b int, c double, d long"
    got = local_rows(spark, rows, schema)
    assert [tuple(r) for r in got.collect()] == rows and got.schema == spark.createDataFrame(rows, schema).schema
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan(got) and "ExistingRDD" not in plan(got)
    assert local_rows(spark, [], schema).collect() == []
