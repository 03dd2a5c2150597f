from __future__ import annotations

from attestor.operators.resolve import resolve
from attestor.streaming.incremental import resolve_stream

SCHEMA = "case_id long, field_name string, value string, rank int, legible boolean, superseded boolean, correction boolean"


def test_new_files_are_resolved_once(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", "x", 2, True, False, False), (1, "a", "y", 3, True, False, False)], SCHEMA)
    second = spark.createDataFrame([(2, "a", "x", 2, True, False, False), (2, "a", "y", 2, True, False, False)], SCHEMA)
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    for rows in (first, second, second.limit(0)):
        rows.coalesce(1).write.mode("append").parquet(where[0])
        resolve_stream(spark, where[0], SCHEMA, *where[1:]).awaitTermination(60)
    got = spark.read.parquet(where[1]).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, resolve(first.union(second)).collect()))
