from __future__ import annotations

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from attestor.llm.common import stored


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item} y"), (None, "clean without an id"), (None, None), (7, item), (7, "clean with the id"), (8, "another"), (8, "another")]
    out = pipeline.drop_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_stages_on_odd_rows(spark, docs_of, odd, tmp_path):
    """Nulls, repeats, ties, empties and columns of the stages' own names: no row is made up, and none is lost but by a decision."""
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 2)) for i in range(100, 160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["_bad", "_bad_same", "_same", "_kid", "_ksame", "_size", "_copies", "_copy", "_target", "_u", "_sources", "_words", "place", "use", "y"]
    rows = odd + [(i, f"{'scum trash filth' if i % 2 else 'plain good words'} number {i}") for i in range(100, 160)] + [(7, item), (None, item)]
    docs = docs_of(rows).withColumns({n: F.lit("own") for n in names}).withColumn("source", F.when(F.col("doc_id") > 5, "a")).drop("score")
    for name, stage in pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns and 0 < out.count() and out.distinct().exceptAll(docs.distinct()).isEmpty(), name
        assert out.filter(" or ".join(f"{n} <> 'own'" for n in names)).isEmpty(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert docs.filter(F.col("text").contains(item)).isEmpty()
