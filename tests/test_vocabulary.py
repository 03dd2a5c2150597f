from __future__ import annotations

import random

from attestor.plans import linking


def test_canonical_knows_all_first_words(spark, tmp_path):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(450)})
    spark.createDataFrame([(i, f"{w} part") for i, w in enumerate(words)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey: r.canonical for r in linking.n2_canonical(spark, str(tmp_path)).collect()} == dict(enumerate(words))
