"""Resolution of conflicting evidence by source precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(evidence: DataFrame) -> Column:
    """Legible, not superseded, not struck through, with a value; a null flag makes a row ineligible.  visual_cues (array) is looked at where evidence has it."""
    ok = F.col("legible") & ~F.col("superseded") & F.col("value").isNotNull()
    if "visual_cues" in evidence.columns:
        ok = ok & ~F.coalesce(F.array_contains("visual_cues", "strikethrough"), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def resolve(evidence: DataFrame, keys: Sequence[str] = ("case_id", "field_name")) -> DataFrame:
    """State of each field of each case: resolved, unknown or contested.

    Only eligible rows of the best (least) rank count, and of these only
    corrections if there are any.  One distinct value resolves the field, more
    contest it, none leaves it unknown.

    Two aggregations on nested keys, both with map-side partials: rank and
    correction join the key of the first, so a case of any size is folded
    before it is shuffled and no window holds a group's rows.
    """
    per_rank = (
        evidence.withColumn("_ok", eligible(evidence))
        .groupBy(*keys, F.when(F.col("_ok"), F.col("rank")).alias("_rank"), F.when(F.col("_ok"), F.coalesce("correction", F.lit(False))).alias("_fix"))
        .agg(F.min(F.when(F.col("_ok"), F.col("value"))).alias("_lo"), F.max(F.when(F.col("_ok"), F.col("value"))).alias("_hi"), F.count("*").alias("_n"))
    )
    # order: best rank first, within it corrections first, ineligible rows last
    best = F.min(F.struct(F.col("_rank").isNull().alias("a"), F.col("_rank").alias("b"), (~F.col("_fix")).alias("c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
    out = per_rank.groupBy(*keys).agg(best.alias("_b"), F.sum("_n").alias("considered"))
    state = F.when(F.col("_b.b").isNull(), "unknown").when(F.col("_b.lo") == F.col("_b.hi"), "resolved").otherwise("contested")
    return out.select(*keys, state.alias("state"), F.when(state == "resolved", F.col("_b.lo")).alias("value"), F.col("_b.b").alias("winning_rank"), "considered")
