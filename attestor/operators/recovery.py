"""Evidence recovered page by page: cues, unsafe pages, second looks that must agree."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.extract import fee_fact
from attestor.functions.fuzzy import ratio
from attestor.functions.text import ocr_key

PAGE = ["case_id", "page_index"]

# Cues that a line's text gives.
CUES = {"adjudicator_stamp": r"(?i)\badjudicator\s+stamp\b", "correction": r"(?i)\bcorrect(ion|ed)\b", "sample_denial_watermark": r"(?i)\bsample\s+denial\b"}
BAD_CUES = ["strikethrough", "sample_denial_watermark"]


def cues(text: Column, struck: Column | None = None) -> Column:
    """Sorted cues of a line; struck tells whether its pixels are crossed out."""
    found = [F.when(text.rlike(p), F.lit(c)) for c, p in CUES.items()]
    if struck is not None:
        found.append(F.when(struck, F.lit("strikethrough")))
    return F.array_sort(F.array_compact(F.array(*found)))


def off_unsafe_pages(evidence: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Evidence of pages on which nothing carries a bad cue (column visual_cues)."""
    unsafe = evidence.filter(F.arrays_overlap("visual_cues", F.array(*[F.lit(c) for c in BAD_CUES]))).select(*page).distinct()
    return evidence.join(unsafe, list(page), "left_anti")


def in_scope(case: Column, hint: Column) -> Column:
    """Evidence of the case: its page names no case, or this one."""
    return hint.isNull() | (hint == case)


def narrative_fee(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """(page, value, confidence) of the fee that a page's lines state: the first by line (of one line the least), confidence the mean of the lines that state it."""
    said = lines.select(*page, "line_seq", "confidence", fee_fact(F.col("text")).alias("_fee")).filter(F.col("_fee").isNotNull())
    first = said.groupBy(*page).agg(F.min(F.struct("line_seq", "_fee"))["_fee"].alias("value"))
    return said.join(first, list(page)).filter(F.col("_fee") == F.col("value")).groupBy(*page).agg(F.first("value").alias("value"), F.avg("confidence").alias("confidence"))


def first_new(found: DataFrame, known: DataFrame, keys: Sequence[str] = ("case_id", "field_name", "value"), order: Sequence[str] = ("page_index", "line_seq")) -> DataFrame:
    """The first candidate of each case and field that isn't known already; of equal places the least value."""
    fresh = found.join(known.select(*keys).distinct(), list(keys), "left_anti")
    group = [k for k in keys if k != "value"]
    return fresh.groupBy(*group).agg(F.min_by("value", F.struct(*order, "value")).alias("value"))


def worst_page(lines: DataFrame, most: float = 0.65, low: float = 0.65, least_low: int = 4, least: int = 12) -> DataFrame:
    """(case_id, page_index): of each case the page of least median confidence, if that is under `most` and the page has enough lines and enough of low confidence."""
    per = lines.groupBy(*PAGE).agg(F.median("confidence").alias("m"), F.count(F.when(F.col("confidence") < low, 1)).alias("low"), F.count("*").alias("n"))
    fit = per.filter((F.col("m") < most) & (F.col("low") >= least_low) & (F.col("n") >= least))
    return fit.groupBy("case_id").agg(F.min_by("page_index", F.struct("m", "page_index")).alias("page_index"))


def agreed(first: DataFrame, second: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, field_name, value) that two readings of a case give alike, each with one value, where nothing is known."""
    one = lambda df: df.groupBy("case_id", "field_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo = hi").select("case_id", "field_name", F.col("lo").alias("value"))
    both = one(first).join(one(second), ["case_id", "field_name", "value"])
    return both.join(known.select("case_id", "field_name").distinct(), ["case_id", "field_name"], "left_anti")


def sponsor_conflict(candidates: DataFrame, least: float = 0.9, similar: float = 0.8) -> DataFrame:
    """(case_id, field_name, value): the one sure value of sponsor sentences that differs from the one clean, uncorrected intake value, applicants being alike.

    candidates: case_id, field_name, value, evidence_type, ocr_confidence, clean
    (exact case, legible, live, with applicant), correction, narrative, applicant_hint.
    """
    intake = F.col("clean") & (F.col("evidence_type") == "intake_form")
    sponsor = F.col("clean") & (F.col("evidence_type") == "sponsor_attestation") & F.col("narrative") & (F.col("ocr_confidence") >= least)
    pick = lambda c, w: F.when(w, F.col(c))
    agg = candidates.filter(F.col("field_name").isin("sponsor_id", "visa_class")).groupBy("case_id", "field_name").agg(
        F.min(pick("value", intake)).alias("i_lo"), F.max(pick("value", intake)).alias("i_hi"), F.min(pick("value", sponsor)).alias("s_lo"), F.max(pick("value", sponsor)).alias("s_hi"),
        F.max(F.coalesce(intake & F.col("correction"), F.lit(False))).alias("fixed"), F.collect_set(ocr_key(pick("applicant_hint", intake))).alias("a"), F.collect_set(ocr_key(pick("applicant_hint", sponsor))).alias("b"),
    )
    agg = agg.filter((F.col("i_lo") == F.col("i_hi")) & (F.col("s_lo") == F.col("s_hi")) & (F.col("i_lo") != F.col("s_lo")) & ~F.col("fixed"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([all(x and y and ratio(x, y) >= similar for x in p for y in q) for p, q in zip(a, b, strict=True)], dtype=bool)

    return agg.filter(alike("a", "b")).select("case_id", "field_name", F.col("s_lo").alias("value"))


def stable_swap(before: DataFrame, after: DataFrame, but: str = "applicant_name") -> DataFrame:
    """case_ids for which two sets of (case_id, field_name, value) hold the same values in every field but one."""
    rows = before.filter(F.col("field_name") != but).select("case_id", "field_name", "value", F.lit(1).alias("s")).unionByName(after.filter(F.col("field_name") != but).select("case_id", "field_name", "value", F.lit(2).alias("s"))).distinct()
    odd = rows.groupBy("case_id", "field_name", "value").agg(F.sum("s").alias("s")).filter("s <> 3").select("case_id").distinct()
    return before.select("case_id").union(after.select("case_id")).distinct().join(odd, "case_id", "left_anti")


def supported_exceptions(rules: DataFrame, least: int = 2) -> DataFrame:
    """rule_id and problems of exception rules by their proof.

    Columns: visible, heldout, tuning (arrays of case ids), tuning_split,
    measured_split, candidate_false_approvals, baseline_false_approvals.  A null
    array is empty, a null count 0; equal splits, two nulls among them, are one.
    """
    none = F.array().cast(rules.schema["visible"].dataType)
    visible, heldout, tuning = (F.coalesce(c, none) for c in ("visible", "heldout", "tuning"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    bad = [
        (F.size(visible) == 0, "no_visible_support"),
        (F.size(F.array_distinct(heldout)) < least, "insufficient_heldout_support"),
        (F.size(F.array_except(heldout, visible)) > 0, "heldout_support_not_visible"),
        (F.size(F.array_intersect(heldout, tuning)) > 0, "heldout_support_overlaps_tuning"),
        (F.col("tuning_split").eqNullSafe(F.col("measured_split")), "measured_on_tuning_split"),
        (zero("candidate_false_approvals") > zero("baseline_false_approvals"), "more_false_approvals"),
    ]
    return rules.select("rule_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in bad])).alias("problems"))
