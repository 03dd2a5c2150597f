"""Recovery heads: overrides of reviews, as rows of rules that can be switched off one by one."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.functions.text import iso_date

# Confidences that a head gives.
DENIAL_CONFIDENCE, APPROVAL_CONFIDENCE = 0.551819438046983, 0.98


def arrival_age() -> Column:
    """Days from the arrival date of a wide case to the snapshot; null if unknown."""
    value = F.when(F.col("arrival_date")["state"] == "resolved", F.col("arrival_date")["value"])
    return F.datediff(F.lit(vocab.SNAPSHOT_DATE).cast("date"), iso_date(F.when(value != "1900-01-01", value)))


def _has(array: str, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.array_contains(array, n)
    return out


def _p(most: float) -> Column:
    return F.col("confidence") <= most


# Names of the rules, their thresholds, and the reasons that they look for.
#: name: condition over confidence, age_days, visa_class, fee_pages, sponsor_page, other_page and the reasons.
DENIALS = {
    "review_denial_other_missing_biohazard": lambda: _p(0.35) & _has("review_reasons", "clean_biohazard_check_missing") & F.col("other_page"),
    "review_denial_sponsor_stale_gt365": lambda: _p(0.35) & (F.col("age_days") > 365) & F.col("sponsor_page"),
    "review_denial_three_required_outputs_unknown": lambda: _has("review_reasons", *[f"required_output_unknown:{f}" for f in ("home_world", "risk_flags", "sponsor_id")]),
}
APPROVALS = {
    "review_diplomatic_fee_receipt_recovery": lambda: _p(0.25) & (F.col("fee_pages") == 1) & _has("approval_facts", "diplomatic_sponsor_exemption"),
    "review_approval_sponsor_attestation_xw1": lambda: _p(0.2) & (F.col("visa_class") == "XW-1") & F.col("sponsor_page"),
    "review_approval_current_application_visa_unknown": lambda: (F.col("confidence") > 0.2) & _p(0.25) & _has("approval_facts", "application_date_current_or_exempt") & _has("review_reasons", "visa_class_unknown"),
    "review_approval_current_application_home_world_unknown": lambda: _p(0.35) & _has("approval_facts", "application_date_current_or_exempt") & _has("review_reasons", "required_output_unknown:home_world") & ~_has("review_reasons", "unsupported_fee_waiver"),
}


def recover(rows: DataFrame, off: Collection[str] = ()) -> DataFrame:
    """rows with decision, confidence and rules (those that matched): of reviews only; a denial rule wins, an approval rule never undoes a denial reason."""
    match = lambda rules: F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c(), F.lit(False)), n) for n, c in rules.items() if n not in off])))
    review, none = F.col("decision") == "NEEDS_REVIEW", F.array().cast("array<string>")
    rows = rows.withColumn("_dn", F.when(review, match(DENIALS)).otherwise(none))
    rows = rows.withColumn("_ap", F.when(review & (F.size("denial_reasons") == 0), match(APPROVALS)).otherwise(none))
    deny, approve = F.size("_dn") > 0, F.size("_ap") > 0
    return rows.withColumns(
        {
            "decision": F.when(deny, "DENIED").when(approve, "APPROVED").otherwise(F.col("decision")),
            "confidence": F.when(deny, DENIAL_CONFIDENCE).when(approve, APPROVAL_CONFIDENCE).otherwise(F.col("confidence")),
            "rules": F.when(deny, F.col("_dn")).otherwise(F.col("_ap")),
        }
    ).drop("_dn", "_ap")


def demote_unknown_fee(rows: DataFrame) -> DataFrame:
    """Approvals whose row says that the fee is unknown go back to review, with a confidence of .45 at most."""
    hit = F.coalesce((F.col("adjudication") == "APPROVED") & (F.col("fee_status") == "unknown"), F.lit(False))
    return rows.withColumns({"adjudication": F.when(hit, "NEEDS_REVIEW").otherwise(F.col("adjudication")), "confidence": F.when(hit, F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence"))})
