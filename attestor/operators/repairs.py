"""Narrow repairs from clean, unanimous evidence, and overlays of a second reading.

Candidates have case_id, value, evidence_type, ocr_confidence, legible,
superseded, bad (a struck or watermarked cue) and scope: same, none or other by
the case that the page names.  Each repair is one conditional aggregation by
case; unanimity is least = greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import vocab


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _group(prefix: str, cond: Column) -> list[Column]:
    v = F.when(cond, F.col("value"))
    return [F.min(v).alias(f"{prefix}_lo"), F.max(v).alias(f"{prefix}_hi"), F.max(F.when(cond, F.col("ocr_confidence"))).alias(f"{prefix}_c"), F.count(v).alias(f"{prefix}_n")]


def _one(prefix: str) -> Column:
    return _t(F.col(f"{prefix}_lo") == F.col(f"{prefix}_hi"))


def biometric_name(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(case_id, value): the one biometric name that differs from the one intake name and is no less sure; nothing where any of them is out of scope or marked."""
    kind = F.col("evidence_type")
    ours = kind.isin("biometric_slip", "intake_form") & F.col("value").isNotNull()
    use = ours & _t(F.col("legible") & ~F.col("superseded")) & (F.col("scope") == "same")
    agg = names.groupBy("case_id").agg(
        F.max(_t(ours & ((F.col("scope") == "other") | F.col("bad")))).alias("spoilt"), *_group("b", use & (kind == "biometric_slip") & (F.col("ocr_confidence") >= least)), *_group("i", use & (kind == "intake_form"))
    )
    return agg.filter(~F.col("spoilt") & _one("b") & _one("i") & (F.col("b_lo") != F.col("i_lo")) & (F.col("b_c") >= F.col("i_c"))).select("case_id", F.col("b_lo").alias("value"))


def preferred_name(names: DataFrame, current: DataFrame, least: float = 0.85, lead: float = 0.05) -> DataFrame:
    """(case_id, value): the one sponsor or registry name that is neither the current name nor an intake's, and leads the intakes' confidence."""
    kind = F.col("evidence_type")
    use = _t(F.col("legible") & ~F.col("superseded") & ~F.col("bad") & F.col("scope").isin("same", "none")) & F.col("value").isNotNull()
    agg = names.groupBy("case_id").agg(*_group("p", use & kind.isin("sponsor_attestation", "registry_extract") & (F.col("ocr_confidence") >= least)), *_group("i", use & (kind == "intake_form")), F.collect_set(F.when(use & (kind == "intake_form"), F.col("value"))).alias("intakes"))
    rows = agg.filter(_one("p") & ~F.array_contains("intakes", F.col("p_lo")) & (F.col("i_c").isNull() | (F.col("p_c") >= F.col("i_c") + lead)))
    return rows.join(current.select("case_id", F.col("applicant_name").alias("_now")), "case_id").filter(~F.col("_now").eqNullSafe(F.col("p_lo"))).select("case_id", F.col("p_lo").alias("value"))


def orphan_finding(decisions: DataFrame, least: float = 0.85) -> DataFrame:
    """(case_id, value): the one sure intake-typed approval or denial where all live decisions of the case agree."""
    live = _t(F.col("legible") & ~F.col("superseded") & ~F.col("bad") & (F.col("scope") == "same") & F.col("value").isin(vocab.DECISIONS))
    fit = live & (F.col("evidence_type") == "intake_form") & F.col("value").isin("APPROVED", "DENIED") & (F.col("ocr_confidence") >= least)
    agg = decisions.groupBy("case_id").agg(*_group("l", live), *_group("e", fit))
    return agg.filter((F.col("e_n") == 1) & _one("l")).select("case_id", F.col("e_lo").alias("value"))


def recovered_decision(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, value): unanimous signals of cases without a live authoritative decision."""
    agg = signals.filter("value is not null").groupBy("case_id").agg(*_group("s", F.lit(True)))
    live = evidence.filter(_t(F.col("legible") & ~F.col("superseded")) & F.col("evidence_type").isin("adjudicator_stamp", "signed_manual_note")).select("case_id")
    return agg.filter(_one("s")).join(live, "case_id", "left_anti").select("case_id", F.col("s_lo").alias("value"))


def overlay(primary: DataFrame, second: DataFrame, fee_field="fee_status", risk_field="risk_flags") -> DataFrame:
    """primary (case_id, field_name, state, value) with the second reading's values where its own are unknown; never an unknown fee, nor 'none' for risk."""
    s = second.filter("state = 'resolved'").select("case_id", "field_name", F.col("value").alias("_v"))
    out = primary.join(s, ["case_id", "field_name"], "left")
    take = (F.col("state") == "unknown") & F.col("_v").isNotNull() & ~((F.col("field_name") == F.lit(fee_field)) & (F.col("_v") == "unknown")) & ~((F.col("field_name") == F.lit(risk_field)) & (F.col("_v") == "none"))
    return out.select("case_id", "field_name", F.when(take, F.col("_v")).otherwise(F.col("value")).alias("value"), _t(take).alias("recovered"))


def semantic_denials(values: DataFrame) -> DataFrame:
    """values with rules: denials that follow from recovered values (risk_flags, home_world, visa_class, sponsor_id; the last two rules' sponsor must be of the second reading: sponsor_second, visa_second)."""
    from attestor.functions.text import split_flags

    c = F.col
    barred = c("sponsor_id").isin(vocab.BARRED_SPONSORS) & c("sponsor_second") & c("visa_second") & (c("visa_class") != "DIP-1")
    rules = [
        (F.arrays_overlap(split_flags(c("risk_flags")), F.array(*[F.lit(x) for x in vocab.DISQUALIFYING_FLAGS])), "disqualifying_risk"),
        (c("home_world").isin(vocab.EMBARGOED_WORLDS), "absolute_embargo"),
        (c("home_world").isin(vocab.NON_DIPLOMATIC_EMBARGOED_WORLDS) & (c("visa_class") != "DIP-1"), "non_diplomatic_embargo"),
        (barred, "barred_sponsor"),
    ]
    return values.withColumn("rules", F.array_compact(F.array(*[F.when(_t(k), F.lit(n)) for k, n in rules])))


def review_approval() -> Column:
    """Whether a review without authority and with no risk is approved: many applicant candidates, or by age and one fact or reason."""
    c = F.col
    base = (c("adjudication") == "NEEDS_REVIEW") & (F.lower(F.trim("risk_flags")) == "none") & ~c("authority")
    why = (c("applicant_candidates") > 5) | ((c("age_days") > 71) & F.array_contains("approval_facts", "no_visible_biohazard_risk")) | ((c("age_days") <= 48) & F.array_contains("review_reasons", "required_sponsor_unknown"))
    return _t(base & why)


def clean_packet_approval() -> Column:
    """Whether a review is approved as fee and risk are proven by visible evidence and nothing but the biohazard check is open."""
    c = F.col
    open_ = F.array_except("review_reasons", F.array(F.lit("clean_biohazard_check_missing"), F.lit("required_output_unknown:biohazard_check")))
    fee = ((c("fee_status") == "paid") & F.array_contains("approval_facts", "fee_paid")) | ((c("fee_status") == "waived") & F.array_contains("approval_facts", "valid_fee_waiver"))
    return _t((c("adjudication") == "NEEDS_REVIEW") & (F.lower(F.trim("risk_flags")) == "none") & (c("visa_class") != "TRANSIT-7") & (F.size("denial_reasons") == 0) & fee & c("explicit_none") & (F.size(open_) == 0))


def matching_exceptions(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, rule_ids, decisions): rules all of whose conditions (a map) equal the case's features (a map).  Rules are a pinned, small artifact."""
    hit = F.forall(F.map_entries("conditions"), lambda e: F.try_element_at("features", e["key"]).eqNullSafe(e["value"]))
    both = features.join(F.broadcast(rules), hit)
    return both.groupBy("case_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.array_sort(F.collect_set("decision")).alias("decisions"))


def inconsistent_statistics(stats: DataFrame) -> DataFrame:
    """Rows of (level, key, correct, total) that are no counts, and parents whose children don't add up; sound statistics give none."""
    bad = stats.filter(~_t((F.col("correct") >= 0) & (F.col("correct") <= F.col("total")) & (F.col("total") > 0))).select("level", "key", F.lit("count").alias("problem"))
    whole = stats.filter("level = 'global'").agg(F.sum("correct").alias("gc"), F.sum("total").alias("gt"))
    sums = stats.filter("level <> 'global'").groupBy("level").agg(F.sum("correct").alias("c"), F.sum("total").alias("t"))
    off = sums.crossJoin(F.broadcast(whole)).filter("c <> gc or t <> gt")  # one row
    return bad.unionByName(off.select("level", F.lit("").alias("key"), F.lit("sum").alias("problem")))
