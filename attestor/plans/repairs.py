"""Repair queries, bound to line items and to the cases of the policy view."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.operators import calibration as C
from attestor.operators import heads
from attestor.operators import linking as K
from attestor.operators import repairs as R
from attestor.operators import scoring as S
from attestor.operators.resolve import resolve
from attestor.plans import policy as P
from attestor.plans import scoring as PS
from attestor.plans.evidence import ORACLE as RESOLVE_ORACLE, evidence

# Candidates, in SQL that Spark and DuckDB read alike.
NAME = {
    "case_id": "l_orderkey",
    "value": "CASE WHEN l_quantity > 48 THEN NULL ELSE 'N' || CAST(l_partkey % 3 AS STRING) END",
    "evidence_type": "CASE l_suppkey % 4 WHEN 0 THEN 'biometric_slip' WHEN 1 THEN 'intake_form' WHEN 2 THEN 'sponsor_attestation' ELSE 'registry_extract' END",
    "ocr_confidence": "l_discount * 10",
    "legible": "l_quantity >= 5",
    "superseded": "l_tax > 0.075",
    "bad": "l_partkey % 29 = 0",
    "scope": "CASE WHEN l_partkey % 11 = 0 THEN 'none' WHEN l_partkey % 31 = 0 THEN 'other' ELSE 'same' END",
}
DECISION = NAME | {"value": "CASE l_partkey % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'DENIED' WHEN 2 THEN 'maybe' ELSE 'APPROVED' END", "evidence_type": "CASE l_suppkey % 3 WHEN 0 THEN 'adjudicator_stamp' WHEN 1 THEN 'intake_form' ELSE 'signed_manual_note' END"}


def _view(spark, sf_dir, view):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*[F.expr(e).alias(c) for c, e in view.items()])


def _sql(view, name="n"):
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in view.items()) + " FROM lineitem)"


def h11(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("N"), (F.col("o_custkey") % 3).cast("string")).alias("applicant_name"))
    return R.preferred_name(_view(spark, sf_dir, NAME), now)


def x5(spark, sf_dir):
    rows = _view(spark, sf_dir, DECISION)
    return R.recovered_decision(rows.filter("ocr_confidence >= 0.5 and value <> 'maybe'"), rows.filter("ocr_confidence < 0.5"))


def h5(spark, sf_dir):
    e = evidence(spark, sf_dir)
    one, two = resolve(e.filter("page_index % 2 = 1")), resolve(e.filter("page_index % 2 = 0"))
    return R.overlay(one, two, 0, 1)


def _wide(spark, sf_dir):
    k = F.col("case_id")
    rows = P.assemble(P.cases(spark, sf_dir), "denial_reasons", "review_reasons", "approval_facts", F.col("authoritative").alias("authority"), carry=(("age_days", heads.arrival_age()),))
    return rows.withColumns({"sponsor_second": k % 2 == 0, "visa_second": k % 3 != 0, "applicant_candidates": (k % 8).cast("int"), "explicit_none": k % 2 == 1})


def h7(spark, sf_dir):
    return R.semantic_denials(_wide(spark, sf_dir)).select("case_id", F.array_join("rules", ",").alias("rules"))


def h8_h10(spark, sf_dir):
    return _wide(spark, sf_dir).select("case_id", R.review_approval().alias("review_approval"), R.clean_packet_approval().alias("clean_packet"))


def h14(spark, sf_dir):
    rows = _wide(spark, sf_dir).withColumn("confidence", F.pmod(F.col("case_id"), F.lit(100)) / 100)
    return heads.demote_unknown_fee(rows).select("case_id", "adjudication", F.round("confidence", 9).alias("confidence"))


RULES = [("r1", {"visa": "DIP-1", "fee": "waived"}, "NEEDS_REVIEW"), ("r2", {"fee": "unpaid"}, "DENIED"), ("r3", {}, "NEEDS_REVIEW")]


def a6(spark, sf_dir):
    rows = _wide(spark, sf_dir).select("case_id", F.create_map(F.lit("visa"), F.col("visa_class"), F.lit("fee"), F.col("fee_status")).alias("features"))
    rules = spark.createDataFrame(RULES, "rule_id string, conditions map<string,string>, decision string")
    return R.matching_exceptions(rows, rules).select("case_id", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join("decisions", ",").alias("decisions"))


def c6(spark, sf_dir):
    stats = C.fit_semantic(P._samples(spark, sf_dir))
    broken = stats.filter("level <> 'decision' or key <> 'DENIED'")
    return R.inconsistent_statistics(broken)


def e2(spark, sf_dir):
    """Truth read with repeats: the last row of an id counts."""
    rows = PS._orders(spark, sf_dir, PS.TRUTH | {"seq": "o_orderkey"})
    again = PS._orders(spark, sf_dir, PS.TRUTH | {"seq": "o_orderkey + 10000000", "adjudication": "'DENIED'"}, "o_orderkey % 7 = 0")
    return S.first_per_id(rows.unionByName(again), "seq", last=True).select("case_id", "adjudication", "copies")


def d5(spark, sf_dir):
    return PS.outcomes(spark, sf_dir, PS.scores(spark, sf_dir, PS.LABELS))


_ok = "legible AND NOT superseded"
_u = lambda c, w: f"count(DISTINCT CASE WHEN {w} THEN {c} END)"
_mx = lambda w, c="ocr_confidence": f"max(CASE WHEN {w} THEN {c} END)"
_b, _i = f"evidence_type = 'biometric_slip' AND ocr_confidence >= 0.8 AND {_ok} AND scope = 'same'", f"evidence_type = 'intake_form' AND {_ok} AND scope = 'same'"
_use = f"({_ok} AND NOT bad AND scope IN ('same', 'none') AND value IS NOT NULL)"
_p = f"evidence_type IN ('sponsor_attestation', 'registry_extract') AND ocr_confidence >= 0.85 AND {_use}"
_in = f"evidence_type = 'intake_form' AND {_use}"
_live = f"({_ok} AND NOT bad AND scope = 'same' AND value IN ('APPROVED', 'DENIED', 'NEEDS_REVIEW'))"
_fit = f"{_live} AND evidence_type = 'intake_form' AND value IN ('APPROVED', 'DENIED') AND ocr_confidence >= 0.85"
_on = lambda where: "(" + RESOLVE_ORACLE["r9_resolve"].replace("FROM lineitem", f"FROM lineitem WHERE {where}") + ")"
_WIDE = f"""{P.POLICY_SQL}, am AS ({P._assemble_sql()}), ag AS (SELECT case_id, CASE WHEN arrival_date_state = 'resolved' THEN date_diff('day', CAST(arrival_date_value AS DATE), DATE '2026-07-07') END AS age FROM cs),
w AS (SELECT am.*, dec.* EXCLUDE (case_id), ag.age FROM am JOIN dec USING (case_id) JOIN ag USING (case_id))"""
_dq = "(" + ", ".join(f"'{x}'" for x in vocab.DISQUALIFYING_FLAGS) + ")"
_parse = "[replace(lower(trim(p)), ' ', '_') FOR p IN string_split(risk_flags, '|')]"

QUERIES = {
    "h3_biometric_name": lambda s, d: R.biometric_name(_view(s, d, NAME)),
    "h11_preferred_name": h11,
    "a9_orphan_finding": lambda s, d: R.orphan_finding(_view(s, d, DECISION)),
    "x5_recovered_decision": x5,
    "x16_risk_majority": lambda s, d: K.majority(_view(s, d, {"case_id": "l_orderkey", "field_name": "'risk_flags'", "value": "CASE WHEN l_tax > 0.04 THEN NULL ELSE l_returnflag END"}), 2),
    "h5_second_overlay": h5,
    "h7_semantic_denial": h7,
    "h8_h10_approval_heads": h8_h10,
    "h14_fee_demotion": h14,
    "a6_exceptions": a6,
    "c6_c11_statistics_check": c6,
    "e2_truth_index": e2,
    "d5_case_outcomes": d5,
}
ORACLE = {
    "h3_biometric_name": f"""WITH {_sql(NAME)}, g AS (SELECT case_id, bool_or(evidence_type IN ('biometric_slip', 'intake_form') AND value IS NOT NULL AND (scope = 'other' OR bad)) AS spoilt, {_u("value", _b)} AS nb, {_u("value", _i)} AS ni, {_mx(_b, "value")} AS vb, {_mx(_i, "value")} AS vi,
  {_mx(_b + " AND value IS NOT NULL")} AS cb, {_mx(_i + " AND value IS NOT NULL")} AS ci FROM n GROUP BY 1) SELECT case_id, vb AS value FROM g WHERE NOT spoilt AND nb = 1 AND ni = 1 AND vb <> vi AND cb >= ci""",
    "h11_preferred_name": f"""WITH {_sql(NAME)}, g AS (SELECT case_id, {_u("value", _p)} AS np, {_mx(_p, "value")} AS vp, {_mx(_p)} AS cp, {_mx(_in)} AS ci FROM n GROUP BY 1)
SELECT g.case_id, vp AS value FROM g JOIN orders ON o_orderkey = case_id WHERE np = 1 AND vp <> 'N' || CAST(o_custkey % 3 AS VARCHAR) AND (ci IS NULL OR cp >= ci + 0.05::DOUBLE) AND NOT EXISTS (SELECT 1 FROM n WHERE n.case_id = g.case_id AND {_in} AND n.value = vp)""",
    "a9_orphan_finding": f"WITH {_sql(DECISION)} SELECT case_id, {_mx(_fit, 'value')} AS value FROM n GROUP BY 1 HAVING count(CASE WHEN {_fit} THEN 1 END) = 1 AND {_u('value', _live)} = 1",
    "x5_recovered_decision": f"WITH {_sql(DECISION)} SELECT case_id, max(value) AS value FROM n WHERE ocr_confidence >= 0.5 AND value <> 'maybe' AND case_id NOT IN (SELECT case_id FROM n WHERE ocr_confidence < 0.5 AND {_ok} AND evidence_type <> 'intake_form') GROUP BY 1 HAVING count(DISTINCT value) = 1",
    "x16_risk_majority": "SELECT l_orderkey AS case_id, 'risk_flags' AS field_name, max(l_returnflag) AS value, count(*) AS votes FROM lineitem WHERE l_tax <= 0.04 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_returnflag) = 1",
    "h5_second_overlay": f"""WITH a AS {_on("l_linenumber % 2 = 1")}, b AS {_on("l_linenumber % 2 = 0")}, j AS (SELECT a.*, CASE WHEN b.state = 'resolved' THEN b.value END AS v2 FROM a LEFT JOIN b ON a.case_id = b.case_id AND a.field_name = b.field_name)
SELECT case_id, field_name, CASE WHEN state = 'unknown' AND v2 IS NOT NULL THEN v2 ELSE value END AS value, state = 'unknown' AND v2 IS NOT NULL AS recovered FROM j""",
    "h7_semantic_denial": f"""WITH {_WIDE} SELECT case_id, array_to_string([x FOR x IN [CASE WHEN len([f FOR f IN {_parse} IF f IN {_dq}]) > 0 THEN 'disqualifying_risk' END, CASE WHEN home_world IN ('Eris Relay', 'TRAPPIST-1e') THEN 'absolute_embargo' END,
  CASE WHEN home_world = 'Wolf-1061c' AND visa_class <> 'DIP-1' THEN 'non_diplomatic_embargo' END, CASE WHEN sponsor_id IN {P._in(vocab.BARRED_SPONSORS)} AND case_id % 2 = 0 AND case_id % 3 <> 0 AND visa_class <> 'DIP-1' THEN 'barred_sponsor' END] IF x IS NOT NULL], ',') AS rules FROM w""",
    "h8_h10_approval_heads": f"""WITH {_WIDE}, r AS (SELECT *, [x FOR x IN review_reasons IF x NOT IN ('clean_biohazard_check_missing', 'required_output_unknown:biohazard_check')] AS left_over FROM w)
SELECT case_id, coalesce(adjudication = 'NEEDS_REVIEW' AND lower(risk_flags) = 'none' AND NOT authoritative AND (case_id % 8 > 5 OR coalesce(age > 71, false) AND list_contains(approval_facts, 'no_visible_biohazard_risk') OR coalesce(age <= 48, false) AND list_contains(review_reasons, 'required_sponsor_unknown')), false) AS review_approval,
  adjudication = 'NEEDS_REVIEW' AND lower(risk_flags) = 'none' AND visa_class <> 'TRANSIT-7' AND len(denial_reasons) = 0 AND (fee_status = 'paid' AND list_contains(approval_facts, 'fee_paid') OR fee_status = 'waived' AND list_contains(approval_facts, 'valid_fee_waiver')) AND case_id % 2 = 1 AND len(left_over) = 0 AS clean_packet FROM r""",
    "h14_fee_demotion": f"""WITH {_WIDE}, p AS (SELECT *, (case_id % 100) / 100.0::DOUBLE AS p, adjudication = 'APPROVED' AND fee_status = 'unknown' AS hit FROM w)
SELECT case_id, CASE WHEN hit THEN 'NEEDS_REVIEW' ELSE adjudication END AS adjudication, round(CASE WHEN hit THEN least(p, 0.45) ELSE p END, 9) AS confidence FROM p""",
    "a6_exceptions": f"""WITH {_WIDE}, h AS (SELECT case_id, 'r1' AS id, 'NEEDS_REVIEW' AS d FROM w WHERE visa_class = 'DIP-1' AND fee_status = 'waived' UNION ALL SELECT case_id, 'r2', 'DENIED' FROM w WHERE fee_status = 'unpaid' UNION ALL SELECT case_id, 'r3', 'NEEDS_REVIEW' FROM w)
SELECT case_id, string_agg(id, ',' ORDER BY id) AS rule_ids, string_agg(DISTINCT d, ',' ORDER BY d) AS decisions FROM h GROUP BY 1""",
    "c6_c11_statistics_check": "SELECT 'decision' AS level, '' AS key, 'sum' AS problem",
    "e2_truth_index": f"""WITH t AS ({PS._select(PS.TRUTH | {"seq": "o_orderkey"})} UNION ALL {PS._select(PS.TRUTH | {"seq": "o_orderkey + 10000000", "adjudication": "'DENIED'"}, "o_orderkey % 7 = 0")})
SELECT case_id, arg_max(adjudication, seq) AS adjudication, count(*) AS copies FROM t GROUP BY 1""",
    "d5_case_outcomes": f"WITH {PS.SCORES}, {PS.OUTCOMES} SELECT * FROM oc",
}
