"""Scoring, report, split and gate queries, bound to orders (truth and predictions), labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.operators import calibration as C
from attestor.operators import scoring as S

# Views in SQL that Spark and DuckDB read alike.
TRUTH = {
    "case_id": "'MIB-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')",
    "adjudication": "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'DENIED' ELSE 'NEEDS_REVIEW' END",
    "unrecoverable_fields": "CASE WHEN o_orderkey % 5 = 0 THEN 'Home_World | fee_status' WHEN o_orderkey % 7 = 0 THEN 'none' ELSE '' END",
    "difficulty": "CASE WHEN o_orderkey % 13 = 0 THEN 'Golden' WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END",
    "damage_profile": "CASE o_custkey % 4 WHEN 0 THEN 'stain' WHEN 1 THEN '' ELSE 'fold' END",
    "traps": "CASE WHEN o_custkey % 6 = 0 THEN 'qr | bait' WHEN o_custkey % 6 = 1 THEN ' | ' ELSE '' END",
    "applicant_name": "'  Zed   ' || CAST(o_custkey AS STRING)",
    "species_code": "CASE WHEN o_custkey % 2 = 0 THEN 'ORION_GRAYS' ELSE 'TRIANGULAN' END",
    "home_world": "'Kepler-186f'",
    "visa_class": "'XW-' || CAST(1 + o_custkey % 2 AS STRING)",
    "sponsor_id": "'SPN-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')",
    "arrival_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "declared_purpose": "o_orderpriority",
    "risk_flags": "CASE o_orderkey % 4 WHEN 0 THEN 'b_flag| a_flag' WHEN 1 THEN 'NONE' ELSE '' END",
    "fee_status": "'paid'",
}
PRED = {
    "case_id": "CASE WHEN o_orderkey % 29 = 0 THEN '  ' ELSE ' MIB-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') END",
    "seq": "o_orderkey",
    "adjudication": "CASE o_orderkey % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'denied' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'maybe' END",
    "confidence": "CASE WHEN o_orderkey % 31 = 0 THEN 'high' ELSE CAST((o_custkey % 130) / 100.0E0 AS STRING) END",
    "applicant_name": "CASE WHEN o_custkey % 3 = 0 THEN 'zed ' || CAST(o_custkey AS STRING) ELSE 'Zod' END",
    "species_code": "'orion_grays'",
    "home_world": "CASE WHEN o_custkey % 2 = 0 THEN 'kepler-186F' ELSE 'unknown' END",
    "visa_class": "'XW-1'",
    "sponsor_id": "'SPN-' || lpad(CAST(o_custkey % 10007 AS STRING), 4, '0')",
    "arrival_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "declared_purpose": "lower(o_orderpriority)",
    "risk_flags": "CASE o_orderkey % 3 WHEN 0 THEN 'A_FLAG |b_flag' ELSE 'unknown' END",
    "fee_status": "CASE o_orderkey % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'free' ELSE 'waived' END",
}


def _orders(spark, sf_dir, view, where="true"):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter(where).select(*[F.expr(e).alias(c) for c, e in view.items()])


def truth(spark, sf_dir):
    return _orders(spark, sf_dir, TRUTH)


def submitted(spark, sf_dir):
    """Predictions as handed in: some cases missing, some ids blank, some twice."""
    rows = _orders(spark, sf_dir, PRED, "o_orderkey % 17 <> 0")
    again = _orders(spark, sf_dir, PRED | {"seq": "o_orderkey + 10000000", "adjudication": "'APPROVED'"}, "o_orderkey % 23 = 0 AND o_orderkey % 17 <> 0")
    return rows.unionByName(again)


def predictions(spark, sf_dir):
    return S.first_per_id(submitted(spark, sf_dir), "seq")


def _select(view, where="true"):
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in view.items()) + f" FROM orders WHERE {where}"


_norm = lambda c: f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
_flags = lambda c: f"CASE WHEN {_norm(c)} IN ('', 'none', 'null', 'unknown') THEN 'none' ELSE array_to_string(list_sort([trim(p) FOR p IN string_split({_norm(c)}, '|') IF trim(p) <> '']), '|') END"
_match = lambda f: f"({_flags('t.' + f)} = {_flags('p.' + f)})" if f == "risk_flags" else f"({_norm('t.' + f)} = {_norm('p.' + f)})"
_ok = lambda f: f"NOT list_contains(lost, '{f}')"
W = vocab.FIELD_WEIGHTS
SCORES = f"""
t0 AS ({_select(TRUTH)}), t AS (SELECT *, [trim(x) FOR x IN string_split({_norm("unrecoverable_fields")}, '|')] AS lost FROM t0),
s0 AS ({_select(PRED, "o_orderkey % 17 <> 0")} UNION ALL {_select(PRED | {"seq": "o_orderkey + 10000000", "adjudication": "'APPROVED'"}, "o_orderkey % 23 = 0 AND o_orderkey % 17 <> 0")}),
p AS (SELECT * EXCLUDE (case_id, rn), trim(case_id) AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY trim(case_id) ORDER BY seq) AS rn FROM s0) WHERE rn = 1 AND trim(case_id) <> ''),
j AS (SELECT t.case_id, p.case_id IS NOT NULL AS present, upper(trim(t.adjudication)) AS ta, upper(trim(coalesce(p.adjudication, ''))) AS pa, t.difficulty, t.damage_profile, t.traps, p.fee_status AS pf,
  CASE WHEN p.case_id IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(p.confidence AS DOUBLE) END AS cf,
  {" + ".join(f"CASE WHEN {_ok(f)} AND p.case_id IS NOT NULL AND {_match(f)} THEN {W[f]} ELSE 0 END" for f in W)} AS extraction_raw,
  {" + ".join(f"CASE WHEN {_ok(f)} THEN {W[f]} ELSE 0 END" for f in W)} AS extraction_max_raw,
  {", ".join(f"{_ok(f)} AND p.case_id IS NOT NULL AND {_match(f)} AS hit_{f}, {_ok(f)} AS can_{f}" for f in W)}
  FROM t LEFT JOIN p ON t.case_id = p.case_id),
sc AS (SELECT *, CASE WHEN NOT present THEN 'missing_case' WHEN pa NOT IN ('APPROVED', 'DENIED', 'NEEDS_REVIEW') THEN 'invalid_or_blank' WHEN ta = pa THEN 'correct'
    WHEN ta = 'DENIED' AND pa = 'APPROVED' THEN 'catastrophic_false_approval' WHEN pa = 'NEEDS_REVIEW' THEN 'conservative_review' WHEN ta = 'NEEDS_REVIEW' THEN 'missed_review' ELSE 'wrong_decision' END AS reason,
  coalesce(cf BETWEEN 0 AND 1, false) AS cok FROM j),
scores AS (SELECT case_id, present, ta AS truth_adjudication, CASE WHEN present THEN pa ELSE 'MISSING' END AS pred_adjudication, CAST(extraction_raw AS INT) AS extraction_raw, CAST(extraction_max_raw AS INT) AS extraction_max_raw,
  CASE reason WHEN 'correct' THEN 8.0 WHEN 'catastrophic_false_approval' THEN -4.0 WHEN 'conservative_review' THEN 2.0 WHEN 'missed_review' THEN 1.0 ELSE 0.0 END::DOUBLE AS classification_raw, reason AS classification_reason,
  reason = 'catastrophic_false_approval' AS catastrophic, CASE WHEN present THEN pa IN ('APPROVED', 'DENIED', 'NEEDS_REVIEW') END AS adjudication_valid, CASE WHEN present THEN cok END AS confidence_valid,
  CASE WHEN present THEN CASE WHEN cok THEN (cf - CASE WHEN ta = pa THEN 1.0 ELSE 0.0 END) * (cf - CASE WHEN ta = pa THEN 1.0 ELSE 0.0 END) ELSE 1.0 END END::DOUBLE AS brier,
  CASE WHEN present THEN trim(pf) IN ('paid', 'waived', 'unpaid', 'unknown') END AS fee_valid FROM sc)"""

SUMMARY = """sm AS (SELECT 50 * sum(extraction_raw)::DOUBLE / sum(extraction_max_raw) AS extraction, 80 * sum(classification_raw) / (8.0 * count(*)) AS classification,
  20 * greatest(0.0, 1 - 2 * avg(brier)) AS calibration, 10 * count(CASE WHEN NOT present THEN 1 END)::DOUBLE / count(*) AS missing_penalty, count(CASE WHEN catastrophic THEN 1 END) AS catastrophic_false_approvals,
  count(CASE WHEN NOT present THEN 1 END) AS missing_rows, count(CASE WHEN NOT adjudication_valid THEN 1 END) AS invalid_adjudications, count(CASE WHEN NOT confidence_valid THEN 1 END) AS invalid_confidences,
  count(CASE WHEN NOT fee_valid THEN 1 END) AS invalid_fees FROM scores)"""
OUTCOMES = f"""oc AS (SELECT case_id, reason = 'correct' AS correct, case_id IN (SELECT {TRUTH["case_id"]} FROM orders WHERE o_orderkey % 101 = 0) OR coalesce(lower(difficulty) = 'golden', false) AS golden,
  case_id IN (SELECT {TRUTH["case_id"]} FROM orders WHERE o_orderkey % 103 = 0) OR len([x FOR x IN string_split(coalesce(traps, ''), '|') IF trim(x) <> '']) > 0 AS adversarial, reason AS classification_reason FROM sc)"""
SECTIONS = ("extraction", "classification", "calibration", "missing_penalty", "total")


LABELS = ("difficulty", "damage_profile", "traps")


def scores(spark, sf_dir, keep=()):
    return S.score_cases(truth(spark, sf_dir), predictions(spark, sf_dir), keep)


def e5_e8(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("brier", F.round("brier", 9))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in SECTIONS else c for c in df.columns])


def e9_summary(spark, sf_dir):
    return _rounded(S.summary(scores(spark, sf_dir)))


def e1_index(spark, sf_dir):
    return predictions(spark, sf_dir).select("case_id", "adjudication", "copies")


def e4_extras(spark, sf_dir):
    """Ids handed in without a truth case (of even order keys only)."""
    known = _orders(spark, sf_dir, TRUTH, "o_orderkey % 2 = 0")
    return predictions(spark, sf_dir).join(known, "case_id", "left_anti").select("case_id")


def d3_rates(spark, sf_dir):
    return S.field_rates(truth(spark, sf_dir), predictions(spark, sf_dir))


def d4_groups(spark, sf_dir):
    return S.error_groups(scores(spark, sf_dir, LABELS), "classification_reason", *LABELS)


def _baseline(spark, sf_dir):
    """Another submission: all reviews."""
    return S.score_cases(truth(spark, sf_dir), predictions(spark, sf_dir).withColumn("adjudication", F.lit("NEEDS_REVIEW")), LABELS)


def listed(spark, sf_dir):
    """Golden and adversarial cases that a list names."""
    return _orders(spark, sf_dir, {"case_id": TRUTH["case_id"], "golden": "o_orderkey % 101 = 0", "adversarial": "o_orderkey % 103 = 0"}, "o_orderkey % 101 = 0 OR o_orderkey % 103 = 0")


def outcomes(spark, sf_dir, scored):
    return S.outcomes(scored, listed(spark, sf_dir))


#: Reports of the gate's cases: what the candidate's says of its measurement, and which cases it covers.
GATES = {
    "sound": ("'release'", "true", "12.5", "300.0", "'offline_run'", "0", "true"),
    "dishonest": ("'tuning'", "false", "12.5", "300.0", "'offline_run'", "2", "true"),
    "unmeasured": ("'release'", "true", "CAST(NULL AS DOUBLE)", "0.0", "'official_evaluator_process_only'", "0", "case_id <> 'MIB-000001'"),
}
_REPORT = ("split_name", "honest_holdout", "runtime_seconds", "peak_memory_mib", "source", "leakage_findings")


def d8_gate(spark, sf_dir):
    base, now = _baseline(spark, sf_dir), scores(spark, sf_dir, LABELS)
    out = None
    for name, told in GATES.items():
        told_of = lambda scored, told: S.summary(scored).withColumns({c: F.expr(e) for c, e in zip(_REPORT, told, strict=False)})
        row = S.gate(told_of(base, GATES["sound"]), told_of(now, told), outcomes(spark, sf_dir, base), outcomes(spark, sf_dir, now).filter(told[-1]))
        row = row.select(F.lit(name).alias("name"), *[F.round(c, 6).alias(c) if c.endswith("_delta") else c for c in row.columns])
        out = row if out is None else out.unionByName(row)
    return out


def d9_regressions(spark, sf_dir):
    return S.regressions(outcomes(spark, sf_dir, _baseline(spark, sf_dir)), outcomes(spark, sf_dir, scores(spark, sf_dir, LABELS)))


def f8_validator(spark, sf_dir):
    bad = S.invalid_rows(submitted(spark, sf_dir))
    return bad.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n"))


_F8 = [
    ("NOT regexp_full_match(case_id, 'MIB-[0-9]{6}')", "case_id: pattern"),
    ("NOT regexp_full_match(sponsor_id, 'SPN-[0-9]{4}')", "sponsor_id: pattern"),
    ("fee_status NOT IN ('paid', 'waived', 'unpaid', 'unknown')", "fee_status: value"),
    ("adjudication NOT IN ('APPROVED', 'DENIED', 'NEEDS_REVIEW')", "adjudication: value"),
    ("NOT coalesce(TRY_CAST(confidence AS DOUBLE) BETWEEN 0 AND 1, false)", "confidence: not in [0, 1]"),
]


def d1_split(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("string").alias("stratum"), (F.col("doc_id") % 50 == 0).alias("forced"))
    return S.stratified_split(rows, "2026", id_col="doc_id", stratum="stratum", forced="forced")


_SPLIT = """k AS (SELECT doc_id, CAST(quality AS VARCHAR) AS stratum, doc_id % 50 = 0 AS forced, sha256('2026'::BLOB || '\\x00'::BLOB || CAST(doc_id AS VARCHAR)::BLOB) AS h FROM labels),
r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, sum(forced::INT) OVER (PARTITION BY stratum) AS f, row_number() OVER (PARTITION BY stratum, forced ORDER BY h) AS rk FROM k),
sp AS (SELECT doc_id, stratum, CASE WHEN forced OR rk <= greatest(0, round_even(n * 0.7, 0) - f) THEN 'tuning' WHEN rk <= greatest(0, round_even(n * 0.7, 0) - f) + round_even(n * 0.15, 0) THEN 'calibration' ELSE 'release' END AS role FROM r)"""


def d2_overlaps(spark, sf_dir):
    one = d1_split(spark, sf_dir)
    other = one.withColumn("role", F.when(F.col("doc_id") % 7 == 0, "release").otherwise(F.col("role")))
    return S.overlaps(one.unionByName(other).distinct(), "doc_id")


SIGNAL = {"raw_signal": "round(least(value / 500.0E0, 1.0E0), 1)", "correct": "event_type IN ('click', 'purchase')"}


def _signals(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *[F.expr(e).alias(c) for c, e in SIGNAL.items()])


def c9_fit(spark, sf_dir):
    return C.fit_isotonic(_signals(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


def c5_apply(spark, sf_dir):
    rows = _signals(spark, sf_dir)
    return C.apply_isotonic(rows, C.fit_isotonic(rows)).select("event_id", F.round("probability", 9).alias("probability"))


_ISO = f"""g AS (SELECT {SIGNAL["raw_signal"]} AS x, sum(({SIGNAL["correct"]})::INT) AS c, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT a.x AS lo, b.x AS hi, sum(g.c) / sum(g.n) AS mean FROM g a JOIN g b ON a.x <= b.x JOIN g ON g.x BETWEEN a.x AND b.x GROUP BY 1, 2),
fit AS (SELECT x, c / n AS own, (SELECT max(v) FROM (SELECT lo, min(mean) AS v FROM m WHERE lo <= g.x AND hi >= g.x GROUP BY lo)) AS p FROM g)"""
# A signal begins a step unless some stretch up to the one before it has a greater mean than some stretch from it on; 0 and 1 are added.
_STEPS = f"""{_ISO}, w AS (SELECT x, p, lag(x) OVER (ORDER BY x) AS prev FROM fit),
st AS (SELECT x, p FROM w WHERE prev IS NULL OR (SELECT max(mean) FROM m WHERE hi = w.prev) <= (SELECT min(mean) FROM m WHERE lo = w.x)),
ends AS (SELECT x, p FROM st UNION ALL SELECT 0.0, min(p) FROM st HAVING min(x) > 0 UNION ALL SELECT 1.0, max(p) FROM st HAVING max(x) < 1)"""

QUERIES = {
    "e1_index_submission": e1_index,
    "e4_extra_ids": e4_extras,
    "e5_e8_case_scores": e5_e8,
    "e9_summary": e9_summary,
    "e10_confusion": lambda s, d: S.confusion(scores(s, d)),
    "f8_row_validator": f8_validator,
    "d1_stratified_split": d1_split,
    "d2_overlaps": d2_overlaps,
    "d3_field_rates": d3_rates,
    "d4_error_groups": d4_groups,
    "d8_release_gate": d8_gate,
    "d9_regressions": d9_regressions,
    "c9_isotonic_fit": c9_fit,
    "c5_isotonic_apply": c5_apply,
}
_BASE = SCORES.replace("pa NOT IN", "'NEEDS_REVIEW' NOT IN").replace("upper(trim(coalesce(p.adjudication, ''))) AS pa", "CASE WHEN p.case_id IS NULL THEN '' ELSE 'NEEDS_REVIEW' END AS pa")
_summary_cols = "round(extraction, 6) AS extraction, round(classification, 6) AS classification, round(calibration, 6) AS calibration, round(missing_penalty, 6) AS missing_penalty, * EXCLUDE (extraction, classification, calibration, missing_penalty), round(extraction + classification + calibration - missing_penalty, 6) AS total"
ORACLE = {
    "e1_index_submission": f"WITH {SCORES} SELECT trim(s.case_id) AS case_id, max(p.adjudication) AS adjudication, count(*) AS copies FROM s0 s JOIN p ON trim(s.case_id) = p.case_id GROUP BY 1",
    "e4_extra_ids": f"WITH {SCORES}, k AS ({_select(TRUTH, 'o_orderkey % 2 = 0')}) SELECT case_id FROM p WHERE case_id NOT IN (SELECT case_id FROM k)",
    "e5_e8_case_scores": f"WITH {SCORES} SELECT * REPLACE (round(brier, 9) AS brier) FROM scores",
    "e9_summary": f"WITH {SCORES}, {SUMMARY} SELECT {_summary_cols} FROM sm",
    "e10_confusion": f"WITH {SCORES} SELECT truth_adjudication, pred_adjudication, count(*) AS cases FROM scores GROUP BY 1, 2",
    "f8_row_validator": f"WITH {SCORES}, e AS (SELECT array_to_string(list_sort([x FOR x IN [{', '.join(f'CASE WHEN {c} THEN {m!r} END' for c, m in _F8)}] IF x IS NOT NULL]), '; ') AS errors FROM s0) SELECT errors, count(*) AS n FROM e WHERE errors <> '' GROUP BY 1",
    "d1_stratified_split": f"WITH {_SPLIT} SELECT * FROM sp",
    "d2_overlaps": f"WITH {_SPLIT}, u AS (SELECT doc_id, role FROM sp UNION SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'release' ELSE role END FROM sp) SELECT doc_id, min(role) AS a, max(role) AS b FROM u GROUP BY 1 HAVING count(*) > 1",
    "d3_field_rates": f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(CASE WHEN hit_{f} THEN 1 END) AS matched, count(CASE WHEN can_{f} THEN 1 END) AS scorable FROM j" for f in W),
    "d4_error_groups": f"""WITH {SCORES}, g AS (SELECT reason AS classification_reason, CASE WHEN coalesce(difficulty, '') = '' THEN 'unspecified' ELSE difficulty END AS difficulty, CASE WHEN coalesce(damage_profile, '') = '' THEN 'unspecified' ELSE damage_profile END AS damage_profile,
  CASE WHEN len([x FOR x IN string_split(coalesce(traps, ''), '|') IF trim(x) <> '']) > 0 THEN 'adversarial' ELSE 'non_adversarial' END AS trap_status FROM sc)
SELECT *, count(*) AS cases FROM g GROUP BY GROUPING SETS ((classification_reason), (difficulty), (damage_profile), (trap_status))""",
    "d8_release_gate": f"""WITH {SCORES}, {SUMMARY}, {OUTCOMES}, b AS (WITH {_BASE}, {SUMMARY} SELECT * FROM sm), bo AS (WITH {_BASE}, {OUTCOMES} SELECT * FROM oc),
g(name, split, honest, secs, mib, src, leaks, skip) AS (VALUES ('sound', 'release', true, 12.5, 300.0, 'offline_run', 0, ''), ('dishonest', 'tuning', false, 12.5, 300.0, 'offline_run', 2, ''), ('unmeasured', 'release', true, NULL, 0.0, 'official_evaluator_process_only', 0, 'MIB-000001')),
rg AS (SELECT g.name, count(CASE WHEN bo.golden THEN 1 END) AS gr, count(CASE WHEN bo.adversarial THEN 1 END) AS ar FROM g LEFT JOIN (SELECT bo.*, oc.case_id AS id FROM bo JOIN oc USING (case_id) WHERE bo.correct AND NOT oc.correct) bo ON bo.id <> g.skip GROUP BY 1),
x AS (SELECT g.*, rg.gr, rg.ar, sm.*, b.extraction AS be, b.classification AS bc, b.calibration AS bk, b.catastrophic_false_approvals AS bf, b.missing_rows AS bm, b.invalid_adjudications + b.invalid_confidences + b.invalid_fees AS bi,
  sm.extraction + sm.classification + sm.calibration - sm.missing_penalty AS tot, b.extraction + b.classification + b.calibration - b.missing_penalty AS bt, (SELECT count(*) FROM oc WHERE case_id = g.skip) AS unlike FROM g JOIN rg USING (name), sm, b),
y AS (SELECT *, array_to_string([v FOR v IN [CASE WHEN NOT honest THEN 'candidate_not_honest_holdout' END, CASE WHEN split <> 'release' THEN 'different_splits' END, CASE WHEN unlike > 0 THEN 'different_cases' END, CASE WHEN secs IS NULL THEN 'missing_measurement:runtime_seconds' END,
  CASE WHEN coalesce(secs, 0) <= 0 THEN 'runtime_not_measured' END, CASE WHEN mib <= 0 THEN 'memory_not_measured' END, CASE WHEN src = 'official_evaluator_process_only' THEN 'only_evaluator_measured' END, CASE WHEN leaks > 0 THEN 'case_identity_leakage' END,
  CASE WHEN catastrophic_false_approvals > bf THEN 'catastrophic_false_approvals_increased' END] IF v IS NOT NULL], ',') AS blocking,
  array_to_string([v FOR v IN [CASE WHEN gr > 0 THEN 'golden_regressions' END, CASE WHEN ar > 0 THEN 'adversarial_regressions' END, CASE WHEN invalid_adjudications + invalid_confidences + invalid_fees > bi THEN 'invalid_rows_increased' END, CASE WHEN missing_rows > bm THEN 'missing_rows_increased' END] IF v IS NOT NULL], ',') AS warnings FROM x)
SELECT name, CASE WHEN blocking <> '' THEN 'BLOCKED' WHEN warnings <> '' THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict, blocking = '' AS adopt, blocking, warnings, gr AS golden_regressions, ar AS adversarial_regressions, round(tot - bt, 6) AS total_delta,
  round(extraction - be, 6) AS extraction_delta, round(classification - bc, 6) AS classification_delta, round(calibration - bk, 6) AS calibration_delta, catastrophic_false_approvals - bf AS catastrophic_false_approvals_delta FROM y""",
    "d9_regressions": f"""WITH {SCORES}, {OUTCOMES}, bo AS (WITH {_BASE}, {OUTCOMES} SELECT * FROM oc), r AS (SELECT bo.* FROM bo JOIN oc USING (case_id) WHERE bo.correct AND NOT oc.correct)
SELECT 'golden' AS category, case_id FROM r WHERE golden UNION ALL SELECT 'adversarial', case_id FROM r WHERE adversarial""",
    "c9_isotonic_fit": f"WITH {_STEPS} SELECT x AS breakpoint, round(p, 9) AS probability FROM ends",
    "c5_isotonic_apply": f"WITH {_ISO} SELECT event_id, round(p, 9) AS probability FROM events JOIN fit ON x = {SIGNAL['raw_signal']}",
}
