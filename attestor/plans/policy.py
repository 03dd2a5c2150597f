"""Policy, calibration and recovery queries, bound to cases made of orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.operators import calibration as C
from attestor.operators import heads
from attestor.operators.policy import FIELDS, adjudicate, assemble

# The view, in SQL that Spark and DuckDB read alike.
VALUES = {
    "applicant_name": "'Zed ' || CAST(o_custkey AS STRING)",
    "species_code": "CASE WHEN o_custkey % 2 = 0 THEN 'ORION_GRAYS' ELSE 'TRIANGULAN' END",
    "home_world": "CASE c_nationkey % 5 WHEN 0 THEN 'Eris Relay' WHEN 1 THEN 'Wolf-1061c' ELSE 'Kepler-186f' END",
    "visa_class": "CASE o_custkey % 6 WHEN 0 THEN 'XW-1' WHEN 1 THEN 'XW-2' WHEN 2 THEN 'DIP-1' WHEN 3 THEN 'MED-3' WHEN 4 THEN 'TRANSIT-7' ELSE 'ZZ-9' END",
    "sponsor_id": "CASE WHEN o_custkey % 5 = 0 THEN 'SPN-0007' ELSE 'SPN-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') END",
    "arrival_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "declared_purpose": "o_orderpriority",
    "risk_flags": "CASE o_orderkey % 7 WHEN 0 THEN 'memory tampering|identity_conflict' WHEN 1 THEN 'sponsor_mismatch' WHEN 2 THEN 'Active_Warrant' WHEN 3 THEN 'None' ELSE 'none' END",
    "fee_status": "CASE o_orderkey % 4 WHEN 0 THEN 'waived' WHEN 1 THEN 'unpaid' WHEN 2 THEN 'unknown' ELSE 'paid' END",
    "adjudication": "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'DENIED' ELSE 'NEEDS_REVIEW' END",
    "hardship_waiver": "CASE WHEN o_orderkey % 3 = 0 THEN 'valid' ELSE 'invalid' END",
    "diplomatic_note": "CASE WHEN o_custkey % 4 = 0 THEN 'valid' ELSE 'invalid' END",
    "packet_receipt_date": "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) AS STRING)",
    "stay_duration_days": "CAST(o_custkey % 250 AS STRING)",
    "biohazard_check": "CASE o_custkey % 4 WHEN 1 THEN 'red' WHEN 3 THEN 'clean' ELSE 'smudged' END",
}
TYPES = ["adjudicator_stamp", "signed_manual_note", "intake_form", "biometric_slip", "text_layer"]


def _parts(i: int, f: str) -> dict[str, str]:
    key = f"(o_orderkey + {i})"
    state = f"CASE WHEN {key} % {11 + 6 * i} = 0 THEN 'unknown' WHEN {key} % {13 + 8 * i} = 0 THEN 'contested' ELSE 'resolved' END"
    if f == "adjudication":
        state = "CASE WHEN o_orderkey % 9 = 0 THEN 'resolved' ELSE 'unknown' END"
    kind = "CASE (o_custkey + o_orderkey + {i}) % {n} ".format(i=i, n=5 if f == "adjudication" else 23) + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(TYPES)) + " ELSE 'intake_form' END"
    if f == "risk_flags":
        kind = "CASE WHEN o_custkey % 3 = 0 THEN 'biometric_slip' ELSE 'intake_form' END"
    return {"state": state, "value": VALUES[f], "visible": f"{key} % {17 + i} <> 0", "type": kind}


def cases(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    both = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    structs = [F.struct(*[F.expr(e).alias(k) for k, e in _parts(i, f).items()]).alias(f) for i, f in enumerate(FIELDS)]
    linkage = F.when(F.col("o_orderkey") % 37 == 0, F.array(F.lit("tied_applicants"))).otherwise(F.array().cast("array<string>"))
    return both.select(F.col("o_orderkey").alias("case_id"), *structs, linkage.alias("linkage"), (F.col("o_orderkey") % 41 == 0).alias("rescinded"))


def _v(f: str) -> str:
    return f"(CASE WHEN {f}_state = 'resolved' THEN {f}_value END)"


def _s(f: str) -> str:
    return f"({f}_state = 'resolved' AND {f}_visible AND {f}_type <> 'text_layer')"


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _list(pairs: list[tuple[str, str]], more: str = "") -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {n} END" for c, n in pairs)
    return f"list_sort(list_distinct([x FOR x IN [{items}] IF x IS NOT NULL]{more}))"


def _policy_sql() -> str:
    v, s = _v, _s
    cols = ", ".join(f"{e} AS {f}_{k}" for i, f in enumerate(FIELDS) for k, e in _parts(i, f).items())
    dip = f"({s('visa_class')} AND {v('visa_class')} = 'DIP-1')"
    waiver, note = (f"({v(f)} IS NOT NULL AND {v(f)} = 'valid' AND {s(f)})" for f in ("hardship_waiver", "diplomatic_note"))
    arrived = f"({v('arrival_date')} IS NOT NULL AND {s('arrival_date')})"
    since = f"(CASE WHEN {s('packet_receipt_date')} THEN CAST({v('packet_receipt_date')} AS DATE) ELSE DATE '2026-07-07' END)"
    stale = f"({arrived} AND date_diff('day', CAST({v('arrival_date')} AS DATE), {since}) > 180)"
    visa, vs = v("visa_class"), s("visa_class")
    needs = f"({vs} AND {visa} <> 'DIP-1')"
    sponsor_ok = f"({needs} AND {s('sponsor_id')})"
    stay = f"TRY_CAST({v('stay_duration_days')} AS INT)"
    limit = f"(CASE WHEN {visa} = 'XW-1' THEN 30 WHEN {visa} = 'XW-2' THEN 180 END)"
    stay_seen = f"({vs} AND {s('stay_duration_days')} AND {stay} > 0 AND {limit} IS NOT NULL)"
    med = f"({vs} AND {visa} = 'MED-3')"
    red, clean = (f"({med} AND {s('biohazard_check')} AND {v('biohazard_check')} = '{x}')" for x in ("red", "clean"))
    slip = f"({med} AND NOT {red} AND NOT {clean} AND {s('risk_flags')} AND len(flags) = 0 AND risk_flags_type = 'biometric_slip')"
    fee = v("fee_status")
    denial = _list(
        [
            (f"{s('home_world')} AND ({v('home_world')} IN {_in(vocab.EMBARGOED_WORLDS)} OR ({v('home_world')} = 'Wolf-1061c' AND {needs}))", f"'embargoed_home_world:' || {v('home_world')}"),
            (f"{vs} AND {visa} = 'TRANSIT-7'", "'transit_work_authorization'"),
            (f"{s('fee_status')} AND {fee} = 'unpaid' AND NOT {waiver}", "'unpaid_without_valid_waiver'"),
            (f"{sponsor_ok} AND {v('sponsor_id')} IN {_in(vocab.BARRED_SPONSORS)}", f"'barred_sponsor:' || {v('sponsor_id')}"),
            (f"{stale} AND NOT {dip}", "'stale_application'"),
            (f"{stay_seen} AND {stay} > {limit}", f"'stay_limit_exceeded:' || {visa}"),
            (red, "'biohazard_red'"),
        ],
        f" || CASE WHEN {s('risk_flags')} THEN ['disqualifying_flag:' || f FOR f IN flags IF f IN {_in(vocab.DISQUALIFYING_FLAGS)}] ELSE [] END",
    )
    review = _list(
        [
            (f"{s('fee_status')} AND {fee} = 'waived' AND NOT {dip} AND NOT {waiver}", "'unsupported_fee_waiver'"),
            (f"{fee} IS NULL OR {fee} = 'unknown'", "'fee_status_unknown'"),
            (f"NOT {vs}", "'visa_class_not_visible'"),
            (f"{needs} AND {v('sponsor_id')} IS NULL", "'required_sponsor_unknown'"),
            (f"{needs} AND {v('sponsor_id')} IS NOT NULL AND NOT {s('sponsor_id')}", "'required_sponsor_not_visible'"),
            (f"{v('arrival_date')} IS NULL", "'arrival_date_unknown'"),
            (f"{v('arrival_date')} IS NOT NULL AND NOT {s('arrival_date')}", "'arrival_date_not_visible'"),
            (f"{stale} AND {dip} AND NOT {note}", "'stale_diplomatic_note_missing'"),
            (f"{med} AND NOT {red} AND NOT {clean} AND NOT {slip}", "'clean_biohazard_check_missing'"),
            (f"coalesce({visa} NOT IN {_in(vocab.VISA_CLASSES)}, true)", "'visa_class_unknown'"),
            ("rescinded AND NOT list_contains(flags, 'rescinded_denial')", "'review_flag:rescinded_denial'"),
            ("risk_flags_state <> 'resolved'", "'risk_flags_unknown'"),
            (f"risk_flags_state = 'resolved' AND NOT {s('risk_flags')}", "'risk_flags_not_visible'"),
            ("linked", "'unresolved_linkage:tied_applicants'"),
            *[(f"{f}_state = 'contested'", f"'contested_field:{f}'") for f in FIELDS],
            *[(f"{f}_state <> 'resolved'" + (f" AND NOT coalesce({visa} = 'DIP-1', false)" if f == "sponsor_id" else ""), f"'required_output_unknown:{f}'") for f in vocab.OUTPUT_FIELDS],
            *[(f"{f}_state = 'resolved' AND NOT {s(f)}", f"'required_output_not_visible:{f}'") for f in vocab.OUTPUT_FIELDS],
        ],
        f" || ['review_flag:' || f FOR f IN flags IF f IN {_in(vocab.REVIEW_FLAGS)}]",
    )
    facts = _list(
        [
            (f"{s('fee_status')} AND {fee} = 'paid'", "'fee_paid'"),
            (f"{s('fee_status')} AND {fee} = 'waived' AND ({dip} OR {waiver})", "'valid_fee_waiver'"),
            (f"{sponsor_ok} AND {v('sponsor_id')} NOT IN {_in(vocab.BARRED_SPONSORS)}", "'sponsor_present_and_not_publicly_barred'"),
            (dip, "'diplomatic_sponsor_exemption'"),
            (f"{stale} AND {dip} AND {note}", "'stale_diplomatic_note_exemption'"),
            (f"{arrived} AND NOT {stale}", "'application_date_current_or_exempt'"),
            (f"{stay_seen} AND {stay} <= {limit}", "'stay_within_visa_limit'"),
            (clean, "'clean_biohazard_check'"),
            (slip, "'no_visible_biohazard_risk'"),
        ]
    )
    stamp = f"CASE WHEN {s('adjudication')} AND adjudication_type IN ('adjudicator_stamp', 'signed_manual_note') THEN {v('adjudication')} END"
    flags = f"CASE WHEN {v('risk_flags')} IS NULL OR lower({v('risk_flags')}) = 'none' THEN CAST([] AS VARCHAR[]) ELSE list_distinct([replace(lower(trim(p)), ' ', '_') FOR p IN string_split({v('risk_flags')}, '|') IF trim(p) <> '']) END"
    told = lambda c, d: f"CASE WHEN stamp IS NULL THEN {c} WHEN stamp = '{d}' THEN ['authoritative_visible_decision'] ELSE CAST([] AS VARCHAR[]) END"
    return f"""
cs0 AS (SELECT o_orderkey AS case_id, {cols}, o_orderkey % 37 = 0 AS linked, o_orderkey % 41 = 0 AS rescinded FROM orders JOIN customer ON o_custkey = c_custkey),
cs AS (SELECT *, {flags} AS flags FROM cs0),
rs AS (SELECT case_id, {stamp} AS stamp, {denial} AS d, {review} AS r, {facts} AS f FROM cs),
rd AS (SELECT *, coalesce(stamp, CASE WHEN len(d) > 0 THEN 'DENIED' WHEN len(r) > 0 THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END) AS decision FROM rs),
dec AS (SELECT case_id, decision, stamp IS NOT NULL AS authoritative, {told("d", "DENIED")} AS denial_reasons, {told("r", "NEEDS_REVIEW")} AS review_reasons,
  {told("CASE WHEN decision = 'APPROVED' THEN list_sort(f || ['strict_approval_bar_cleared']) ELSE f END", "APPROVED")} AS approval_facts FROM rd)"""


POLICY_SQL = _policy_sql()


def traces(spark, sf_dir: str) -> DataFrame:
    return adjudicate(cases(spark, sf_dir))


def a_policy(spark, sf_dir):
    j = lambda c: F.array_join(c, ",").alias(c)
    return traces(spark, sf_dir).select("case_id", "decision", "authoritative", j("denial_reasons"), j("review_reasons"), j("approval_facts"))


def a10_assemble(spark, sf_dir):
    return assemble(cases(spark, sf_dir))


def _assemble_sql() -> str:
    out = []
    for f in vocab.OUTPUT_FIELDS:
        spare = vocab.PRIORS.get(f) or vocab.SENTINELS.get(f) or "unknown"
        if f == "risk_flags":
            every = f"list_sort(list_distinct(flags || CASE WHEN {_s('home_world')} AND {_v('home_world')} IN {_in(vocab.EMBARGOED_WORLDS)} THEN ['planetary_embargo'] ELSE [] END))"
            out.append(f"CASE WHEN len({every}) = 0 THEN 'none' ELSE array_to_string({every}, '|') END AS {f}")
        else:
            out.append(f"coalesce({_v(f)}, '{spare}') AS {f}")
        out.append(f"{f}_state")
    return f"WITH {POLICY_SQL} SELECT cs.case_id, {', '.join(out)}, decision AS adjudication FROM cs JOIN dec USING (case_id)"


def c1_signal(spark, sf_dir):
    return traces(spark, sf_dir).select("case_id", F.round(C.raw_signal(), 6).alias("raw_signal"), C.bucket().alias("bucket"), C.signature().alias("signature"))


_some = lambda c, xs: "(" + " OR ".join(f"len([x FOR x IN {c} IF starts_with(x, '{p}')]) > 0" for p in xs) + ")"
_feature = (
    "[CASE WHEN NOT contains(x, ':') THEN CASE WHEN x IN " + _in(vocab.KNOWN_FEATURES) + " THEN x ELSE 'other' END "
    "WHEN NOT regexp_full_match(split_part(x, ':', 1), '[a-z][a-z0-9_]*') THEN 'other' "
    "WHEN split_part(x, ':', 1) IN " + _in(vocab.SAFE_SUFFIX_PREFIXES) + " AND regexp_full_match(regexp_replace(x, '^[^:]*:', ''), '[a-z][a-z0-9_]*') THEN x "
    "ELSE split_part(x, ':', 1) || ':*' END FOR x IN [lower(trim(y)) FOR y IN {0}]]"
)
_sig = lambda c: "array_to_string(list_sort(list_distinct(" + _feature.replace("{0}", c) + ")), ',')"
TRACE_SQL = f"""{POLICY_SQL},
tr AS (SELECT *, len([x FOR x IN approval_facts IF x <> 'strict_approval_bar_cleared']) AS support FROM dec),
sg AS (SELECT case_id, decision, CASE WHEN authoritative THEN 0.98
  WHEN decision = 'DENIED' THEN least(0.99, CASE WHEN {_some("denial_reasons", C.HARD_PREFIXES)} OR list_has_any(denial_reasons, {C.HARD_REASONS}) THEN 0.93 ELSE 0.84 END + least(0.05, greatest(0, len(denial_reasons) - 1) * 0.015))
  WHEN decision = 'NEEDS_REVIEW' THEN least(0.98, CASE WHEN {_some("review_reasons", ["contested_field:"])} THEN 0.94 WHEN {_some("review_reasons", ["unresolved_linkage:"])} THEN 0.92
    WHEN {_some("review_reasons", ["review_flag:"])} THEN 0.88 WHEN len([x FOR x IN review_reasons IF contains(x, 'not_visible')]) > 0 THEN 0.83 ELSE 0.74 END + least(0.06, greatest(0, len(review_reasons) - 1) * 0.01))
  ELSE least(0.93, 0.78 + least(6, support) * 0.025) END AS raw_signal,
  decision || '|' || CASE WHEN authoritative THEN 'authoritative'
    WHEN decision = 'DENIED' THEN CASE {" ".join(f"WHEN {_some('denial_reasons', [k])} THEN 'reason={k.rstrip(':')}'" for k in C.DENIAL_CATEGORIES)} ELSE 'reason=other' END
    WHEN decision = 'APPROVED' THEN 'support=' || CAST(least(6, support) AS VARCHAR)
    WHEN {_some("review_reasons", ["review_flag:"])} THEN 'class=review_flag'
    WHEN {_some("review_reasons", ["contested_field:", "unresolved_linkage:", "conflicting_generalizable_exceptions"])} THEN 'class=conflict'
    WHEN {_some("review_reasons", ["required_output_", "visa_class_", "risk_flags_", "fee_status_", "arrival_date_", "required_sponsor_"])} OR len([x FOR x IN review_reasons IF contains(x, 'not_visible')]) > 0 THEN 'class=core_gap'
    ELSE 'class=policy_only' END AS bucket,
  decision || '|source=' || CASE WHEN authoritative THEN 'authoritative' ELSE 'rules' END || '|denial=' || {_sig("denial_reasons")} || '|review=' || {_sig("review_reasons")} || '|approval=' || {_sig("approval_facts")} AS signature
FROM tr)"""


def _samples(spark, sf_dir):
    t = traces(spark, sf_dir)
    return t.select("case_id", "decision", C.bucket().alias("bucket"), C.signature().alias("signature"), F.pmod(F.col("case_id"), F.lit(5)).isin(0, 2, 3).alias("correct"))


def c4_empirical_bayes(spark, sf_dir):
    s = _samples(spark, sf_dir)
    # read once for each level: a row for each key, computed anew if an executor that holds some is lost
    stats = C.fit_semantic(s).persist()
    return C.apply_semantic(s.select("case_id", "decision", "bucket", "signature"), stats).select("case_id", F.round("probability", 9).alias("probability"))


_BAYES = f"""WITH {TRACE_SQL}, smp AS (SELECT *, case_id % 5 IN (0, 2, 3) AS ok FROM sg),
rate AS (SELECT *, sum(ok::INT) OVER () / count(*) OVER () AS p0, sum(ok::INT) OVER (PARTITION BY decision) AS c1, count(*) OVER (PARTITION BY decision) AS n1,
  sum(ok::INT) OVER (PARTITION BY bucket) AS c2, count(*) OVER (PARTITION BY bucket) AS n2, sum(ok::INT) OVER (PARTITION BY signature) AS c3, count(*) OVER (PARTITION BY signature) AS n3 FROM smp),
p1 AS (SELECT *, (c1 + 8 * p0) / (n1 + 8) AS q1 FROM rate), p2 AS (SELECT *, (c2 + 2 * q1) / (n2 + 2) AS q2 FROM p1)
SELECT case_id, round(greatest(0.02, least(0.98, (c3 + 2 * q2) / (n3 + 2))), 9) AS probability FROM p2"""


def c7_ridge(spark, sf_dir):
    rows = a10_assemble(spark, sf_dir).withColumn("confidence", F.pmod(F.col("case_id"), F.lit(100)) / 100)
    return rows.select("case_id", F.round(C.ridge(), 9).alias("confidence"))


def _ridge_sql() -> str:
    unknown = {f: f"CASE WHEN lower(trim({f})) IN ('', 'unknown', 'null'" + (f", '{vocab.SENTINELS[f].lower()}'" if f in vocab.SENTINELS else "") + ") THEN 1.0::DOUBLE ELSE 0.0 END" for f in vocab.OUTPUT_FIELDS}
    values = {"bias": "1.0::DOUBLE", "p": "p", "p2": "p * p", "unknown_count": "(" + " + ".join(unknown.values()) + ") / 9", "risk_non_none": "CASE WHEN lower(trim(risk_flags)) IN ('', 'none', 'unknown', 'null') THEN 0.0::DOUBLE ELSE 1.0 END"}
    values |= {f"output={d}": f"CASE WHEN adjudication = '{d}' THEN 1.0::DOUBLE ELSE 0.0 END" for d in vocab.DECISIONS} | {f"p_output={d}": f"CASE WHEN adjudication = '{d}' THEN p ELSE 0.0 END" for d in vocab.DECISIONS}
    values |= {f"unknown={f}": u for f, u in unknown.items()} | {f"fee_{x}": f"CASE WHEN fee_status = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END" for x in vocab.FEES}
    total = " + ".join(f"({values[f]}) * ({w!r}::DOUBLE)" for f, w in vocab.RIDGE.items())
    return f"WITH a AS ({_assemble_sql()}), b AS (SELECT *, (case_id % 100) / 100.0::DOUBLE AS p FROM a) SELECT case_id, round(CASE WHEN adjudication = 'NEEDS_REVIEW' AND p < 0.9 THEN greatest(0.02, least(0.98, {total})) ELSE p END, 9) AS confidence FROM b"


def h_recovery(spark, sf_dir):
    rows = adjudicate(cases(spark, sf_dir), (("age_days", heads.arrival_age()), ("visa_class", F.col("_v_visa_class"))))
    rows = rows.withColumn("confidence", F.pmod(F.col("case_id"), F.lit(50)) / 100)
    rows = rows.withColumn("fee_pages", (F.col("case_id") % 3).cast("int")).withColumn("sponsor_page", F.col("case_id") % 4 == 0).withColumn("other_page", F.col("case_id") % 5 == 0)
    out = heads.recover(rows)
    return out.select("case_id", "decision", F.round("confidence", 9).alias("confidence"), F.array_join("rules", ",").alias("rules"))


def _recovery_sql() -> str:
    age = f"CASE WHEN {_v('arrival_date')} IS NOT NULL THEN date_diff('day', CAST({_v('arrival_date')} AS DATE), DATE '2026-07-07') END"
    has = lambda c, x: f"list_contains({c}, '{x}')"
    denial = [
        (f"p <= 0.35 AND {has('review_reasons', 'clean_biohazard_check_missing')} AND case_id % 5 = 0", "review_denial_other_missing_biohazard"),
        ("p <= 0.35 AND age > 365 AND case_id % 4 = 0", "review_denial_sponsor_stale_gt365"),
        (" AND ".join(has("review_reasons", f"required_output_unknown:{f}") for f in ("home_world", "risk_flags", "sponsor_id")), "review_denial_three_required_outputs_unknown"),
    ]
    current = has("approval_facts", "application_date_current_or_exempt")
    approval = [
        (f"p <= 0.25 AND case_id % 3 = 1 AND {has('approval_facts', 'diplomatic_sponsor_exemption')}", "review_diplomatic_fee_receipt_recovery"),
        ("p <= 0.2 AND visa = 'XW-1' AND case_id % 4 = 0", "review_approval_sponsor_attestation_xw1"),
        (f"p > 0.2 AND p <= 0.25 AND {current} AND {has('review_reasons', 'visa_class_unknown')}", "review_approval_current_application_visa_unknown"),
        (f"p <= 0.35 AND {current} AND {has('review_reasons', 'required_output_unknown:home_world')} AND NOT {has('review_reasons', 'unsupported_fee_waiver')}", "review_approval_current_application_home_world_unknown"),
    ]
    lst = lambda rs: "list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rs) + "] IF x IS NOT NULL])"
    return f"""WITH {POLICY_SQL}, j AS (SELECT dec.*, {age} AS age, {_v("visa_class")} AS visa, (case_id % 50) / 100.0::DOUBLE AS p FROM dec JOIN cs USING (case_id)),
m AS (SELECT *, CASE WHEN decision = 'NEEDS_REVIEW' THEN {lst(denial)} ELSE CAST([] AS VARCHAR[]) END AS dn, CASE WHEN decision = 'NEEDS_REVIEW' AND len(denial_reasons) = 0 THEN {lst(approval)} ELSE CAST([] AS VARCHAR[]) END AS ap FROM j)
SELECT case_id, CASE WHEN len(dn) > 0 THEN 'DENIED' WHEN len(ap) > 0 THEN 'APPROVED' ELSE decision END AS decision,
  round(CASE WHEN len(dn) > 0 THEN 0.551819438046983 WHEN len(ap) > 0 THEN 0.98 ELSE p END, 9) AS confidence, array_to_string(CASE WHEN len(dn) > 0 THEN dn ELSE ap END, ',') AS rules FROM m"""


QUERIES = {"a1_a7_policy": a_policy, "a10_assemble": a10_assemble, "c1_c3_trace_features": c1_signal, "c4_empirical_bayes": c4_empirical_bayes, "c7_ridge": c7_ridge, "h1_h2_recovery": h_recovery}
ORACLE = {
    "a1_a7_policy": f"WITH {POLICY_SQL} SELECT case_id, decision, authoritative, array_to_string(denial_reasons, ',') AS denial_reasons, array_to_string(review_reasons, ',') AS review_reasons, array_to_string(approval_facts, ',') AS approval_facts FROM dec",
    "a10_assemble": _assemble_sql(),
    "c1_c3_trace_features": f"WITH {TRACE_SQL} SELECT case_id, round(raw_signal::DOUBLE, 6) AS raw_signal, bucket, signature FROM sg",
    "c4_empirical_bayes": _BAYES,
    "c7_ridge": _ridge_sql(),
    "h1_h2_recovery": _recovery_sql(),
}
