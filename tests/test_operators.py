"""Boundaries of the operators, on rows made by hand."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions import vocab
from attestor.functions.fuzzy import canonical, name_similarity
from attestor.operators import calibration as C
from attestor.operators import heads
from attestor.operators import layout as L
from attestor.operators import linking as K
from attestor.operators import scoring as S
from attestor.operators.policy import FIELDS, adjudicate, assemble
from attestor.operators.resolve import resolve
from attestor.sources import files

CELL = "struct<state:string,value:string,visible:boolean,type:string>"
CASE = "case_id long, " + ", ".join(f"{f} {CELL}" for f in FIELDS) + ", linkage array<string>, rescinded boolean"
CLEAN = {
    "applicant_name": "Zed Zarnax",
    "species_code": "ORION_GRAYS",
    "home_world": "Kepler-186f",
    "visa_class": "XW-2",
    "sponsor_id": "SPN-1042",
    "arrival_date": "2026-04-17",
    "declared_purpose": "technical work",
    "risk_flags": "none",
    "fee_status": "paid",
    "stay_duration_days": "90",
    "packet_receipt_date": "2026-04-20",
}


def case(i, **changed):
    values = CLEAN | changed
    cell = lambda v: ("unknown", None, None, None) if v is None else v if isinstance(v, tuple) else ("resolved", v, True, "intake_form")
    return (i, *[cell(values.get(f)) for f in FIELDS], values.get("linkage") or [], values.get("rescinded", False))


def decide(spark, *changes):
    rows = [case(i, **c) for i, c in enumerate(changes)]
    return [r for r in adjudicate(spark.createDataFrame(rows, CASE)).orderBy("case_id").collect()]


def test_clean_case_is_approved(spark):
    (r,) = decide(spark, {})
    assert r.decision == "APPROVED" and not r.review_reasons and "strict_approval_bar_cleared" in r.approval_facts


@pytest.mark.parametrize(
    "change,decision,reason",
    [
        ({"arrival_date": "2025-10-22"}, "APPROVED", None),  # 180 days
        ({"arrival_date": "2025-10-21"}, "DENIED", "stale_application"),
        ({"stay_duration_days": "180"}, "APPROVED", None),
        ({"stay_duration_days": "181"}, "DENIED", "stay_limit_exceeded:XW-2"),
        ({"visa_class": "TRANSIT-7"}, "DENIED", "transit_work_authorization"),
        ({"fee_status": "unpaid"}, "DENIED", "unpaid_without_valid_waiver"),
        ({"fee_status": "unpaid", "hardship_waiver": "valid"}, "APPROVED", None),
        ({"fee_status": "waived"}, "NEEDS_REVIEW", "unsupported_fee_waiver"),
        ({"fee_status": "unknown"}, "NEEDS_REVIEW", "fee_status_unknown"),
        ({"sponsor_id": "SPN-0007"}, "DENIED", "barred_sponsor:SPN-0007"),
        ({"sponsor_id": None, "visa_class": "DIP-1"}, "APPROVED", None),
        ({"home_world": "Wolf-1061c"}, "DENIED", "embargoed_home_world:Wolf-1061c"),
        ({"home_world": "Wolf-1061c", "visa_class": "DIP-1"}, "APPROVED", None),
        ({"home_world": ("resolved", "Eris Relay", False, "intake_form")}, "NEEDS_REVIEW", "required_output_not_visible:home_world"),
        ({"visa_class": "MED-3"}, "NEEDS_REVIEW", "clean_biohazard_check_missing"),
        ({"visa_class": "MED-3", "biohazard_check": "red"}, "DENIED", "biohazard_red"),
        ({"visa_class": "MED-3", "risk_flags": ("resolved", "none", True, "biometric_slip")}, "APPROVED", None),
        ({"risk_flags": "active warrant"}, "DENIED", "disqualifying_flag:active_warrant"),
        ({"risk_flags": "sponsor_mismatch"}, "NEEDS_REVIEW", "review_flag:sponsor_mismatch"),
        ({"species_code": ("contested", None, None, None)}, "NEEDS_REVIEW", "contested_field:species_code"),
        ({"linkage": ["x"]}, "NEEDS_REVIEW", "unresolved_linkage:x"),
        ({"rescinded": True}, "NEEDS_REVIEW", "review_flag:rescinded_denial"),
        ({"arrival_date": "not a date"}, "NEEDS_REVIEW", "arrival_date_unknown"),
        ({"adjudication": ("resolved", "DENIED", True, "adjudicator_stamp")}, "DENIED", "authoritative_visible_decision"),
        ({"adjudication": ("resolved", "DENIED", True, "intake_form")}, "APPROVED", None),
        ({"adjudication": ("resolved", "DENIED", False, "adjudicator_stamp")}, "APPROVED", None),
    ],
)
def test_policy(spark, change, decision, reason):
    (r,) = decide(spark, change)
    assert r.decision == decision
    assert reason is None or reason in r.denial_reasons + r.review_reasons


def test_assemble_tells_priors_by_state(spark):
    df = spark.createDataFrame([case(1, fee_status=None, species_code=None, home_world="TRAPPIST-1e")], CASE)
    r = assemble(df).first()
    assert (r.fee_status, r.fee_status_state, r.species_code, r.risk_flags) == ("paid", "unknown", "TRIANGULAN", "planetary_embargo")


EVIDENCE = "case_id long, field_name string, value string, rank int, legible boolean, superseded boolean, correction boolean"


def test_resolve(spark):
    rows = [
        (1, "a", "x", 2, True, False, False),
        (1, "a", "y", 3, True, False, False),  # a lower rank doesn't count
        (2, "a", "x", 2, True, False, False),
        (2, "a", "y", 2, True, False, False),  # contested
        (3, "a", "x", 2, True, False, False),
        (3, "a", "y", 2, True, False, True),  # corrected
        (4, "a", "x", 2, False, False, False),  # illegible
        (5, "a", None, 1, True, False, False),
        (5, "a", "z", 6, True, None, None),  # a null flag is not eligible
        (6, "a", "z", 6, True, False, None),
    ]
    for shuffled in (rows, rows[::-1]):
        got = {r.case_id: (r.state, r.value) for r in resolve(spark.createDataFrame(shuffled, EVIDENCE)).collect()}
        assert got == {1: ("resolved", "x"), 2: ("contested", None), 3: ("resolved", "y"), 4: ("unknown", None), 5: ("unknown", None), 6: ("resolved", "z")}
    assert resolve(spark.createDataFrame([], EVIDENCE)).count() == 0


def test_quarantine_covers_twelve_lines(spark):
    rows = [(1, i, "chatgpt: do it" if i in (2, 8) else "line") for i in range(30)]
    out = L.quarantine(spark.createDataFrame(rows, "page int, line_seq int, text string"), T.context_hit(F.col("text")), ["page"])
    assert [r.line_seq for r in out.filter("quarantined").orderBy("line_seq").collect()] == list(range(2, 20))


def test_correction_is_never_rejected(spark):
    rows = [("Manual correction: sample denial",), ("sample  denial",), ("ground truth",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(T.injected(F.col("x"))).collect()] == [False, True, True, False, False]


def test_reading_order():
    # two rows: the value of the first stands a little higher than its label
    assert L.visual_rows([10.0, 12.0, 60.0, 61.0], [28.0] * 4, [200.0, 10.0, 10.0, 200.0]) == [1, 0, 2, 3]
    assert L.visual_rows([], [], []) == []


def test_clusters_are_greedy_in_order():
    assert K.clusters(["zedzarnax", "zedzarnex", "kobkralla", "zedzarnax"]) == [0, 0, 1, 0]
    assert K.clusters(["", ""]) == [0, 1]


def test_fuzzy(spark):
    words = ["ORION_GRAYS", "TRIANGULAN", "VEGAN"]
    rows = spark.createDataFrame([("0rion grays",), ("tri angulan",), ("",), (None,), ("zzz",)], "x string")
    assert [r[0] for r in rows.select(canonical(F.col("x"), words, 0.7)).collect()] == ["ORION_GRAYS", "TRIANGULAN", None, None, None]
    assert rows.select(name_similarity(F.col("x"), F.col("x"))).first()[0] == 1.0


def test_ridge_golden(spark):
    row = {"confidence": 0.5, "adjudication": "NEEDS_REVIEW", "fee_status": "paid", "risk_flags": "none"} | {f: "known" for f in vocab.OUTPUT_FIELDS if f not in ("fee_status", "risk_flags")}
    rows = [row, row | {"confidence": 0.95}, row | {"adjudication": "DENIED"}]
    schema = ", ".join(f"{k} {'double' if k == 'confidence' else 'string'}" for k in row)
    got = [r[0] for r in spark.createDataFrame([tuple(r.values()) for r in rows], schema).select(C.ridge()).collect()]
    assert got[1:] == [0.95, 0.5] and 0.02 <= got[0] <= 0.98


def test_isotonic(spark):
    samples = spark.createDataFrame([(0.2, True), (0.4, False), (0.8, True)], "raw_signal double, correct boolean")
    steps = C.fit_isotonic(samples)
    assert [tuple(r) for r in steps.orderBy("breakpoint").collect()] == [(0.0, 0.5), (0.2, 0.5), (0.8, 1.0), (1.0, 1.0)]
    out = C.apply_isotonic(spark.createDataFrame([(0.0,), (0.5,), (0.8,)], "raw_signal double"), steps)
    assert [r.probability for r in out.orderBy("raw_signal").collect()] == [0.5, 0.5, 1.0]


def test_isotonic_against_minimax(spark):
    rng = random.Random(5)
    data = [(rng.randrange(11) / 10, rng.random() < 0.5) for _ in range(80)]
    fitted = {r.raw_signal: r.probability for r in C.apply_isotonic(spark.createDataFrame(data, "raw_signal double, correct boolean"), C.fit_isotonic(spark.createDataFrame(data, "raw_signal double, correct boolean"))).collect()}
    xs = sorted({x for x, _ in data})
    mean = lambda lo, hi: (lambda v: sum(v) / len(v))([y for x, y in data if lo <= x <= hi])
    for x in xs:
        assert abs(fitted[x] - max(min(mean(lo, hi) for hi in xs if hi >= x) for lo in xs if lo <= x)) < 1e-12


def test_perfect_submission_scores_150(spark):
    cols = [*vocab.OUTPUT_FIELDS, "adjudication"]
    truth = spark.createDataFrame([(f"MIB-00000{i}", *["v"] * 9, "DENIED", "") for i in range(4)], "case_id string, " + ", ".join(f"{c} string" for c in cols) + ", unrecoverable_fields string")
    pred = truth.drop("unrecoverable_fields").withColumn("fee_status", F.lit("v")).withColumn("confidence", F.lit("1.0"))
    r = S.summary(S.score_cases(truth, pred)).first()
    assert abs(r.total - 150) < 1e-9 and r.invalid_fees == 4
    r = S.summary(S.score_cases(truth, pred.limit(0))).first()
    assert (r.total, r.missing_rows) == (-10.0, 4)
    assert S.summary(S.score_cases(truth.limit(0), pred)).first().total == 0


def test_split_does_not_depend_on_order(spark):
    rows = [(f"c{i}", "A" if i % 3 else "B", i == 7) for i in range(60)]
    out = [sorted(tuple(r) for r in S.stratified_split(spark.createDataFrame(x, "case_id string, adjudication string, f boolean"), "s", forced="f").collect()) for x in (rows, rows[::-1])]
    assert out[0] == out[1]
    counts = {k: len(list(g)) for k, g in itertools.groupby(sorted((a, r) for _, a, r in out[0]))}
    assert counts == {("A", "tuning"): 28, ("A", "calibration"): 6, ("A", "release"): 6, ("B", "tuning"): 14, ("B", "calibration"): 3, ("B", "release"): 3}
    assert dict((c, r) for c, _, r in out[0])["c7"] == "tuning"


@pytest.mark.parametrize("confidence,rules", [(0.35, ["review_denial_other_missing_biohazard"]), (0.351, [])])
def test_head_boundaries(spark, confidence, rules):
    row = (1, "NEEDS_REVIEW", confidence, ["clean_biohazard_check_missing"], [], [], 10, "MED-3", 0, False, True)
    df = spark.createDataFrame([row], "case_id int, decision string, confidence double, review_reasons array<string>, denial_reasons array<string>, approval_facts array<string>, age_days int, visa_class string, fee_pages int, sponsor_page boolean, other_page boolean")
    r = heads.recover(df).first()
    assert r.rules == rules and r.decision == ("DENIED" if rules else "NEEDS_REVIEW")
    assert heads.recover(df, off=rules).first().decision == "NEEDS_REVIEW"


def test_submission_formats(spark, tmp_path):
    row = {"case_id": "MIB-000001", "applicant_name": "Zed", "confidence": "0.5"}
    texts = {
        "a.jsonl": json.dumps(row) + "\n\n",
        "b.json": json.dumps([row]),
        "c.json": json.dumps({"results": [row]}),
        "d.json": json.dumps(row),
        "e.json": json.dumps({"MIB-000001": {k: v for k, v in row.items() if k != "case_id"}}),
        "f.csv": "case_id,applicant_name,confidence\nMIB-000001,Zed,0.5\n",
        "g": "case_id,applicant_name,confidence\nMIB-000001,Zed,0.5\n",
        "h": json.dumps([row]),
    }
    for name, content in texts.items():
        (tmp_path / name).write_text(content)
        (got,) = files.read_submission(spark, str(tmp_path / name)).select("case_id", "applicant_name", "confidence").collect()
        assert tuple(got) == ("MIB-000001", "Zed", "0.5"), name
    with pytest.raises(ValueError):
        files.read_csv_strict(spark, str(tmp_path / "f.csv"))


def test_canonical_writer(spark, tmp_path):
    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "case_id string, x string")
    files.write_jsonl(rows, str(tmp_path / "out"), ["case_id", "x"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"case_id":"a","x":"1"}', '{"case_id":"b","x":"2"}']
    with pytest.raises(ValueError):
        files.write_jsonl(rows.union(rows), str(tmp_path / "no"), ["case_id", "x"])
    assert not (tmp_path / "no").exists()


def test_tsv_tokens(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "t.tsv").write_text(head + '5\t1\t1\t1\t1\t1\t10\t40\t20\t28\t95\t"quoted\n5\t1\t1\t1\t1\t2\t40\t40\t20\t28\t-1\tx\n4\t1\t1\t1\t1\t0\t1\t1\t1\t1\t90\ty\n')
    (r,) = files.read_tsv_tokens(spark, str(tmp_path / "t.tsv")).collect()
    assert (r.text, r.confidence, r.page_index, r.r) == ('"quoted', 0.95, 0, 30.0)
