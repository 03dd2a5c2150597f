"""Gate, exception support, error groups, isotonic fit, fee demotion and struck evidence on rows made by hand."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import calibration as C
from attestor.operators import heads
from attestor.operators import linking as K
from attestor.operators import recovery as V
from attestor.operators import scoring as S
from attestor.operators.resolve import resolve

REPORT = {
    "total": 100.0, "extraction": 40.0, "classification": 50.0, "calibration": 10.0, "catastrophic_false_approvals": 0, "missing_rows": 0, "invalid_adjudications": 0, "invalid_confidences": 0, "invalid_fees": 0,
    "split_name": "release", "honest_holdout": True, "runtime_seconds": 3.0, "peak_memory_mib": 90.0, "source": "run", "leakage_findings": 0,
}
TYPES = "total double, extraction double, classification double, calibration double, catastrophic_false_approvals long, missing_rows long, invalid_adjudications long, invalid_confidences long, invalid_fees long, split_name string, honest_holdout boolean, runtime_seconds double, peak_memory_mib double, source string, leakage_findings long"
CASES = [("a", True, True, False), ("b", True, False, True), ("c", False, True, True), ("d", True, False, False)]


def report(spark, **change):
    return spark.createDataFrame([tuple((REPORT | change).values())], TYPES)


def cases(spark, rows=CASES):
    return spark.createDataFrame(rows, "case_id string, correct boolean, golden boolean, adversarial boolean")


@pytest.mark.parametrize(
    "change,after,verdict,blocking,warnings",
    [
        ({}, CASES, "PASS", "", ""),
        ({"total": 1.0, "extraction": 0.0}, CASES, "PASS", "", ""),  # a lower score blocks nothing
        ({"missing_rows": 1, "invalid_fees": 1}, CASES, "PASS_WITH_WARNINGS", "", "invalid_rows_increased,missing_rows_increased"),
        ({}, [("a", False, False, False), *CASES[1:]], "PASS_WITH_WARNINGS", "", "golden_regressions"),  # the baseline tells the category
        ({}, [CASES[0], ("b", False, False, False), *CASES[2:3], ("d", False, True, True)], "PASS_WITH_WARNINGS", "", "adversarial_regressions"),
        ({"catastrophic_false_approvals": 1}, CASES, "BLOCKED", "catastrophic_false_approvals_increased", ""),
        ({"honest_holdout": False, "split_name": "tuning"}, CASES, "BLOCKED", "candidate_not_honest_holdout,different_splits", ""),
        ({"runtime_seconds": None, "peak_memory_mib": 0.0, "source": "official_evaluator_process_only", "leakage_findings": 2}, CASES, "BLOCKED", "missing_measurement:runtime_seconds,runtime_not_measured,memory_not_measured,only_evaluator_measured,case_identity_leakage", ""),
        ({}, CASES[:3], "BLOCKED", "different_cases", ""),
        ({}, [*CASES, ("e", True, True, True)], "BLOCKED", "different_cases", ""),
    ],
)
def test_gate(spark, change, after, verdict, blocking, warnings):
    row = S.gate(report(spark), report(spark, **change), cases(spark), cases(spark, after)).first()
    assert (row.verdict, row.adopt, row.blocking, row.warnings) == (verdict, not blocking, blocking, warnings)


def test_gate_baseline_must_be_honest(spark):
    row = S.gate(report(spark, honest_holdout=None, catastrophic_false_approvals=3, missing_rows=2), report(spark), cases(spark), cases(spark)).first()
    assert (row.verdict, row.blocking, row.catastrophic_false_approvals_delta) == ("BLOCKED", "baseline_not_honest_holdout", -3)


def test_regressions(spark):
    now = [("a", False, False, False), ("b", False, False, False), ("c", False, False, False), ("d", False, True, True)]
    assert sorted(map(tuple, S.regressions(cases(spark), cases(spark, now)).collect())) == [("adversarial", "b"), ("golden", "a")]


def test_exception_support(spark):
    rows = [
        ("good", ["a", "b"], ["a", "b"], ["c"], "t", "h", 1, 1),
        ("unseen", [], ["a", "b"], [], "t", "h", 0, 0),
        ("few", ["a"], ["a"], [], "t", "h", 0, 0),
        ("tuned", ["a", "b"], ["a", "b"], ["b"], "t", "t", 2, 1),
        ("nothing", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "rule_id string, visible array<string>, heldout array<string>, tuning array<string>, tuning_split string, measured_split string, candidate_false_approvals int, baseline_false_approvals int")
    assert {r.rule_id: list(r.problems) for r in V.supported_exceptions(df).collect()} == {
        "good": [],
        "unseen": ["no_visible_support", "heldout_support_not_visible"],
        "few": ["insufficient_heldout_support"],
        "tuned": ["heldout_support_overlaps_tuning", "measured_on_tuning_split", "more_false_approvals"],
        "nothing": ["no_visible_support", "insufficient_heldout_support", "measured_on_tuning_split"],
    }


def test_error_groups_count_all_cases(spark):
    rows = [("correct", "hard", None, "qr|x"), ("correct", "", "stain", ""), ("wrong_decision", None, "stain", " | ")]
    got = S.error_groups(spark.createDataFrame(rows, "classification_reason string, difficulty string, damage_profile string, traps string"), "classification_reason", "difficulty", "damage_profile", "traps")
    found = {(k, r[k]): r.cases for r in got.collect() for k in got.columns[:-1] if r[k] is not None}
    assert found == {
        ("classification_reason", "correct"): 2, ("classification_reason", "wrong_decision"): 1, ("difficulty", "hard"): 1, ("difficulty", "unspecified"): 2,
        ("damage_profile", "stain"): 2, ("damage_profile", "unspecified"): 1, ("trap_status", "adversarial"): 1, ("trap_status", "non_adversarial"): 2,
    }


def fit(spark, samples):
    return [tuple(r) for r in C.fit_isotonic(spark.createDataFrame(samples, "raw_signal double, correct boolean")).collect()]


def test_isotonic_steps(spark):
    assert fit(spark, [(0.2, True), (0.4, False), (0.8, True)]) == [(0.0, 0.5), (0.2, 0.5), (0.8, 1.0), (1.0, 1.0)]
    assert fit(spark, [(0.0, False), (0.5, False), (1.0, True)]) == [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]  # equal means stay apart
    assert fit(spark, []) == []
    for bad in (-0.1, 1.1, None):
        with pytest.raises(ValueError):
            fit(spark, [(0.5, True), (bad, True)])


def test_isotonic_is_the_least_squares_fit(spark):
    rng = random.Random(5)
    for _ in range(4):
        samples = [(rng.randrange(11) / 10, rng.random() < 0.5) for _ in range(40)]
        xs = sorted({x for x, _ in samples})
        mean = lambda a, b, s=samples: (lambda v: sum(v) / len(v))([y for x, y in s if a <= x <= b])
        best = {x: max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs}
        steps = fit(spark, samples)
        assert steps == sorted(steps) and all(a[1] <= b[1] for a, b in itertools.pairwise(steps))
        for x in xs:
            assert abs([p for b, p in steps if b <= x][-1] - best[x]) < 1e-12


def test_fee_demotion_looks_at_the_row(spark):
    rows = [(1, "APPROVED", "unknown", "resolved", 0.9), (2, "APPROVED", "paid", "unknown", 0.9), (3, "DENIED", "unknown", "unknown", 0.9), (4, "APPROVED", "unknown", "unknown", 0.3), (5, "APPROVED", None, "unknown", 0.9)]
    got = heads.demote_unknown_fee(spark.createDataFrame(rows, "case_id int, adjudication string, fee_status string, fee_status_state string, confidence double")).collect()
    assert {r.case_id: (r.adjudication, r.confidence) for r in got} == {1: ("NEEDS_REVIEW", 0.45), 2: ("APPROVED", 0.9), 3: ("DENIED", 0.9), 4: ("NEEDS_REVIEW", 0.3), 5: ("APPROVED", 0.9)}


def test_struck_evidence_is_not_eligible(spark):
    schema = "case_id int, field_name string, value string, rank int, page_index int, ocr_confidence double, legible boolean, superseded boolean, correction boolean, top double, visual_cues array<string>"
    rows = [
        (1, "a", "struck", 1, 0, 0.9, True, False, False, 1.0, ["correction", "strikethrough"]),
        (1, "a", "kept", 2, 0, 0.5, True, False, False, 1.0, []),
        (1, "a", "kept", 2, 1, 0.4, True, False, False, 1.0, None),
        (2, "a", "gone", 1, 0, 0.9, True, False, False, 1.0, ["strikethrough"]),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {r.case_id: (r.state, r.value) for r in resolve(df).collect()} == {1: ("resolved", "kept"), 2: ("unknown", None)}
    assert [(r.case_id, r.value, r.ocr_confidence) for r in K.winners(df).collect()] == [(1, "kept", 0.5)]
    assert resolve(df.drop("visual_cues")).filter("value = 'struck'").count() == 1


def test_outcomes(spark):
    scores = spark.createDataFrame([("a", "correct", "GOLDEN", None), ("b", "missed_review", None, "x"), ("c", "correct", "easy", "|")], "case_id string, classification_reason string, difficulty string, traps string")
    listed = spark.createDataFrame([("c", True, None), ("z", True, True)], "case_id string, golden boolean, adversarial boolean")
    got = {r.case_id: (r.correct, r.golden, r.adversarial) for r in S.outcomes(scores, listed).orderBy(F.col("case_id")).collect()}
    assert got == {"a": (True, True, False), "b": (False, False, True), "c": (True, True, False)}
