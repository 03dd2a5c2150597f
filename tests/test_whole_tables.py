"""Queries against plain Python over every row of their tables, or rows made by hand."""

from __future__ import annotations

import re
from collections import defaultdict

from helpers import SF

from attestor.functions import vocab
from attestor.operators import linking as K
from attestor.plans import linking, recovery
from attestor.plans.evidence import evidence

BIG = "/root/testdata/sf0.01"


def test_narrative_fee_of_all_lines(spark):
    pages = defaultdict(list)
    for r in recovery.rows(spark, SF).collect():
        fee = next((f for f, p in vocab.FEE_PHRASES.items() if re.search(p, r.text)), None)
        if fee:
            pages[r.case_id, r.page_index].append((r.line_seq, fee, r.confidence))
    want = {}
    for page, said in pages.items():
        value = min(said)[1]
        sure = [c for _, fee, c in said if fee == value]
        want[page] = (value, sum(sure) / len(sure))
    got = {(r.case_id, r.page_index): (r.value, r.confidence) for r in recovery.x6(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == v and abs(got[k][1] - c) < 1e-6 for k, (v, c) in want.items())


def test_agreement_of_all_cases(spark):
    readings = [defaultdict(set) for _ in range(3)]
    for r in recovery.rows(spark, BIG).collect():
        if r.confidence > (0.9 if r.page_index == 2 else 0.3):
            readings[r.page_index][r.case_id, r.field_name].add(r.value)
    first, second, known = readings
    want = {(*k, *v) for k, v in first.items() if len(v) == 1 and second.get(k) == v and k not in known}
    got = [tuple(r) for r in recovery.x17(spark, BIG).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(case >= 2500 for case, _, _ in got)


def winner(rows):
    """(value, confidence, page, top) of one field's rows, or None."""
    rows = [r for r in rows if r.legible and not r.superseded and r.value is not None]
    rows = [r for r in rows if r.rank == min(x.rank for x in rows)]
    rows = [r for r in rows if r.correction] or rows
    if len({r.value for r in rows}) != 1:
        return None
    best = max(rows, key=lambda r: (r.ocr_confidence, r.page_index, r.top))
    return best.value, best.ocr_confidence, best.page_index, best.top


def test_winners_of_all_evidence(spark):
    fields = defaultdict(list)
    for r in evidence(spark, BIG).collect():
        fields[r.case_id, r.field_name].append(r)
    want = {k: w for k, rows in fields.items() if (w := winner(rows))}
    got = {(r.case_id, r.field_name): (r.value, r.ocr_confidence, r.page_index, r.top) for r in linking.r9_winner(spark, BIG).collect()}
    assert got == want


def test_correction_wins_over_a_surer_row(spark):
    row = "case_id long, field_name string, value string, rank int, page_index int, ocr_confidence double, legible boolean, superseded boolean, correction boolean, top double"
    rows = [(1, "a", "x", 2, 1, 0.9, True, False, False, 5.0), (1, "a", "x", 2, 0, 0.5, True, False, True, 7.0), (1, "a", "y", 2, 3, 0.9, True, False, None, 1.0)]
    assert [tuple(r) for r in K.winners(spark.createDataFrame(rows, row)).collect()] == [(1, "a", "x", 0.5, 0, 7.0)]
