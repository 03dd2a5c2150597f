from __future__ import annotations

import json

import pytest

from attestor.sources import reports


def test_reports(spark, tmp_path):
    row = {"total": 1.0, "extraction": 0.5, "classification": 0.5, "calibration": 0.0, "missing_penalty": 0.0, "missing_rows": 0, "catastrophic_false_approvals": 1, "invalid_fees": 0}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    assert reports.write_report(df, str(tmp_path / "r.json")) == row
    assert json.loads((tmp_path / "r.json").read_text()) == row and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        reports.write_report(df.union(df), str(tmp_path / "x.json"))
    assert reports.exit_code(row) == 0 and reports.exit_code(row | {"invalid_fees": 1}) == 2 and reports.exit_code(row, extras=1) == 2
    assert reports.summary_lines(row, [("DENIED", "APPROVED", 1)])[-1] == "DENIED -> APPROVED: 1"
    split = spark.createDataFrame([("a", "tuning")], "case_id string, role string")
    reports.write_split(split, str(tmp_path / "s"), "tuning")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 1
    with pytest.raises(ValueError):
        reports.write_split(split, str(tmp_path / "t"), "release")
    reports.write_scores(split, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["case_id", "role"]
