"""Reports and splits as files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame


def write_report(report: DataFrame, path: str) -> dict:
    """The one row of report as indented JSON with sorted keys; the file appears whole or not at all."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    data = rows[0].asDict(recursive=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")
    os.replace(temporary, path)
    return data


def write_scores(scores: DataFrame, path: str) -> None:
    """Case scores as JSON lines, columns in order of name."""
    scores.select(*sorted(scores.columns)).write.option("ignoreNullFields", "false").json(path)


def write_split(split: DataFrame, path: str, role: str) -> None:
    """The rows of a role as CSV with header; a role without rows is an error."""
    rows = split.filter(split["role"] == role)
    if rows.isEmpty():
        raise ValueError(f"split {role} is empty")
    rows.write.option("header", True).csv(path)


def exit_code(report: dict, duplicates: int = 0, extras: int = 0) -> int:
    """2 if anything about the submission is invalid, else 0."""
    invalid = ("invalid_adjudications", "invalid_confidences", "invalid_fees")
    return 2 if duplicates or extras or any(report.get(k) for k in invalid) else 0


def summary_lines(report: dict, confusion: list[tuple[str, str, int]]) -> list[str]:
    """Scores and confusion counts for the console."""
    out = [f"{k}: {report[k]:.3f}" for k in ("total", "extraction", "classification", "calibration", "missing_penalty")]
    out += [f"{k}: {report[k]}" for k in ("missing_rows", "catastrophic_false_approvals")]
    return out + [f"{t} -> {p}: {n}" for t, p, n in sorted(confusion)]
