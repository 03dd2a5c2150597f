"""Risk flags of lines that misread them."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import extract as X
from attestor.functions import vocab


@pytest.mark.parametrize(
    "text,flags",
    [
        ("Risk flags: memory_tampenng", ["memory_tampering"]),
        ("OBSERVED FLAG = sponsor_mismatoh; actve_warrant|none", ["active_warrant", "sponsor_mismatch"]),
        ("risk flags biohazard_red, reason", ["biohazard_red"]),
        ("Risk flags: none", []),
        ("Risk flags: ", []),
        ("Risk flags: nothing here", []),
        ("memory_tampenng", []),  # no label
        ("the flags: memory_tampenng", []),
        ("Risk flags: identity mismatch, rescinded_denia1", ["identity_conflict", "rescinded_denial"]),
        (None, []),
    ],
)
def test_labelled_flags(spark, text, flags):
    assert spark.createDataFrame([(text,)], "x string").select(X.risk_flags(F.col("x"))).first()[0] == flags


def test_close_match_is_difflibs(spark):
    rng = random.Random(3)
    items = ["".join(rng.choice("aeimnrst_") if rng.random() < 0.2 else c for c in f if rng.random() > 0.1) for f in vocab.RISK_FLAGS * 20]
    got = spark.createDataFrame([(i, f"Risk flags: {x}") for i, x in enumerate(items)], "i int, x string").select("i", X.risk_flags(F.col("x"))).collect()
    assert {i: f for i, f in got} == {i: difflib.get_close_matches(x, vocab.RISK_FLAGS, n=1, cutoff=0.72) for i, x in enumerate(items)}
