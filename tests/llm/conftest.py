from __future__ import annotations

import pytest

#: Columns that nothing should read, with names that clash with what operators return.
CLASH = {"n_words": 1, "start": "x", "score": None, "fp": 2.5, "root": "r", "_id": 3, "size": "s", "target": None, "part": 7, "copies": 1}


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of (doc_id, text) pairs with further columns of clashing names."""

    def make(pairs):
        extra = ", ".join(f"{k} string" for k in CLASH)
        return spark.createDataFrame([(i, t, *[None if v is None else str(v) for v in CLASH.values()]) for i, t in pairs], f"doc_id long, text string, {extra}")

    return make


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, a null id, repeated rows, ties, a very long text."""
    long = " ".join(f"word{i % 977} the quick {i % 13}" for i in range(20_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (None, "no id at all here"), (4, "The same text, twice."), (4, "The same text, twice."), (5, "the SAME text, twice."), (6, long), (7, "é ÉÀ \U0001f600 \x85 x"), (8, "\x00 zero")]
