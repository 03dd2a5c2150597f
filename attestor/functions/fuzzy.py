"""String similarity that SQL has no function for, in vectorised Python."""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import ocr_key


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp: twice the characters in matching blocks over all characters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def name_similarity(a: Column, b: Column) -> Column:
    """Ratio over letters and digits; 0 if either has none."""
    return _ratio(ocr_key(F.coalesce(a, F.lit(""))), ocr_key(F.coalesce(b, F.lit(""))))


def canonical(x: Column, vocabulary: list[str], cutoff: float, margin: float = 0.04) -> Column:
    """The vocabulary's item that x stands for: the same key, else the most similar one if it reaches the cutoff and leads by the margin; else null."""
    keys = {"".join(c for c in v.lower() if c.isascii() and c.isalnum()): v for v in vocabulary}

    def nearest(key: str) -> str | None:
        if not key:
            return None
        if key in keys:
            return keys[key]
        # the ratio is at most twice the shorter length over both: what can't come within the margin of the cutoff is not compared
        close = [k for k in keys if 2 * min(len(k), len(key)) >= (cutoff - margin) * (len(k) + len(key))]
        best = sorted(((ratio(key, k), k) for k in close), reverse=True)[:2]
        if not best or best[0][0] < cutoff or len(best) > 1 and best[0][0] - best[1][0] < margin:
            return None
        return keys[best[0][1]]

    @F.pandas_udf(StringType())
    def look_up(s: pd.Series) -> pd.Series:
        found = {k: nearest(k or "") for k in s.unique()}
        return s.map(found)

    return look_up(ocr_key(F.coalesce(x, F.lit(""))))


def close_items(text: Column, label: str, split: str, drop: str, vocabulary: list[str], cutoff: float, but: list[str]) -> Column:
    """Array of the vocabulary's items that the items after a label (its first group) stand for, each the most similar one that reaches the cutoff (of equal ones the greatest); null without the label.

    Items are split off by a pattern, folded, and rid of what `drop` matches; those in `but` don't count.
    """

    def nearest(item: str) -> str | None:
        score, best = max((ratio(v, item), v) for v in vocabulary)
        return best if score >= cutoff else None

    def found(t: str) -> list[str] | None:
        said = re.search(label, t)
        if not said:
            return None
        items = [re.sub(drop, "", x.casefold()) for x in re.split(split, said[1])]
        return [n for x in items if x and x not in but and (n := nearest(x))]

    @F.pandas_udf(ArrayType(StringType()))
    def look_up(s: pd.Series) -> pd.Series:
        known = {t: found(t) for t in s.dropna().unique()}
        return pd.Series([known.get(t) for t in s], dtype=object)

    return look_up(text)
