"""Facts read from lines and sentences, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .fuzzy import close_items


def risk_flags(text: Column) -> Column:
    """Sorted flags that a line names in full, whatever separates their words, by a phrase, or nearly in full after a label."""
    words = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    named = [F.when(words.rlike(f"(^|_){f}(_|$)"), F.lit(f)) for f in vocab.RISK_FLAGS]
    said = [F.when(text.rlike(p), F.lit(f)) for f, p in vocab.RISK_PHRASES.items()]
    labelled = F.when(text.rlike("(?i)flag"), text)  # of other lines Python gets nulls
    close = close_items(labelled, vocab.RISK_LABEL, r"[,;|\s]+", "[^a-z_]", vocab.RISK_FLAGS, vocab.RISK_CUTOFF, vocab.RISK_FILLERS)
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*named, *said)), F.coalesce(close, F.array().cast("array<string>")))))


def fee_fact(text: Column) -> Column:
    """Explicit fee status of a signed note, the first that is said; else null."""
    (a, pa), (b, pb) = vocab.FEE_PHRASES.items()
    return F.when(text.rlike(pa), a).when(text.rlike(pb), b)


def person_name(text: Column) -> Column:
    """First two capitalised words in a row; else null."""
    found = F.regexp_extract(text, r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b", 1)
    return F.when(found != "", found)


def any_date(text: Column) -> Column:
    """Date of year-month-day, else month/day/year, else day/month/year; null if none is one."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "MM/dd/yyyy"), F.try_to_date(t, "dd/MM/yyyy"))


def sponsor_sentences(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row (all columns of pages, field_name, value) for each field that a page's sponsor sentence gives; none without sponsor and attest."""
    said = F.col(text).rlike(r"(?i)\bsponsor\b") & F.col(text).rlike(r"(?i)\battests?\b")
    pairs = [F.struct(F.lit(f).alias("field_name"), F.trim(F.regexp_extract(text, p, 1)).alias("value")) for f, p in vocab.SPONSOR_SENTENCE.items()]
    return pages.filter(said).withColumn("_p", F.explode(F.filter(F.array(*pairs), lambda x: x["value"] != ""))).select(*pages.columns, "_p.*")
