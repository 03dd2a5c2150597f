"""Scalar functions over strings, flags and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def ocr_key(x: Column) -> Column:
    """Lower case, letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def normalize(x: Column) -> Column:
    """Trimmed, white space collapsed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def split_flags(x: Column) -> Column:
    """Distinct flags of a pipe-joined list, underscores for spaces; none for 'none' and null."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda p: F.replace(F.lower(F.trim(p)), F.lit(" "), F.lit("_")))
    return F.when(F.lower(x) == "none", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda p: p != "")))


def normalize_flags(x: Column) -> Column:
    """Flags sorted and pipe-joined, repeats kept; 'none' for what stands for nothing."""
    raw = normalize(x)
    parts = F.filter(F.transform(F.split(raw, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(raw.isin("", "none", "null", "unknown"), "none").otherwise(F.array_join(F.array_sort(parts), "|"))


def confidence(x: Column) -> Column:
    """struct(value, valid) of a string or number: in [0, 1], else (0, false)."""
    number = x.try_cast("double")
    valid = F.coalesce(number.between(0.0, 1.0) & ~F.isnan(number), F.lit(False))
    return F.struct(F.when(valid, number).otherwise(0.0).alias("value"), valid.alias("valid"))


def digits_repaired(x: Column) -> Column:
    """Letters that recognition confuses with digits put right."""
    return F.translate(F.upper(x), "OQCDILSB", "00001158")


def identifier(x: Column, prefix: str, length: int) -> Column:
    """prefix-digits where the text after the prefix holds `length` digits once repaired, else null."""
    tail = F.regexp_extract(F.upper(x), rf"^\s*{prefix}\s*-?\s*([0-9OQCDILSB]{{{length}}})", 1)
    return F.when(tail != "", F.concat(F.lit(f"{prefix}-"), digits_repaired(tail)))


def digit_distance(a: Column, b: Column, pattern: str) -> Column:
    """Number of differing digits of two identifiers; null if either doesn't match the pattern."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.when(a.rlike(pattern) & b.rlike(pattern), F.aggregate(pairs, F.lit(0), lambda s, v: s + v))


def iso_date(x: Column) -> Column:
    """Date of a strict yyyy-mm-dd string, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))


def stay_days(x: Column) -> Column:
    """First number of one to four digits, if positive."""
    n = F.regexp_extract(x, r"(\d{1,4})", 1).try_cast("int")
    return F.when(n >= 1, n)


def is_unknown(field: str, x: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    sentinel = vocab.SENTINELS.get(field)
    return raw.isin("", "unknown", "null", *([sentinel.lower()] if sentinel else []))


def canonical_feature(x: Column) -> Column:
    """Feature of a reason without what names a case: known bare tokens, prefix:suffix for safe prefixes, prefix:* for others."""
    raw = F.lower(F.trim(x))
    token = r"^[a-z][a-z0-9_]*$"
    prefix, suffix = F.regexp_extract(raw, r"^([^:]*):", 1), F.regexp_replace(raw, r"^[^:]*:", "")
    with_colon = F.when(~prefix.rlike(token), "other").when(prefix.isin(vocab.SAFE_SUFFIX_PREFIXES) & suffix.rlike(token), F.concat(prefix, F.lit(":"), suffix)).otherwise(F.concat(prefix, F.lit(":*")))
    return F.when(raw.contains(":"), with_colon).when(raw.isin(vocab.KNOWN_FEATURES), raw).otherwise("other")


#: Fixed patterns: content that tries to instruct the reader, by line and by context.
CONTEXT_PATTERN = (
    r"(?i)(\b(fake\s+)?(system\s+prompt|answer\s+key|ground\s+truth)\b|\bignore\s+(all\s+)?(previous|prior)\s+instructions?\b"
    r"|\b(qr|bar\s*code)\b.*\b(instruction|policy|answer|decision)\b|\b(assistant|chatgpt)\s*:\s*)"
)
LINE_PATTERN = r"(?i)(\bsample\s+denial\b|\bdo\s+not\s+follow\s+(the\s+)?(form|policy)\b)"
CORRECTION_PATTERN = r"(?i)^\s*manual\s+correction\s*:"


def injected(x: Column) -> Column:
    """Whether a line is to be rejected; an anchored manual correction never is."""
    return F.coalesce((x.rlike(CONTEXT_PATTERN) | x.rlike(LINE_PATTERN)) & ~x.rlike(CORRECTION_PATTERN), F.lit(False))


def context_hit(x: Column) -> Column:
    return F.coalesce(x.rlike(CONTEXT_PATTERN), F.lit(False))


#: Page types by what their heading contains, first match wins.
PAGE_TYPES = [
    ("signed_manual_note", ["manual adjudicator note", "signed manual note"]),
    ("adjudicator_stamp", ["adjudicator stamp", "official stamp"]),
    ("biometric_slip", ["biometric", "form b-13", "form b 13"]),
    ("sponsor_attestation", ["sponsor attestation", "sponsor letter"]),
    ("registry_extract", ["registry extract", "registry record"]),
    ("fee_receipt", ["fee receipt"]),
    ("intake_form", ["form i-8090", "form i 8090", "work authorization intake", "primary intake record"]),
]


def page_type(heading: Column) -> Column:
    low, out = F.lower(heading), None
    for name, keys in PAGE_TYPES:
        hit = low.contains(keys[0])
        for k in keys[1:]:
            hit = hit | low.contains(k)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def coerced(field: str, x: Column) -> Column:
    """An output value made to fit its domain."""
    text = F.trim(x)
    if field == "case_id":
        return F.when(text.rlike(r"^MIB-[0-9]{6}$"), text)
    if field == "sponsor_id":
        return F.when(text.rlike(r"^SPN-[0-9]{4}$"), text).otherwise("SPN-0000")
    if field == "arrival_date":
        return F.when(iso_date(text).isNotNull(), text).otherwise("1900-01-01")
    if field == "risk_flags":
        return F.when(F.coalesce(text, F.lit("")) == "", "none").otherwise(text)
    if field == "fee_status":
        return F.when(text.isin(vocab.FEES), text).otherwise("unknown")
    if field == "adjudication":
        return F.when(text.isin(vocab.DECISIONS), text).otherwise("NEEDS_REVIEW")
    if field == "confidence":
        return confidence(x)["value"]
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(text)
