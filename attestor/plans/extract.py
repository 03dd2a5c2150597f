"""Queries of facts read from sentences, bound to orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import extract as X
from attestor.functions import vocab

TEXT = """CASE o_orderkey % 8 WHEN 0 THEN 'Risk flags: Memory-Tampering; ACTIVE WARRANT' WHEN 1 THEN 'Identity check: records mismatch' WHEN 2 THEN 'biometric slip unreadable, sponsor mismatch'
 WHEN 3 THEN 'The mandatory  fee is unpaid' WHEN 4 THEN 'Fee status - unknown' WHEN 5 THEN 'Sponsor SPN-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || ' attests that Zed Zarnax is expected on Earth for reactor work. The sponsor vouches class XW-2 compliance.'
 WHEN 6 THEN 'sponsor letter of Kob Kralla attest class MED-3 compliance' ELSE 'memory_tamperingx' END"""
DAY = "CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN '02/13/2026' WHEN 2 THEN '13/02/2026' ELSE 'soon' END"
_VIEW = f"v AS (SELECT o_orderkey AS k, {TEXT} AS text, {DAY} AS day FROM orders)"


def _rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.expr(TEXT).alias("text"), F.expr(DAY).alias("day"))


def facts(spark, sf_dir):
    return _rows(spark, sf_dir).select("k", F.array_join(X.risk_flags(F.col("text")), ",").alias("flags"), X.fee_fact(F.col("text")).alias("fee"), X.person_name(F.col("text")).alias("person"), X.any_date(F.col("day")).cast("string").alias("day"))


def sentences(spark, sf_dir):
    return X.sponsor_sentences(_rows(spark, sf_dir)).select("k", "field_name", "value")


_named = ", ".join(f"CASE WHEN regexp_matches(w, '(^|_){f}(_|$)') THEN '{f}' END" for f in vocab.RISK_FLAGS)
_said = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{f}' END" for f, p in vocab.RISK_PHRASES.items())
QUERIES = {"n5_n22_line_facts": facts, "n7_sponsor_sentence": sentences}
ORACLE = {
    "n5_n22_line_facts": f"""WITH {_VIEW}, u AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g') AS w FROM v) SELECT k, array_to_string(list_sort(list_distinct([x FOR x IN [{_named}, {_said}] IF x IS NOT NULL])), ',') AS flags,
  CASE WHEN regexp_matches(text, '{vocab.FEE_PHRASES["unpaid"]}') THEN 'unpaid' WHEN regexp_matches(text, '{vocab.FEE_PHRASES["unknown"]}') THEN 'unknown' END AS fee, nullif(regexp_extract(text, '\\b([A-Z][a-z]+\\s+[A-Z][a-z]+)\\b', 1), '') AS person,
  CAST(CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y'), try_strptime(day, '%d/%m/%Y')) AS DATE) AS VARCHAR) AS day FROM u""",
    "n7_sponsor_sentence": f"WITH {_VIEW}, m AS (" + " UNION ALL ".join(f"SELECT k, '{f}' AS field_name, trim(regexp_extract(text, '{p}', 1)) AS value FROM v WHERE regexp_matches(text, '(?i)\\bsponsor\\b') AND regexp_matches(text, '(?i)\\battests?\\b')" for f, p in vocab.SPONSOR_SENTENCE.items()) + ") SELECT * FROM m WHERE value <> ''",
}
