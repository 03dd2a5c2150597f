"""Queries of the scalar functions, bound to orders, events, pages and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions import vocab

# Raw strings, in SQL that Spark and DuckDB read alike.
RAW = {
    "k": "o_orderkey",
    "name": "'  Zéd   ' || o_orderpriority || ' #' || CAST(o_custkey AS STRING)",
    "case_id": "CASE WHEN o_orderkey % 4 = 0 THEN ' MIB-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') ELSE 'MIB-1' END",
    "sponsor": "CASE o_orderkey % 5 WHEN 0 THEN 'spn-1O4S' WHEN 1 THEN 'SPN 90B7' WHEN 2 THEN 'SPN-12' WHEN 3 THEN 'SPN-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') ELSE '' END",
    "arrival": "CASE o_orderkey % 4 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '26-1-1' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "stay": "CASE o_orderkey % 3 WHEN 0 THEN 'about 90 days' WHEN 1 THEN '0' ELSE 'none' END",
    "flags": "CASE o_orderkey % 4 WHEN 0 THEN 'b flag| A_flag |b flag' WHEN 1 THEN 'NONE' WHEN 2 THEN '' ELSE 'x' END",
    "conf": "CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN '1.5' WHEN 2 THEN '-0.1' ELSE CAST((o_custkey % 100) / 100.0E0 AS STRING) END",
    "fee": "CASE o_orderkey % 3 WHEN 0 THEN ' paid' WHEN 1 THEN 'free' ELSE 'waived' END",
    "reason": "CASE o_orderkey % 6 WHEN 0 THEN 'contested_field:home_world' WHEN 1 THEN 'barred_sponsor:SPN-0007' WHEN 2 THEN ' Fee_Paid ' WHEN 3 THEN '9x:y' WHEN 4 THEN 'review_flag:a b' ELSE 'anything' END",
    "one": "'MIB-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')",
    "two": "CASE WHEN o_orderkey % 6 = 0 THEN 'MIB-x' ELSE 'MIB-' || lpad(CAST(o_custkey % 1000000 AS STRING), 6, '0') END",
}
_VIEW = "v AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + " FROM orders)"


def raw(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*[F.expr(e).alias(c) for c, e in RAW.items()])


def n_strings(spark, sf_dir):
    c = F.col
    return raw(spark, sf_dir).select(
        "k",
        T.ocr_key(c("name")).alias("ocr_key"),
        T.normalize(c("name")).alias("normalized"),
        F.array_join(F.array_sort(T.split_flags(c("flags"))), "|").alias("flag_set"),
        T.normalize_flags(c("flags")).alias("flags_normalized"),
        T.confidence(c("conf"))["value"].alias("confidence"),
        T.confidence(c("conf"))["valid"].alias("confidence_valid"),
        T.canonical_feature(c("reason")).alias("feature"),
        T.digit_distance(c("one"), c("two"), r"^MIB-[0-9]{6}$").cast("long").alias("distance"),
        T.stay_days(c("stay")).cast("long").alias("stay_days"),
        F.datediff(F.lit(vocab.SNAPSHOT_DATE).cast("date"), T.iso_date(c("arrival"))).cast("long").alias("age_days"),
        T.identifier(c("sponsor"), "SPN", 4).alias("sponsor"),
        T.is_unknown("sponsor_id", c("sponsor")).alias("sponsor_unknown"),
    )


def n25_coerce(spark, sf_dir):
    f = {"case_id": "case_id", "sponsor_id": "sponsor", "arrival_date": "arrival", "risk_flags": "flags", "fee_status": "fee", "adjudication": "fee", "confidence": "conf", "applicant_name": "name"}
    return raw(spark, sf_dir).select("k", *[T.coerced(field, F.col(c)).alias(field) for field, c in f.items()])


def s5_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


def k1_jsonl(spark, sf_dir):
    """A line for each case; each field is the least of the case's rows, whatever order they are read in."""
    from attestor.sources.files import canonical_json

    columns = ["sponsor_id", "arrival_date", "fee_status"]
    rows = n25_coerce(spark, sf_dir).filter("case_id is not null").groupBy("case_id").agg(*[F.min(c).alias(c) for c in columns])
    return canonical_json(rows, ["case_id", *columns])


_known, _safe = ("(" + ", ".join(f"'{x}'" for x in xs) + ")" for xs in (vocab.KNOWN_FEATURES, vocab.SAFE_SUFFIX_PREFIXES))
_cf = "CASE WHEN TRY_CAST(conf AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(conf AS DOUBLE) ELSE 0.0 END"
_parts = "[trim(p) FOR p IN string_split(lower(trim(flags)), '|') IF trim(p) <> '']"
_f = "lower(trim(reason))"
_date = "CASE WHEN regexp_full_match(arrival, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(arrival AS DATE) END"
_sp = "regexp_extract(upper(sponsor), '^\\s*SPN\\s*-?\\s*([0-9OQCDILSB]{4})', 1)"
QUERIES = {"n1_n24_scalar_functions": n_strings, "n25_row_coercion": n25_coerce, "s5_content_hash": s5_hash, "k1_canonical_jsonl": k1_jsonl}
_COERCE = f"""c AS (SELECT k, CASE WHEN regexp_full_match(trim(case_id), 'MIB-[0-9]{{6}}') THEN trim(case_id) END AS case_id, CASE WHEN regexp_full_match(trim(sponsor), 'SPN-[0-9]{{4}}') THEN trim(sponsor) ELSE 'SPN-0000' END AS sponsor_id,
  CASE WHEN ({_date}) IS NOT NULL THEN trim(arrival) ELSE '1900-01-01' END AS arrival_date, CASE WHEN trim(flags) = '' THEN 'none' ELSE trim(flags) END AS risk_flags, CASE WHEN trim(fee) IN ('paid', 'waived', 'unpaid', 'unknown') THEN trim(fee) ELSE 'unknown' END AS fee_status,
  'NEEDS_REVIEW' AS adjudication, {_cf} AS confidence, CASE WHEN trim(name) = '' THEN 'unknown' ELSE trim(name) END AS applicant_name FROM v)"""
ORACLE = {
    "n1_n24_scalar_functions": f"""WITH {_VIEW} SELECT k, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS ocr_key, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS normalized,
  CASE WHEN lower(flags) = 'none' THEN '' ELSE array_to_string(list_sort(list_distinct([replace(lower(trim(p)), ' ', '_') FOR p IN string_split(flags, '|') IF trim(p) <> ''])), '|') END AS flag_set,
  CASE WHEN lower(trim(flags)) IN ('', 'none', 'null', 'unknown') THEN 'none' ELSE array_to_string(list_sort({_parts}), '|') END AS flags_normalized, {_cf} AS confidence, coalesce(TRY_CAST(conf AS DOUBLE) BETWEEN 0 AND 1, false) AS confidence_valid,
  CASE WHEN NOT contains({_f}, ':') THEN CASE WHEN {_f} IN {_known} THEN {_f} ELSE 'other' END WHEN NOT regexp_full_match(split_part({_f}, ':', 1), '[a-z][a-z0-9_]*') THEN 'other'
    WHEN split_part({_f}, ':', 1) IN {_safe} AND regexp_full_match(split_part({_f}, ':', 2), '[a-z][a-z0-9_]*') THEN {_f} ELSE split_part({_f}, ':', 1) || ':*' END AS feature,
  CASE WHEN regexp_full_match(two, 'MIB-[0-9]{{6}}') THEN hamming(one, two) END AS distance, CASE WHEN stay = 'about 90 days' THEN 90 END AS stay_days, date_diff('day', {_date}, DATE '2026-07-07') AS age_days,
  CASE WHEN {_sp} <> '' THEN 'SPN-' || translate({_sp}, 'OQCDILSB', '00001158') END AS sponsor, lower(trim(sponsor)) IN ('', 'unknown', 'null', 'spn-0000') AS sponsor_unknown FROM v""",
    "n25_row_coercion": f"WITH {_VIEW}, {_COERCE} SELECT * FROM c",
    "s5_content_hash": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "k1_canonical_jsonl": f"""WITH {_VIEW}, {_COERCE} SELECT case_id, '{{"case_id":"' || case_id || '","sponsor_id":"' || min(sponsor_id) || '","arrival_date":"' || min(arrival_date) || '","fee_status":"' || min(fee_status) || '"}}' AS value FROM c WHERE case_id IS NOT NULL GROUP BY case_id""",
}
