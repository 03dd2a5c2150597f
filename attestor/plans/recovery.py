"""Queries of page-wise recovery, bound to line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.operators import recovery as V

# In SQL that Spark and DuckDB read alike.
ROW = {
    "case_id": "l_orderkey % 3000",
    "page_index": "CAST(l_linenumber % 3 AS INT)",
    "line_seq": "l_orderkey * 10 + l_linenumber",
    "field_name": "CASE l_partkey % 3 WHEN 0 THEN 'home_world' WHEN 1 THEN 'sponsor_id' ELSE 'applicant_name' END",
    "value": "l_returnflag",
    "confidence": "l_discount * 10",
    "text": "CASE l_partkey % 6 WHEN 0 THEN 'Adjudicator  stamp, corrected' WHEN 1 THEN 'mandatory fee is unpaid' WHEN 2 THEN 'Fee status: unknown' WHEN 3 THEN 'SAMPLE denial' ELSE 'nothing' END",
    "struck": "l_tax > 0.07",
}
_SQL = "n AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ROW.items()) + " FROM lineitem)"


def rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*[F.expr(e).alias(c) for c, e in ROW.items()])


def l8(spark, sf_dir):
    return rows(spark, sf_dir).select("case_id", "line_seq", F.array_join(V.cues(F.col("text"), F.col("struck")), ",").alias("cues"))


def f7(spark, sf_dir):
    bad = F.when(F.col("struck") & (F.col("confidence") > 0.8), F.array(F.lit("strikethrough"))).otherwise(F.array().cast("array<string>"))
    return V.off_unsafe_pages(rows(spark, sf_dir).withColumn("visual_cues", bad)).select("case_id", "page_index", "line_seq")


def x6(spark, sf_dir):
    return V.narrative_fee(rows(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def x8(spark, sf_dir):
    r = rows(spark, sf_dir)
    return V.first_new(r.filter("confidence >= 0.5"), r.filter("confidence < 0.2"))


def x14(spark, sf_dir):
    return V.worst_page(rows(spark, sf_dir), most=0.5, least=6)


def x17(spark, sf_dir):
    r = rows(spark, sf_dir)
    return V.agreed(r.filter("page_index = 0 and confidence > 0.3"), r.filter("page_index = 1 and confidence > 0.3"), r.filter("page_index = 2 and confidence > 0.9"))


def r7(spark, sf_dir):
    r = rows(spark, sf_dir).select("case_id", "field_name", "value", "confidence")
    return V.stable_swap(r.filter("confidence > 0.1"), r.filter("confidence < 0.9"), "home_world")


def r10(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("evidence_type", F.when(F.col("line_seq") % 2 == 0, "intake_form").otherwise("sponsor_attestation"))
    return V.sponsor_conflict(r.withColumns({"ocr_confidence": F.col("confidence"), "clean": ~F.col("struck"), "correction": F.col("confidence") < 0.02, "narrative": F.lit(True), "applicant_hint": F.when(F.col("case_id") % 3 == 0, F.col("value")).otherwise("Zed Zarnax")}))


def d10(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 700).alias("rule_id"), "o_orderkey", "o_custkey")
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("o_custkey"))))
    k, r = F.col("o_custkey") % 5, F.col("rule_id")
    rules = o.groupBy("rule_id").agg(ids((r % 5 != 0) & (k < 3)).alias("visible"), ids((k == 1) | (r % 3 == 0) & (k == 4)).alias("heldout"), ids((k == 2) | (r % 7 == 0) & (k == 1)).alias("tuning"))
    told = {"tuning_split": F.lit("tuning"), "measured_split": F.when(r % 11 == 0, "tuning").otherwise("calibration"), "baseline_false_approvals": r % 3, "candidate_false_approvals": r % 4}
    return V.supported_exceptions(rules.withColumns(told)).select("rule_id", F.array_join("problems", ",").alias("problems"))


_fee = f"CASE WHEN regexp_matches(text, '{vocab.FEE_PHRASES['unpaid']}') THEN 'unpaid' WHEN regexp_matches(text, '{vocab.FEE_PHRASES['unknown']}') THEN 'unknown' END"
_cue = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{c}' END" for c, p in V.CUES.items())
_alone = lambda where: f"(SELECT case_id, field_name, max(value) AS value FROM n WHERE {where} GROUP BY 1, 2 HAVING count(DISTINCT value) = 1)"
QUERIES = {"l8_text_cues": l8, "f7_unsafe_pages": f7, "x6_narrative_fee": x6, "x8_first_new": x8, "x14_worst_page": x14, "x17_agreement": x17, "r7_stable_swap": r7, "r10_sponsor_conflict": r10, "d10_exception_support": d10}
ORACLE = {
    "l8_text_cues": f"WITH {_SQL} SELECT case_id, line_seq, array_to_string(list_sort([x FOR x IN [{_cue}, CASE WHEN struck THEN 'strikethrough' END] IF x IS NOT NULL]), ',') AS cues FROM n",
    "f7_unsafe_pages": f"WITH {_SQL} SELECT case_id, page_index, line_seq FROM n WHERE (case_id, page_index) NOT IN (SELECT (case_id, page_index) FROM n WHERE struck AND confidence > 0.8)",
    "x6_narrative_fee": f"""WITH {_SQL}, f AS (SELECT *, {_fee} AS fee FROM n), s AS (SELECT * FROM f WHERE fee IS NOT NULL), m AS (SELECT case_id, page_index, min({{'a': line_seq, 'b': fee}}).b AS value FROM s GROUP BY 1, 2)
SELECT s.case_id, s.page_index, m.value, round(avg(confidence), 6) AS confidence FROM s JOIN m ON s.case_id = m.case_id AND s.page_index = m.page_index AND fee = m.value GROUP BY 1, 2, 3""",
    "x8_first_new": f"""WITH {_SQL}, a AS (SELECT * FROM n WHERE confidence >= 0.5 AND (case_id, field_name, value) NOT IN (SELECT (case_id, field_name, value) FROM n WHERE confidence < 0.2))
SELECT case_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY case_id, field_name ORDER BY page_index, line_seq, value) AS rn FROM a) WHERE rn = 1""",
    "x14_worst_page": f"""WITH {_SQL}, p AS (SELECT case_id, page_index, median(confidence) AS m FROM n GROUP BY 1, 2 HAVING median(confidence) < 0.5 AND count(CASE WHEN confidence < 0.65 THEN 1 END) >= 4 AND count(*) >= 6)
SELECT case_id, page_index FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m, page_index) AS rn FROM p) WHERE rn = 1""",
    "x17_agreement": f"""WITH {_SQL} SELECT a.case_id, a.field_name, a.value FROM {_alone("page_index = 0 AND confidence > 0.3")} a JOIN {_alone("page_index = 1 AND confidence > 0.3")} b ON a.case_id = b.case_id AND a.field_name = b.field_name AND a.value = b.value
WHERE (a.case_id, a.field_name) NOT IN (SELECT (case_id, field_name) FROM n WHERE page_index = 2 AND confidence > 0.9)""",
    "r7_stable_swap": f"""WITH {_SQL}, b AS (SELECT DISTINCT case_id, field_name, value FROM n WHERE confidence > 0.1 AND field_name <> 'home_world'), a AS (SELECT DISTINCT case_id, field_name, value FROM n WHERE confidence < 0.9 AND field_name <> 'home_world'),
d AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT DISTINCT case_id FROM n WHERE (confidence > 0.1 OR confidence < 0.9) AND case_id NOT IN (SELECT case_id FROM d)""",
    "d10_exception_support": """WITH o AS (SELECT o_orderkey % 700 AS r, o_custkey % 5 AS k, o_custkey AS c FROM orders), p AS (SELECT DISTINCT r, c, r % 5 <> 0 AND k < 3 AS vis, k = 1 OR (r % 3 = 0 AND k = 4) AS held, k = 2 OR (r % 7 = 0 AND k = 1) AS tun FROM o),
g AS (SELECT r, bool_or(vis) AS v, count(CASE WHEN held THEN 1 END) AS h, bool_or(held AND NOT vis) AS "out", bool_or(held AND tun) AS "both" FROM p GROUP BY 1)
SELECT r AS rule_id, array_to_string([x FOR x IN [CASE WHEN NOT v THEN 'no_visible_support' END, CASE WHEN h < 2 THEN 'insufficient_heldout_support' END, CASE WHEN "out" THEN 'heldout_support_not_visible' END,
  CASE WHEN "both" THEN 'heldout_support_overlaps_tuning' END, CASE WHEN r % 11 = 0 THEN 'measured_on_tuning_split' END, CASE WHEN r % 4 > r % 3 THEN 'more_false_approvals' END] IF x IS NOT NULL], ',') AS problems FROM g""",
}
