"""Linking queries, bound to line items (evidence) and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions.fuzzy import canonical, name_similarity
from attestor.operators import linking as K
from attestor.operators.resolve import resolve
from attestor.plans.evidence import EVIDENCE_SQL, ORACLE as RESOLVE_ORACLE, evidence

# Case ids and applicants of packets, in SQL that Spark and DuckDB read alike.
PACKET = {
    "packet": "l_orderkey",
    "expected": "CASE WHEN l_orderkey % 3 = 0 THEN ' MIB-' || lpad(CAST(l_orderkey % 1000000 AS STRING), 6, '0') ELSE 'scan_' || CAST(l_orderkey AS STRING) END",
    "field_name": "CASE WHEN l_partkey % 2 = 0 THEN 'case_id' ELSE 'fee_status' END",
    "value": "CASE WHEN l_suppkey % 5 = 0 THEN 'MIB-' || lpad(CAST((l_orderkey + 1) % 1000000 AS STRING), 6, '0') WHEN l_suppkey % 5 = 1 THEN 'MIB-12' ELSE 'MIB-' || lpad(CAST(l_orderkey % 1000000 AS STRING), 6, '0') END",
    "legible": "l_quantity >= 5",
}
STAMPS = {
    "case_id": "l_orderkey % 5000",
    "rid": "l_orderkey * 100 + l_linenumber",
    "field_name": "CASE WHEN l_partkey % 3 = 0 THEN 'fee_status' ELSE 'adjudication' END",
    "value": "CASE WHEN l_suppkey % 2 = 0 THEN 'APPROVED' ELSE 'DENIED' END",
    "evidence_type": "CASE l_partkey % 4 WHEN 0 THEN 'adjudicator_stamp' WHEN 1 THEN 'signed_manual_note' ELSE 'intake_form' END",
    "page_index": "l_linenumber",
    "top": "l_extendedprice",
    "watermark": "l_tax > 0.07",
    "correction": "l_quantity >= 25",
}
VOTE = {"case_id": "l_orderkey", "field_name": "CAST(l_partkey % 2 AS INT)", "value": "CASE WHEN l_quantity < 4 THEN NULL ELSE l_returnflag END"}
FLAG = {"case_id": "l_orderkey", "scoped": "l_partkey % 3 = 0", "value": "CASE l_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Active Warrant|biohazard_red' WHEN 2 THEN ' sponsor_mismatch ' ELSE 'biohazard_red' END"}
CLUSTER = {"case_id": "l_orderkey", "cluster": "CAST(l_partkey % 3 AS INT)", "rank": "CAST(1 + l_suppkey % 4 AS INT)", "ocr_confidence": "l_discount", "value": "'N' || CAST(l_partkey % 3 AS STRING)"}


def _view(spark, sf_dir, view):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*[F.expr(e).alias(c) for c, e in view.items()])


def _sql(view, name):
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in view.items()) + " FROM lineitem)"


def r8(spark, sf_dir):
    return K.rescind(_view(spark, sf_dir, STAMPS)).select("case_id", "rid", "top", "rescinded")


def r9_winner(spark, sf_dir):
    return K.winners(evidence(spark, sf_dir))


def fields(spark):
    return spark.range(9).select(F.col("id").cast("int").alias("field_name"))


def r11(spark, sf_dir):
    return K.resolve_all(evidence(spark, sf_dir), fields(spark))


def r12(spark, sf_dir):
    out = K.state_lists(resolve(evidence(spark, sf_dir)))
    return out.select("case_id", F.array_join("contested", ",").alias("contested"), F.array_join("unknown", ",").alias("unknown"))


def n2_canonical(spark, sf_dir):
    """Part names with a letter lost, against the words they are made of."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", " ")[0].alias("w"))
    words = sorted(r[0] for r in parts.select("w").distinct().collect() if r[0])  # the vocabulary is a parameter
    damaged = F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)"))
    return parts.select("p_partkey", damaged.alias("read"), canonical(damaged, words, 0.7).alias("canonical"))


def n13_similarity(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet")
    return n.select("p_partkey", F.round(name_similarity(F.col("p_name"), F.reverse("p_name")), 6).alias("similarity"))


def r3_clusters(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pk"), "p_name")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(parts, F.col("l_partkey") == F.col("pk"))
    names = rows.select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"), F.col("p_name").alias("value"))
    return K.name_clusters(names)


_WINNER = f"""WITH {EVIDENCE_SQL}, ok AS (SELECT * FROM ev WHERE legible AND NOT superseded AND value IS NOT NULL), b AS (SELECT *, min(rank) OVER (PARTITION BY case_id, field_name) AS r FROM ok),
c AS (SELECT *, bool_or(correction) OVER (PARTITION BY case_id, field_name) AS corrected FROM b WHERE rank = r), t AS (SELECT * FROM c WHERE correction OR NOT corrected), u AS (SELECT case_id, field_name FROM t GROUP BY 1, 2 HAVING count(DISTINCT value) = 1)
SELECT case_id, field_name, value, ocr_confidence, page_index, top FROM (SELECT t.*, row_number() OVER (PARTITION BY t.case_id, t.field_name ORDER BY ocr_confidence DESC, page_index DESC, top DESC) AS rn FROM t JOIN u ON t.case_id = u.case_id AND t.field_name = u.field_name) WHERE rn = 1"""

QUERIES = {
    "r1_choose_case": lambda s, d: K.choose_case(_view(s, d, PACKET)),
    "r3_name_clusters": r3_clusters,
    "r4_rank_clusters": lambda s, d: K.rank_clusters(_view(s, d, CLUSTER)),
    "r8_rescind": r8,
    "r9_winner": r9_winner,
    "r11_resolve_all": r11,
    "r12_state_lists": r12,
    "x13_consensus": lambda s, d: K.majority(_view(s, d, VOTE)),
    "x10_risk_union": lambda s, d: K.union_flags(_view(s, d, FLAG)),
    "n2_canonical": n2_canonical,
    "n13_name_similarity": n13_similarity,
}
ORACLE = {
    "r1_choose_case": f"""WITH {_sql(PACKET, "ev")}, a AS (SELECT packet, max(CASE WHEN regexp_full_match(trim(expected), 'MIB-[0-9]{{6}}') THEN trim(expected) END) AS e,
  list_distinct(list(CASE WHEN legible AND field_name = 'case_id' AND regexp_full_match(value, 'MIB-[0-9]{{6}}') THEN value END)) AS s0 FROM ev GROUP BY 1), b AS (SELECT packet, e, [x FOR x IN s0 IF x IS NOT NULL] AS s FROM a)
SELECT packet, coalesce(e, CASE WHEN len(s) = 1 THEN s[1] ELSE '' END) AS case_id, CASE WHEN e IS NOT NULL THEN CASE WHEN len(s) > 0 AND NOT list_contains(s, e) THEN 'visible case_id conflicts with source filename' END WHEN len(s) <> 1 THEN 'active case_id cannot be determined' END AS reason FROM b""",
    "r4_rank_clusters": f"""WITH {_sql(CLUSTER, "n")}, m AS (SELECT *, min(rank) OVER (PARTITION BY case_id, cluster) AS br FROM n), c AS (SELECT case_id, cluster, -min(br) AS a, count(*) FILTER (rank = br) AS b, count(*) AS c, max(ocr_confidence) AS d, min(value) AS v FROM m GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY case_id ORDER BY a DESC, b DESC, c DESC, d DESC) AS rk, row_number() OVER (PARTITION BY case_id ORDER BY a DESC, b DESC, c DESC, d DESC, cluster) AS rn, count(*) OVER (PARTITION BY case_id, a, b, c, d) AS same FROM c)
SELECT case_id, cluster, same > 1 AS tied, CASE WHEN same = 1 THEN v END AS applicant FROM k WHERE rn = 1""",
    "r8_rescind": f"""WITH {_sql(STAMPS, "s")}, k AS (SELECT * FROM s WHERE NOT watermark), m AS (SELECT case_id, max({{'p': page_index, 't': top}}) AS last FROM k WHERE field_name = 'adjudication' AND value = 'APPROVED' AND evidence_type = 'signed_manual_note' AND correction GROUP BY 1),
u AS (SELECT k.*, coalesce(field_name = 'adjudication' AND value = 'DENIED' AND evidence_type = 'adjudicator_stamp' AND {{'p': page_index, 't': top}} < last, false) AS gone FROM k LEFT JOIN m USING (case_id))
SELECT case_id, rid, top, case_id IN (SELECT case_id FROM u WHERE gone) AS rescinded FROM u WHERE NOT gone""",
    "r9_winner": _WINNER,
    "r11_resolve_all": f"SELECT c.case_id, CAST(f.f AS INT) AS field_name, coalesce(r.state, 'unknown') AS state, r.value, r.winning_rank, coalesce(r.considered, 0) AS considered FROM (SELECT DISTINCT l_orderkey AS case_id FROM lineitem) c CROSS JOIN range(9) f(f) LEFT JOIN ({RESOLVE_ORACLE['r9_resolve']}) r ON r.case_id = c.case_id AND r.field_name = f.f",
    "r12_state_lists": f"SELECT case_id, coalesce(string_agg(CAST(field_name AS VARCHAR), ',' ORDER BY field_name) FILTER (state = 'contested'), '') AS contested, coalesce(string_agg(CAST(field_name AS VARCHAR), ',' ORDER BY field_name) FILTER (state = 'unknown'), '') AS \"unknown\" FROM ({RESOLVE_ORACLE['r9_resolve']}) GROUP BY 1",
    "x13_consensus": f"WITH {_sql(VOTE, 'v')} SELECT case_id, field_name, max(value) AS value, count(value) AS votes FROM v GROUP BY 1, 2 HAVING count(value) >= 3 AND count(DISTINCT value) = 1",
    "x10_risk_union": f"""WITH {_sql(FLAG, "o")}, x AS (SELECT DISTINCT case_id, scoped, replace(lower(trim(f)), ' ', '_') AS flag FROM (SELECT case_id, scoped, unnest(string_split(value, '|')) AS f FROM o WHERE lower(value) <> 'none')), a AS (SELECT case_id, bool_or(scoped) AS s FROM x GROUP BY 1)
SELECT x.case_id, string_agg(DISTINCT flag, '|' ORDER BY flag) AS flags FROM x JOIN a USING (case_id) WHERE scoped OR NOT s GROUP BY 1""",
}
