"""Evidence queries, bound to a view over lineitem that stands in for extracted evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.resolve import resolve


def evidence(spark, sf_dir: str) -> DataFrame:
    """One evidence row per line item."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_partkey") % 7).cast("int").alias("field_name"),
        F.concat("l_returnflag", "l_linestatus").alias("value"),
        (1 + F.col("l_suppkey") % 6).cast("int").alias("rank"),
        F.col("l_linenumber").alias("page_index"),
        (F.col("l_discount") * 10).alias("ocr_confidence"),
        (F.col("l_quantity") >= 5).alias("legible"),
        (F.col("l_tax") > 0.07).alias("superseded"),
        (F.col("l_partkey") % 11 == 0).alias("correction"),
        F.col("l_extendedprice").alias("top"),
    )


EVIDENCE_SQL = """
ev AS (SELECT l_orderkey AS case_id, CAST(l_partkey % 7 AS INTEGER) AS field_name, l_returnflag || l_linestatus AS value,
  CAST(1 + l_suppkey % 6 AS INTEGER) AS rank, l_linenumber AS page_index, l_discount * 10 AS ocr_confidence,
  l_quantity >= 5 AS legible, l_tax > 0.07 AS superseded, l_partkey % 11 = 0 AS correction, l_extendedprice AS top FROM lineitem)"""


def r9_resolve(spark, sf_dir: str) -> DataFrame:
    return resolve(evidence(spark, sf_dir))


QUERIES = {"r9_resolve": r9_resolve}

ORACLE = {
    "r9_resolve": f"""
WITH {EVIDENCE_SQL},
live AS (SELECT *, legible AND NOT superseded AND value IS NOT NULL AS ok FROM ev),
best AS (SELECT *, min(CASE WHEN ok THEN rank END) OVER (PARTITION BY case_id, field_name) AS r FROM live),
top AS (SELECT *, ok AND rank = r AS t, max(CASE WHEN ok AND rank = r AND correction THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, field_name) AS corrected FROM best)
SELECT case_id, field_name,
  CASE count(DISTINCT CASE WHEN t AND (corrected = 0 OR correction) THEN value END) WHEN 0 THEN 'unknown' WHEN 1 THEN 'resolved' ELSE 'contested' END AS state,
  CASE WHEN count(DISTINCT CASE WHEN t AND (corrected = 0 OR correction) THEN value END) = 1 THEN max(CASE WHEN t AND (corrected = 0 OR correction) THEN value END) END AS value,
  min(r) AS winning_rank, CAST(count(*) AS BIGINT) AS considered
FROM top GROUP BY case_id, field_name"""
}
