"""Linking evidence to a case and an applicant, and what precedence resolution takes and gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from attestor.functions.fuzzy import ratio
from attestor.functions.text import ocr_key
from attestor.operators.resolve import resolve

CASE_ID = r"^MIB-[0-9]{6}$"


def choose_case(evidence: DataFrame, packet: str = "packet", expected: str = "expected") -> DataFrame:
    """(packet, case_id, reason): the file name's id if valid, else the only visible one, else ''.

    reason tells of a visible id that conflicts with the file name, or that none could be chosen.
    Only the least and greatest visible id and whether the expected one is among them are aggregated, not the set.
    """
    seen = F.when(F.col("legible") & (F.col("field_name") == "case_id") & F.col("value").rlike(CASE_ID), F.col("value"))
    name = F.when(F.trim(expected).rlike(CASE_ID), F.trim(expected))
    agg = evidence.withColumn("_e", name).withColumn("_v", seen).groupBy(packet).agg(F.max("_e").alias("e"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max(F.coalesce(F.col("_v") == F.col("_e"), F.lit(False))).alias("hit"))
    reason = F.when(F.col("e").isNotNull() & F.col("lo").isNotNull() & ~F.col("hit"), "visible case_id conflicts with source filename").when(F.col("e").isNull() & F.coalesce(F.col("lo") != F.col("hi"), F.lit(True)), "active case_id cannot be determined")
    return agg.select(packet, F.coalesce("e", F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit("")).alias("case_id"), reason.alias("reason"))


def clusters(keys: list[str]) -> list[int]:
    """Greedy clusters of names in order: a name joins the first cluster with any member alike, else starts one."""
    groups: list[list[str]] = []
    out = []
    for k in keys:
        i = next((i for i, g in enumerate(groups) if any(k and m and ratio(k, m) >= 0.8 for m in g)), len(groups))
        if i == len(groups):
            groups.append([])
        if k not in groups[i]:
            groups[i].append(k)
        out.append(i)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _clusters(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: clusters(list(k)))


def name_clusters(names: DataFrame) -> DataFrame:
    """names (case_id, ordinal, value and others) with cluster.  The greedy order matters, so a case is one array; a case is a packet of pages, a bounded thing."""
    rest = [c for c in names.columns if c != "case_id"]
    case = names.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("value", F.lit("")).alias("_v"), F.struct(*rest).alias("_row")))).alias("_all"))
    case = case.withColumn("_k", _clusters(F.transform("_all", lambda x: ocr_key(x["_v"]))))
    return case.select("case_id", F.explode(F.arrays_zip("_all", "_k")).alias("z")).select("case_id", "z._all._row.*", F.col("z._k").alias("cluster"))


def rank_clusters(names: DataFrame) -> DataFrame:
    """(case_id, cluster, tied, applicant): the strongest cluster of each case; none if two are equally strong.

    Strength: best rank, then how many have it, then size, then best confidence.
    """
    best = names.groupBy("case_id", "cluster", "rank").agg(F.count("*").alias("n"), F.max("ocr_confidence").alias("c"), F.max(F.struct("ocr_confidence", -F.col("rank"), "value")).alias("top"))
    per = best.groupBy("case_id", "cluster").agg(F.min(F.struct("rank", "n")).alias("r"), F.sum("n").alias("size"), F.max("c").alias("c"), F.max("top").alias("top"))
    strength = F.struct((-F.col("r.rank")).alias("a"), F.col("r.n").alias("b"), F.col("size").alias("c"), F.col("c").alias("d"))
    per = per.withColumn("s", strength)
    top = per.groupBy("case_id").agg(F.max(F.struct("s", (-F.col("cluster")).alias("k"), F.col("top.value").alias("v"))).alias("w"), F.collect_list("s").alias("all"))
    tied = F.size(F.filter("all", lambda x: x == F.col("w.s"))) > 1
    return top.select("case_id", (-F.col("w.k")).cast("int").alias("cluster"), tied.alias("tied"), F.when(~tied, F.col("w.v")).alias("applicant"))


def rescind(evidence: DataFrame) -> DataFrame:
    """Evidence without watermark samples and without stamped denials that stand before the last corrected signed approval of the case; rescinded marks the cases of the latter.

    evidence has case_id, field_name, value, evidence_type, page_index, top, watermark, correction.
    """
    kept = evidence.filter(~F.coalesce("watermark", F.lit(False)))
    approval = (F.col("field_name") == "adjudication") & (F.col("value") == "APPROVED") & (F.col("evidence_type") == "signed_manual_note") & F.col("correction")
    latest = kept.filter(approval).groupBy("case_id").agg(F.max(F.struct("page_index", "top")).alias("_latest"))
    kept = kept.join(latest, "case_id", "left")
    undone = F.coalesce((F.col("field_name") == "adjudication") & (F.col("value") == "DENIED") & (F.col("evidence_type") == "adjudicator_stamp") & (F.struct("page_index", "top") < F.col("_latest")), F.lit(False))
    kept = kept.withColumn("_undone", undone)
    marks = kept.filter("_undone").select("case_id").distinct().withColumn("rescinded", F.lit(True))
    return kept.filter("not _undone").drop("_undone", "_latest").join(marks, "case_id", "left").withColumn("rescinded", F.coalesce("rescinded", F.lit(False)))


def resolve_all(evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """States of all fields (a small table, field_name) of all cases that have evidence; without any a field is unknown."""
    every = evidence.select("case_id").distinct().crossJoin(F.broadcast(fields))  # the list of fields is fixed and short
    out = every.join(resolve(evidence), ["case_id", "field_name"], "left")
    return out.withColumns({"state": F.coalesce("state", F.lit("unknown")), "considered": F.coalesce("considered", F.lit(0).cast("long"))})


def winners(evidence: DataFrame) -> DataFrame:
    """The winning row of each resolved field: among those of the resolved value and rank, and of these only corrections if there are any, the most confident, then the later page, then the lower on it."""
    from attestor.operators.resolve import eligible

    found = resolve(evidence).filter("state = 'resolved'").select(F.col("case_id").alias("_c"), F.col("field_name").alias("_f"), F.col("value").alias("_v"), F.col("winning_rank").alias("_r"))
    rows = evidence.filter(eligible(evidence)).join(found, (F.col("case_id") == F.col("_c")) & (F.col("field_name") == F.col("_f")) & (F.col("rank") == F.col("_r")) & (F.col("value") == F.col("_v")))
    fix = F.coalesce("correction", F.lit(False)).alias("_fix")  # corrections of this rank decide: all have the resolved value
    return rows.groupBy("case_id", "field_name").agg(F.max(F.struct(fix, "ocr_confidence", "page_index", "top")).alias("w"), F.first("value").alias("value")).select("case_id", "field_name", "value", "w.*").drop("_fix")


def state_lists(resolved: DataFrame) -> DataFrame:
    """Contested and unknown fields of each case, sorted."""
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("field_name"))))
    return resolved.groupBy("case_id").agg(pick("contested").alias("contested"), pick("unknown").alias("unknown"))


def majority(votes: DataFrame, least: int = 3) -> DataFrame:
    """(case_id, field_name, value, votes) where at least `least` votes all agree."""
    agg = votes.filter("value is not null").groupBy("case_id", "field_name").agg(F.count("*").alias("votes"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return agg.filter((F.col("votes") >= least) & (F.col("lo") == F.col("hi"))).select("case_id", "field_name", F.col("lo").alias("value"), "votes")


def union_flags(observations: DataFrame) -> DataFrame:
    """(case_id, flags): sorted union of pipe-joined flags of each case; those scoped to the case if there are any, else the unscoped."""
    from attestor.functions.text import split_flags

    rows = observations.select("case_id", F.coalesce("scoped", F.lit(False)).alias("scoped"), F.explode(split_flags(F.col("value"))).alias("flag")).distinct()
    best = rows.groupBy("case_id").agg(F.max("scoped").alias("_any"), F.array_sort(F.collect_set(F.when(F.col("scoped"), F.col("flag")))).alias("a"), F.array_sort(F.collect_set("flag")).alias("b"))
    return best.select("case_id", F.array_join(F.when(F.col("_any"), F.col("a")).otherwise(F.col("b")), "|").alias("flags"))
