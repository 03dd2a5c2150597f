"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import decontaminate, mixing, simhash, token_store, toxicity
from attestor.llm.common import space_words, stored, table, unused


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5.  Null and empty texts have no feature and score by the bias alone; each repeated row is judged by its text."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, null last; of repeated rows one.  Null and empty texts are one group, with all whose fingerprint is near zero."""
    return simhash.keep_one(docs)


def drop_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; rows of one id, or of none, are told apart by their texts.  Null and empty texts have no window and stay, repeated rows stay or go together."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    bad, bad_same = unused(docs, "_bad", "_bad_same")
    hit = found.select(F.col("doc_id").alias(bad), F.col("_same").alias(bad_same)).distinct()
    same = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col(bad)) & (same == F.col(bad_same)), "left_anti")


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.  A null source is a source of its own; null and empty texts have size 0; repeated rows stand and fall together."""
    copies = F.col(mixing.added(docs)[1])
    mixed = mixing.mix(docs, F.array("source"), space_words(F.col("text")))
    return mixed.filter(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(unused(docs, "_copy")[0])).select(*docs.columns)


def token_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written, and what they hold of each document.  Null and empty texts have just the end id; each repeated row is a document."""
    return token_store.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
