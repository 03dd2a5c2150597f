"""Submissions and artifacts as files: reading by content, and canonical writing."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import vocab

HEADER = ["case_id", *vocab.OUTPUT_FIELDS, "adjudication", "confidence"]
#: Keys of a JSON object under which its rows may stand.
ROW_KEYS = ("predictions", "submission", "results", "cases")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_csv_strict(spark: SparkSession, path: str, header: Sequence[str] = HEADER) -> DataFrame:
    """As read_csv; the header must be exactly this."""
    rows = read_csv(spark, path)
    if rows.columns != list(header):
        raise ValueError(f"CSV columns must be {','.join(header)}")
    return rows


def read_jsonl(spark: SparkSession, path: str, columns: Sequence[str] = HEADER) -> DataFrame:
    """JSON lines, blank ones skipped; other columns are left out, missing ones null, a broken line is an error."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, columns: Sequence[str] = HEADER) -> DataFrame:
    """One JSON document: a list of rows, an object with a list under one of ROW_KEYS, a single row, or a map of case_id to row."""
    row = "struct<" + ",".join(f"{c}:string" for c in columns) + ">"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<{row}>")
    keyed = F.from_json("v", "struct<" + ",".join(f"{k}:array<{row}>" for k in ROW_KEYS) + ">")
    found = F.coalesce(*[keyed[k] for k in ROW_KEYS])
    single = F.from_json("v", row)
    mapped = F.transform(F.map_entries(F.from_json("v", f"map<string,{row}>")), lambda e: e["value"].withField("case_id", F.coalesce(e["value"]["case_id"], e["key"])))
    rows = F.when(F.col("v").startswith("["), listed).when(found.isNotNull(), found).when(single["case_id"].isNotNull(), F.array(single)).otherwise(F.filter(mapped, lambda r: r.isNotNull()))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """By suffix, else by the first character: JSON, JSON lines or CSV."""
    low = path.lower()
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".jsonl"):
        return read_jsonl(spark, path)
    if low.endswith(".json"):
        return read_json(spark, path)
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    start = first[0][0].lstrip()[:1] if first else ""
    return read_json(spark, path) if start in ("[", "{") else read_csv(spark, path)


def discover(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, name, length) of the files right in the folder whose name ends so in any case, in order of name; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return found.filter(F.lower("name").endswith(suffix)).orderBy(F.lower("name"), "name")


def read_tsv_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of a TSV without quoting: level 5, with text, confidence of 0 or more and an area; confidence to [0, 1]."""
    columns = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
    rows = spark.read.csv(path, schema=columns, sep="\t", header=True, quote="", mode="DROPMALFORMED")
    rows = rows.filter("level = 5 AND trim(text) <> '' AND conf >= 0 AND width > 0 AND height > 0")
    box = [F.col("left").alias("l"), F.col("top").alias("b"), (F.col("left") + F.col("width")).alias("r"), (F.col("top") + F.col("height")).alias("t")]
    return rows.select((F.col("page_num") - 1).alias("page_index"), "block_num", F.col("par_num").alias("paragraph_num"), "line_num", "word_num", F.trim("text").alias("text"), F.least(F.lit(1.0), F.col("conf") / 100).alias("confidence"), *box)


def canonical_json(rows: DataFrame, columns: Sequence[str] = HEADER) -> DataFrame:
    """(case_id, value): compact JSON of the columns in order, nulls left out."""
    return rows.select("case_id", F.to_json(F.struct(*columns)).alias("value"))


def write_jsonl(rows: DataFrame, path: str, columns: Sequence[str] = HEADER) -> None:
    """Canonical JSON lines sorted by case_id over all files; a repeated case_id is an error before anything is written."""
    again = rows.groupBy("case_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"case_id {again[0][0]} is there {again[0][1]} times")
    canonical_json(rows, columns).orderBy("case_id").select("value").write.text(path)


def load_artifact(path: str, keys: Sequence[str], checksum: str | None = None) -> dict:
    """A small JSON artifact with exactly these keys and, if given, this canonical SHA-256."""
    import hashlib

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if sorted(data) != sorted(keys):
        raise ValueError(f"artifact keys must be {sorted(keys)}")
    digest = hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
    if checksum and digest != checksum:
        raise ValueError("artifact checksum differs")
    return data
