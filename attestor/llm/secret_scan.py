"""Secret scans, in DataFrame functions only: fixed patterns, and two character Markov models.

Matches of a pattern and the text between them alternate, so running sums of
their lengths give each match's place in code points.  The method proper scores long runs of
identifier characters: a first-order Markov model of random strings and one of
ordinary identifiers, each trained from labelled samples, are compared by the
log-likelihood ratio; what is likelier random by `threshold` nats is a span too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, power, running, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Least lengths are in the patterns where that finds the same matches: both take whole runs of their class.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the Markov models look at, and the classes of its characters; 0 stands for any other.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
CLASSES = "0" + LOWER + UPPER + "0123456789" + "+/_=-"
SIZE = len(CLASSES)
#: Most documents that ordinary identifiers are sampled from, by least hash, and the number of random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_RANDOM = 2_000, 1_000
#: What counts as an ordinary identifier: parts of letters, each in lower case or with a capital, or all in capitals; few digits, at the end.
IDENTIFIER = r"(?<![A-Za-z0-9_-])(?:[A-Za-z]?[a-z]+(?:[_-][A-Za-z]?[a-z]+|[A-Z][a-z]+)*|[A-Z]{2,}(?:_[A-Z]{2,})+)[0-9]{0,4}(?![A-Za-z0-9_-])"
IDENTIFIER_LENGTH = 8
THRESHOLD = 12.0
#: Weight of a class's own frequency against the pairs seen.
BACK_OFF = 20.0

def _matches(text: Column, pattern: str, value: int | None = None) -> Column:
    """(n, m, word, v) of each match: code points from the end of the match before to its end, its own length and text, and the length of a group.  Empty where there is none."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(between, found, lambda g, m: F.struct((F.char_length(g) + F.char_length(m)).alias("n"), F.char_length(m).alias("m"), m.alias("word")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    v = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else F.lit(None).cast("array<string>")
    pairs = F.zip_with(pairs, F.coalesce(v, F.array().cast("array<string>")), lambda x, y: F.struct(x["n"].alias("n"), x["m"].alias("m"), x["word"].alias("word"), F.char_length(y).alias("v")))
    return F.when(text.rlike(pattern), pairs).otherwise(F.expr("cast(array() as array<struct<n:int,m:int,word:string,v:int>>)"))


def _spans(df: DataFrame, out: str, pattern: str, kind: str, rank: int, value: int | None = None, least: int = 0) -> DataFrame:
    """df with out: the spans (start, rank, kind, end, word) of the matches in _t, of those whose group `value` has `least` characters.

    Places are running sums over the lengths of matches and of what is between
    them: one pass over the text whatever the number of matches.  The matches
    stand in a column of their own; it is referred to more than once, so
    Catalyst doesn't move it into the lambdas, where it would be computed anew.
    """
    df = df.withColumn("_m", _matches(F.col("_t"), pattern, value))
    ends = running(F.transform("_m", lambda x: x["n"]), F.size("_m"), lambda a, b: a + b)
    spans = F.zip_with(ends, "_m", lambda e, x: F.struct((e - x["m"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["word"].alias("word"), x["v"].alias("v")))
    return df.withColumn(out, F.filter(spans, lambda x: F.coalesce(x["v"] >= least, F.lit(True)))).drop("_m")


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def _base(df: DataFrame) -> DataFrame:
    """df with _base, the fixed kinds' spans in order: assign with a value of 6 characters or more, access of 20 or more, hex of 24 or more."""
    df = _spans(df, "_assign", ASSIGN, "assign", 0, 2, 6)
    df = _spans(_spans(df, "_access", ACCESS, "access", 1), "_hex", HEX, "hex", 2)
    return df.withColumn("_base", F.array_sort(F.concat(_bare("_assign"), _bare("_access"), _bare("_hex")))).drop("_assign", "_access", "_hex")


def _rank(sorted_: str, x: Column, upto: bool) -> Column:
    """How many of the sorted array's values are less than x (or at most x), by halving steps."""
    size = F.size(sorted_)

    def step(at: Column, k: Column) -> Column:
        to = at + power(k)
        v = F.get(sorted_, to - 1)
        return F.when((to <= size) & ((v <= x) if upto else (v < x)), to).otherwise(at)

    return F.aggregate(F.sequence(F.length(F.bin(size)), F.lit(0), F.lit(-1)), F.lit(0), step)


def _classes(word: Column) -> Column:
    """Class number of each character."""
    return F.transform(F.split(word, ""), lambda c: F.greatest(F.instr(F.lit(CLASSES), c) - 1, F.lit(0)))


def random_samples(spark, n: int = SAMPLE_RANDOM) -> DataFrame:
    """Labelled random strings (word): n each of base64, upper-case and digits, and lower-case hex, from hashes of a counter."""
    base = spark.range(n).select(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256).alias("h"))
    wide = F.base64(F.unhex("h"))
    return base.select(F.explode(F.array(F.substring(wide, 1, 40), F.translate(F.upper(F.substring(wide, 1, 20)), "+/=", "ABC"), F.substring("h", 1, 32))).alias("word"))


def identifier_samples(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """Ordinary identifiers (word) of at most `most` documents, those with the least hash; what a fixed pattern takes is left out."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hashed = rows.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(most)
    rows = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(hashed), "h").dropDuplicates(["h"])
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    return rows.select(F.explode_outer(F.regexp_extract_all(clean, F.lit(IDENTIFIER), F.lit(0))).alias("word")).filter(F.char_length("word") >= IDENTIFIER_LENGTH)


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of classes (a * SIZE + b), smoothed; at most SIZE * SIZE counts come to the driver."""
    counted = []
    for words in (random, ordinary):
        pairs = words.select(_classes(F.col("word")).alias("c")).select(
            F.explode_outer(F.when(F.size("c") > 1, F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * SIZE + F.get("c", i + 1)))).alias("p")
        )
        counted.append({r["p"]: r["count"] for r in pairs.filter("p is not null").groupBy("p").count().collect()})
    return [round(x - y, 4) for x, y in zip(*map(_log_chances, counted), strict=True)]


def _log_chances(pairs: dict) -> list[float]:
    """Log chance of each class after each other; a pair seen seldom or never goes by how frequent its second class is."""
    after = [sum(pairs.get(a * SIZE + b, 0) for a in range(SIZE)) for b in range(SIZE)]
    base = [(n + 0.1) / (sum(after) + 0.1 * SIZE) for n in after]
    out = []
    for a in range(SIZE):
        total = sum(pairs.get(a * SIZE + b, 0) for b in range(SIZE))
        out += [math.log((pairs.get(a * SIZE + b, 0) + BACK_OFF * base[b]) / (total + BACK_OFF)) for b in range(SIZE)]
    return out


def ratio(word: Column, model: list[float]) -> Column:
    """Sum of the ratios of a word's pairs of characters."""
    weights = F.from_json(F.lit(str(model)), "array<double>")
    return F.aggregate(
        _classes(word),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(weights, acc["last"] * SIZE + c))).alias("sum")),
        lambda acc: acc["sum"],
    )


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, base, spans) of each row: spans are (start, rank, kind, end), code points with the end exclusive, by start and kind.

    base holds the fixed kinds; spans also the runs that the models take for
    random and that no fixed span overlaps.  Null and empty texts have none;
    repeated rows are all returned; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = _spans(_base(rows), "_runs", RUN, "markov", 3).drop("_t")
    rows = rows.withColumns({"_starts": F.array_sort(F.transform("_base", lambda s: s["start"])), "_ends": F.array_sort(F.transform("_base", lambda s: s["end"]))})
    # a base span overlaps a run if it starts before the run's end and doesn't end before its start
    free = lambda r: _rank("_starts", r["end"], False) == _rank("_ends", r["start"], True)
    rows = rows.withColumn("_runs", F.filter("_runs", free))
    rows = rows.withColumn("_runs", F.filter("_runs", lambda r: ratio(r["word"], model) > threshold))
    return rows.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.array_sort(F.concat(F.col("_base"), _bare("_runs"))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(random_samples(spark), identifier_samples(docs)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
