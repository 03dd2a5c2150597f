"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every k-gram of words is hashed; from each run of w = window - k + 1 hashes the
least is kept.  A shared span of `window` words holds such a run on both sides,
so both sides keep the same k-gram of it: the join on kept hashes misses no
window.  Each joint fingerprint is then extended word by word, at most w - 1
words to either side, and counts if the run has `window` words.  The words
themselves are compared, so hash collisions do no harm.

The documents are read once for each block of benchmark fingerprints, those of
items shorter than a window included; a block is broadcast and has about
`block_rows` of them.  Documents' fingerprints are
never shuffled: what is grouped is one marker row per document and its hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, lower_ascii, running

#: Most fingerprints of the benchmark in one broadcast, about 300 bytes each.
BLOCK_ROWS = 200_000
#: Words of a stretch of a document, besides the overlap.
STRETCH = 1024
#: Key of the marker rows; a fingerprint that happens to be the same meets no item there.
MARK = -6_148_914_691_236_517_206


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD, -1), "")


def _runs(df: DataFrame, source: str, count: Column, length: int, out: str, join) -> DataFrame:
    """df with column out: join over each run of `length` elements of the array `source`, which has `count` of them.

    Runs of 1, 2, 4 ... elements are joined from two halves, the last pair
    overlapping, so a lambda looks at two elements and there are log2(length) passes.
    """
    have, names = 1, source
    while have < length:
        step = min(have, length - have)
        left = F.greatest(count - (have + step) + 1, F.lit(0))
        new = f"{out}_{have + step}"
        a, b = F.slice(names, F.lit(1), left), F.slice(names, F.lit(step + 1), left)
        df = df.withColumn(new, F.zip_with(a, b, join))
        have, names = have + step, new
    return df.withColumn(out, F.col(names))


def _hashes(df: DataFrame, k: int) -> DataFrame:
    """_h: hash of each k-gram of _words; empty if there are fewer."""
    if k == 1:
        return df.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    return _runs(df, "_words", F.size("_words"), k, "_h", lambda x, y: F.xxhash64(x, y))


def _stretches(docs: DataFrame, overlap: int, length: int = STRETCH) -> DataFrame:
    """_id, _same, _n (words of the document) and a row for each stretch of it: _off, where it begins, and _words.

    Stretches overlap, so that each window lies whole in one.  What a hit
    carries along is a stretch, not the document, however long that is.
    """
    docs = docs.withColumn("_words", words_of(F.col("_text"))).withColumn("_n", F.size("_words"))
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - overlap - 1) / length)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct((j * length).alias("off"), F.slice("_words", j * length + 1, F.lit(length + overlap)).alias("words")))
    docs = docs.select("_id", F.xxhash64("_text").alias("_same"), "_n", F.explode_outer(parts).alias("_part"))
    return docs.select("_id", "_same", "_n", F.col("_part.off").alias("_off"), F.col("_part.words").alias("_words"))


def _fingerprinted(df: DataFrame, k: int, w: int) -> DataFrame:
    """df, which has _words, with _h and _fps, the distinct kept hashes.  Each step refers to the one before more than once, so Catalyst keeps them apart."""
    df = _runs(_hashes(df, k), "_h", F.greatest(F.size("_words") - (k - 1), F.lit(0)), w, "_m", lambda x, y: F.least(x, y))
    return df.withColumn("_fps", F.array_distinct("_m")).drop("_m")


def _places(hashes: str, key: str) -> Column:
    """Where the hash stands; few fingerprints have a partner, so places are looked up after the join, in a stretch."""
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(hashes, i) == F.col(key))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (distinct ids as strings, sorted), spans (merged [start, end) word ranges), _same (hash of the text, null as empty, which tells rows of one id apart).

    An item window is `window` consecutive words, or the whole item if it has
    fewer, but not none.  A word inside any occurrence of a window is hit.
    Null or empty texts have no words: n_words 0, nothing hit.  Null ids are a
    value like any other (an item's shows as ""); repeated rows each give a
    row; empty tables give no rows, or rows without hits.  Other columns of the
    inputs, whatever their names, are not read.
    """
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    w = window - k + 1
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("_item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("_text")).distinct()
    items = items.withColumn("_words", words_of(F.col("_text"))).withColumn("_n", F.size("_words"))
    span = window + w - 1  # k-gram with w - 1 words on either side
    grams = _fingerprinted(items.filter(F.col("_n") >= window).select("_item", "_words"), k, w)
    grams = grams.withColumn("_key", F.explode_outer("_fps")).withColumn("_q", F.explode_outer(_places("_h", "_key"))).select(
        F.lit(0).alias("_len"), "_key", "_item", F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda t: F.get("_words", F.col("_q") - (w - 1) + t)).alias("_ctx")
    )
    short = items.filter((F.col("_n") > 0) & (F.col("_n") < window))
    lengths = sorted(r[0] for r in short.select("_n").distinct().collect())  # at most window - 1 values
    for n in lengths:
        grams = grams.unionByName(_hashes(short.filter(F.col("_n") == n), n).select(F.lit(n).alias("_len"), F.get("_h", F.lit(0)).alias("_key"), "_item", F.col("_words").alias("_ctx")))
    # items that share a context are one row, however many they are
    grams = grams.groupBy("_len", "_key", "_ctx").agg(F.collect_set("_item").alias("_items"))
    found = [_hits(base, block, k, w, window, lengths, markers=i == 0) for i, block in enumerate(_blocks(grams, "_key", block_rows))]
    hits = reduce(DataFrame.unionByName, found)
    merged = (
        hits.groupBy("_id", "_same", "_n")
        .agg(F.sum("_copies").alias("_copies"), F.collect_set(F.when(F.col("_end") > 0, F.struct("_start", "_end"))).alias("_iv"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
        .withColumn("_iv", F.array_sort("_iv"))
    )
    merged = _union(merged, "_iv", "_spans")
    return merged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_hit"),
        F.array_sort("_items").alias("items"),
        F.col("_spans").alias("spans"),
        "_same",
    )


def _union(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with out: the sorted ranges of `name` merged where they overlap or touch.  A range begins a new one where it starts beyond the greatest end before it."""
    df = df.withColumn("_far", running(F.transform(name, lambda x: x["_end"]), F.size(name), lambda a, b: F.greatest(a, b)))
    df = df.withColumn("_first", F.filter(F.transform(name, lambda x, i: F.when((i == 0) | (x["_start"] > F.get("_far", i - 1)), i)), lambda i: i.isNotNull()))
    begin = F.transform("_first", lambda i: F.get(name, i)["_start"])
    end = F.transform("_first", lambda i, k: F.get("_far", F.coalesce(F.get("_first", k + 1), F.size("_far")) - 1))
    return df.withColumn(out, F.zip_with(begin, end, lambda a, b: F.struct(a.alias("start"), b.alias("end")))).drop("_far", "_first")


def _blocks(df: DataFrame, key: str, block_rows: int) -> list[DataFrame]:
    """df dealt by its key into blocks that are each about block_rows at most, so that each can be broadcast."""
    n = df.count()
    parts = max(1, -(-n // block_rows))
    return [df] if parts == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def _hits(base: DataFrame, block: DataFrame, k: int, w: int, window: int, lengths: list[int], markers: bool) -> DataFrame:
    """Occurrences of windows of 10 words (_len 0), found by kept hashes and extended, and of whole shorter items, found by the hashes of all their places; from one reading of the documents."""
    docs = _fingerprinted(_stretches(base, window - 1), k, w)
    print_ = lambda n: lambda h: F.struct(F.lit(n).alias("n"), h.alias("h"))
    none = F.array().cast("array<struct<n:int,h:bigint>>")
    fps, places = [F.transform("_fps", print_(0))], F.when(F.col("_len") == 0, _places("_h", "_key"))
    for n in lengths:
        docs = _hashes(docs.withColumnRenamed("_h", "_long"), n).withColumnRenamed("_h", f"_h{n}").withColumnRenamed("_long", "_h")
        fps.append(F.transform(F.array_distinct(f"_h{n}"), print_(n)))
        places = places.when(F.col("_len") == n, _places(f"_h{n}", "_key"))
    if markers:  # one row for each document besides its fingerprints, so that it is there without any hit
        fps.append(F.when(F.col("_off") == 0, F.array(print_(-1)(F.lit(MARK)))).otherwise(none))
        places = places.otherwise(F.array(F.lit(-1)))
        mark = block.sparkSession.range(1).select(F.lit(-1).alias("_len"), F.lit(MARK).alias("_key"), F.lit(None).cast("array<string>").alias("_ctx"), F.lit(None).cast("array<string>").alias("_items"))
        block = block.unionByName(mark)
    # explode_outer, not explode: for the latter Catalyst infers a filter on the array's size, which it pushes
    # below the projections, so that the nested arrays are computed anew for each element of the outer ones
    docs = docs.withColumn("_fp", F.explode_outer(F.concat(*fps) if len(fps) > 1 else fps[0]))
    # an inner join: what has no partner goes before anything is copied, the words of the stretch above all
    both = docs.join(F.broadcast(block), (F.col("_fp.h") == F.col("_key")) & (F.col("_fp.n") == F.col("_len"))).withColumn("_p", F.explode_outer(places))
    same = F.transform(F.sequence(F.lit(0), F.lit(window + w - 2)), lambda t: F.when(F.get("_words", F.col("_p") - (w - 1) + t) == F.get("_ctx", t), "1").otherwise("0"))
    both = both.withColumn("_bits", F.when(F.col("_len") == 0, F.array_join(same, "")))
    before, gram, after = F.substring("_bits", 1, w - 1), F.substring("_bits", w, k), F.substring("_bits", w + k, w - 1)
    both = both.withColumn("_l", F.when(F.col("_len") > 0, 0).otherwise(F.length(before) - F.length(F.rtrim(before, F.lit("1")))))
    both = both.withColumn("_r", F.when(F.col("_len") > 0, F.col("_len") - k).otherwise(F.length(after) - F.length(F.ltrim(after, F.lit("1")))))
    whole = F.when(F.col("_len") > 0, F.forall(F.sequence(F.lit(0), F.size("_ctx") - 1), lambda t: F.get("_words", F.col("_p") + t) == F.get("_ctx", t)))
    both = both.withColumn("_ok", F.coalesce(whole, (gram == "1" * k) & (F.col("_l") + F.col("_r") + k >= window), F.lit(False)))
    return both.filter(F.col("_ok") | (F.col("_p") < 0)).select(
        "_id",
        "_same",
        "_n",
        F.when(F.col("_ok"), F.col("_off") + F.col("_p") - F.col("_l")).cast("long").alias("_start"),
        F.when(F.col("_ok"), F.col("_off") + F.col("_p") + k + F.col("_r")).cast("long").alias("_end"),
        F.when(F.col("_ok"), F.col("_items")).alias("_items"),
        F.when(F.col("_p") < 0, 1).otherwise(0).cast("long").alias("_copies"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: whole documents against the whole benchmark."""
    from .common import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dp),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
"""
