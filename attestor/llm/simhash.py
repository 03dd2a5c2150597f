"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A covering family for radius r has 2**(r + 1) - 1 bit masks: bit i carries a
non-zero vector of r + 1 bits, and mask v holds the bits whose vector has odd
parity with v.  The vectors of any r bits span less than the whole space, so
some v is orthogonal to them all: two fingerprints that differ in r bits or
fewer agree under that mask.  No linked pair is missed, in any table.

Only distinct fingerprints are compared.  Those that agree under a mask form a
bucket; a bucket of up to `group` is searched in one go and gives the edges of a
spanning forest, not its pairs.  A larger one is searched without being
gathered: each fingerprint names the points around it within r - r // 2 flips
of the bits outside the mask, and linked ones meet in a point that is within
r // 2 flips of one of them.  Components come from rounds of large and small
stars over the edges, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, in_batches, local_rows, stored, table, unused

#: Most distinct fingerprints of a bucket that are gathered.
GROUP = 10_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits: a bit is 1 if set in over half of the shingles' hashes.  Fewer words are one shingle; none give 0."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, same, fp) of each row; same is the text's hash, fp the fingerprint as a signed integer.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py().encode(), words, seed) for t in column(batch, "text")], np.uint64)
            yield pa.record_batch([batch.column("id"), batch.column("same"), pa.array(fps.view(np.int64))], names=["id", "same", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_batches(rows.withColumn("same", F.xxhash64("text")).select("id", "same", "text"), run, "id long, same long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    size = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if bin(v & (i % size + 1)).count("1") % 2) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(members: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges (member, least member of its part) of the graph of members within the radius."""
    members = np.sort(members)
    root = np.arange(len(members))
    bits = members.view(np.uint64)
    step = max(1, (1 << 20) // len(members))
    for a in range(0, len(members), step):
        i, j = np.nonzero(np.bitwise_count(bits[a : a + step, None] ^ bits[None, a:]) <= radius)
        i, j = i + a, j + a
        i, j = i[i < j], j[i < j]
        while len(i):  # hang the greater root below the lesser one until none differ
            ri, rj = root[i], root[j]
            ri, rj = np.minimum(ri, rj), np.maximum(ri, rj)
            live = ri != rj
            if not live.any():
                break
            np.minimum.at(root, rj[live], ri[live])
            while (root[root] != root).any():
                root = root[root]
    moved = np.nonzero(root != np.arange(len(members)))[0]
    return members[moved].tolist(), members[root[moved]].tolist()


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            hi: list = []
            lo: list = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a == 2:
                    x, y = int(values[a]), int(values[a + 1])
                    if (x ^ y).bit_count() <= radius if (x >= 0) == (y >= 0) else ((x ^ y) & (1 << 64) - 1).bit_count() <= radius:
                        hi.append(max(x, y))
                        lo.append(min(x, y))
                    continue
                u, v = _forest(values[a:b].astype(np.int64), radius)
                hi += u
                lo += v
            yield pa.record_batch([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """Edges (u, v), u > v, that connect whatever fingerprints (column fp, distinct) within the radius connect."""
    spark = distinct.sparkSession
    every = masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key")) for i, x in enumerate(every)])
    dealt = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.m", "t.key")
    counts = dealt.groupBy("m", "key").count().filter("count > 1")
    small = dealt.join(counts.filter(F.col("count") <= group).drop("count"), ["m", "key"]).groupBy("m", "key").agg(F.collect_list("fp").alias("fps"))
    edges = in_batches(small.select("fps"), _bucket_edges(radius), "u long, v long")
    large = counts.filter(F.col("count") > group).drop("count")
    if large.isEmpty():
        return edges.distinct()
    near, far = radius // 2, radius - radius // 2
    flips = [(i, signed(sum(1 << b for b in c)), n) for i, x in enumerate(every) for n in range(far + 1) for c in combinations([b for b in range(64) if not x >> b & 1], n)]
    around = F.broadcast(local_rows(spark, flips, "m int, flip long, n int"))  # bounded by the masks: some hundreds for each
    points = dealt.join(large, ["m", "key"]).join(around, "m").select("m", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp", "n")
    centre = points.filter(F.col("n") <= near).groupBy("m", "z").agg(F.min("fp").alias("rep"))
    met = points.join(centre, ["m", "z"]).filter("fp != rep").select(F.greatest("fp", "rep").alias("u"), F.least("fp", "rep").alias("v"))
    return edges.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each node u of the graph that isn't the least of its component; v is the least.  Edges have u > v.

    Large star: a node's greater neighbours go to its least neighbour; small
    star: its lesser neighbours and itself do.  Ends when a round changes nothing.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    edges = stored(edges.distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        moved = star.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 3, group: int = GROUP) -> DataFrame:
    """(id, same, fp, root, component) of each row: root is the least fingerprint of its component, component the least id.

    Null and empty texts have fingerprint 0 and are linked like any other.
    Null ids take part; a component of nothing else has a null component.
    Repeated rows are all returned.  No other column is read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(distinct.select("fp"), radius, group))
    nodes = found.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    rooted = distinct.join(nodes, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(rooted.select("fp", "root").join(by_root, "root"), "fp").select("id", "same", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, one row of each component: the least id's (of equal ids the least text hash's, of equal rows any)."""
    found = stored(cluster(docs, id_col, text_col, **how), "clusters")
    kid, ksame, same = unused(docs, "_kid", "_ksame", "_same")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "same")).alias("k")).select(F.col("k.id").alias(kid), F.col("k.same").alias(ksame))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col(kid)) & (key == F.col(ksame)), "left_semi")
    if found.groupBy("id", "same").count().filter("count > 1").isEmpty():
        return out
    return out.withColumn(same, key).dropDuplicates([id_col, same]).drop(same)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents."""
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
