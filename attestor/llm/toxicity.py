"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy
from confirmed toxic documents and ones whose labels are not looked at.  The risk is corrected by
the class prior p: p R+(positives) + max(0, R-(unlabelled) - p R-(positives));
where the second term would be negative, the step goes against it instead, so
the classifier can't fit the unlabelled documents as if all were clean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_codes, gather, in_batches, stored, table, text_parts

#: Feature space, and the lengths of word beginnings that are features besides whole words.
BITS, PREFIXES = 18, (4, 5, 6, 7)
#: Most labelled documents that training reads: confirmed toxic ones, ones whose label is not looked at, and ones of the calibration fold.  Each by least seeded hash.
POSITIVES, UNLABELLED, CALIBRATION = 2_000, 4_000, 4_000
#: What a sampled document is for.
POSITIVE, ANY, CHECK = 0, 1, 2
#: Of the folds by crc32 of the id as text, the first is held out and the second only calibrates the score.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
#: A feature is in this share of the positives at least (and in 3), and in at most that share of clean documents.
LEAST, MOST = 0.02, 0.25
NORM = 0.4
EDGES = ".,;:!?\"'()[]{}<>*_-"


def folded(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), EDGES)


class Features:
    """Feature numbers of distinct words, remembered up to a bound; with `keep`, only those marked there."""

    def __init__(self, keep: np.ndarray | None = None, room: int = 100_000) -> None:
        self.keep, self.room, self.known = keep, room, {}

    def of(self, word: str) -> tuple:
        found = self.known.get(word)
        if found is None:
            mask = (1 << BITS) - 1
            found = {zlib.crc32(word.encode()) & mask, *(zlib.crc32(word[:n].encode(), n) & mask for n in PREFIXES if len(word) > n)} if word else ()
            found = tuple(found if self.keep is None else (f for f in found if self.keep[f]))
            if len(self.known) < self.room:
                self.known[word] = found
        return found

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse matrix as (row, feature, value): each feature once a row, log(1 + count) / (words of the row) ** NORM."""
        rows, codes, distinct = chunk_codes(texts)
        per = [self.of(w) for w in folded(distinct).to_pylist()]
        lengths = np.fromiter(map(len, per), np.int64, len(per))
        flat = np.fromiter((f for x in per for f in x), np.int64)
        values, begins = gather(np.cumsum(lengths) - lengths, lengths, flat, codes)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(begins[rows]))
        pair, n = np.unique(row << BITS | values, return_counts=True)
        row = pair >> BITS
        return row, pair & ((1 << BITS) - 1), np.log1p(n) / np.maximum(1, np.diff(rows))[row] ** NORM


class Sparse:
    """Rows of (feature, value) pairs: row, col and val one after another, n rows."""

    def __init__(self, rows: list[tuple[bytes, bytes]]) -> None:
        cols = [np.frombuffer(c, np.int32) for c, _ in rows]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(c) for c in cols]).astype(np.int64)
        self.col = np.concatenate([np.zeros(0, np.int32), *cols]).astype(np.int64)
        self.val = np.concatenate([np.zeros(0), *(np.frombuffer(v) for _, v in rows)])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, self.n) + b

    def spread(self, d: np.ndarray, size: int) -> np.ndarray:
        """Derivative by weight, of derivatives by score."""
        return np.bincount(self.col, d[self.row] * self.val, size)


def risk(w: np.ndarray, b: float, pos: Sparse, unl: Sparse, prior: float, decay: float) -> tuple[float, float, np.ndarray, float]:
    """The positive part (with decay), the negative part, and the gradient by weight and bias of the step to take: of their sum where the negative part is not negative, else of its reverse."""
    zp, zu = pos.scores(w, b), unl.scores(w, b)
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive = prior * np.logaddexp(0, -zp).sum() / pos.n + decay * (w * w).sum() / 2
    negative = np.logaddexp(0, zu).sum() / unl.n - prior * np.logaddexp(0, zp).sum() / pos.n
    dp, du = -prior * sp / pos.n, su / unl.n  # of the negative part
    dp, du = (dp - prior * (1 - sp) / pos.n, du) if negative >= 0 else (-dp, -du)
    return positive, negative, pos.spread(dp, len(w)) + unl.spread(du, len(w)) + decay * w, dp.sum() + du.sum()


def train(pos: Sparse, unl: Sparse, prior: float, steps: int = 100, rate: float = 0.3, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by full-batch Adagrad from zero: the same data give the same model."""
    w, b = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    gw2, gb2 = np.full(len(w), 1e-8), 1e-8
    for _ in range(steps):
        _, _, g, gb = risk(w, b, pos, unl, prior, decay)
        gw2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(gw2)
        b -= rate * gb / np.sqrt(gb2)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over raw scores, with targets drawn in as there are few of either kind."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    mid, scale = float(z.mean()), float(z.std()) or 1.0
    x, t = (z - mid) / scale, np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, float(np.log(n1 / n0))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([((t - p) * x).sum(), (t - p).sum()]))
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, c = a + float(step[0]), c + float(step[1])
    if a <= 0:
        return 1.0, 0.0
    return a / scale, c - a * mid / scale


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 42, positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> dict | None:
    """The model, or None without any confirmed toxic document to learn from.

    Learns from at most positives + unlabelled + calibration labelled documents,
    whole, those with the least seeded hash of the id; rows with a null id or in
    the held-out fold are not among them.  Of several labels of a document the
    greatest counts; different texts of one id are documents of their own,
    repeated rows are one.  Texts stay in the tasks: the driver gets counts of
    features, then the numbers of those kept.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.col("_id").isNotNull())
    rows = rows.withColumn("_fold", fold("_id")).filter(F.col("_fold") != HELD_OUT).withColumn("same", F.xxhash64("text"))
    marks = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y")).filter("_y is not null").groupBy("_lid").agg(F.max("_y").alias("_y"))
    marked = rows.select("_id", "same", "_fold").distinct().join(marks, F.col("_id") == F.col("_lid")).withColumn("place", F.xxhash64(F.lit(seed), "_id"))
    marked = stored(marked.select("_id", "same", "_y", "place", (F.col("_fold") == CALIBRATES).alias("_cal")), "marked")
    shares = {r["_cal"]: r for r in marked.groupBy("_cal").agg(F.avg("_y").alias("share"), F.sum("_y").alias("n")).collect()}
    if not shares.get(False) or not shares[False]["n"]:
        return None
    prior = min(0.9, max(0.001, shares[False]["share"]))

    def least(ids: DataFrame, use: int, most: int) -> DataFrame:
        return ids.orderBy("place", "_id", "same").limit(most).select(F.col("_id").alias("_k"), F.col("same").alias("_s"), "place", F.lit(use).alias("use"), F.col("_y").alias("y"))

    learn = marked.filter(~F.col("_cal"))
    chosen = least(learn.filter("_y = 1"), POSITIVE, positives).unionByName(least(learn, ANY, unlabelled)).unionByName(least(marked.filter("_cal"), CHECK, calibration))
    few = rows.join(F.broadcast(chosen), (F.col("_id") == F.col("_k")) & (F.col("same") == F.col("_s")))
    few = stored(few.select("_id", "same", "place", "use", "y", "text").dropDuplicates(["_id", "same", "use"]).drop("_id"), "sample")
    size = {r["use"]: r["count"] for r in few.groupBy("use").count().collect()}
    n = lambda use: F.coalesce(F.sum(F.when(F.col("use") == use, F.col("n"))), F.lit(0))
    counts = in_batches(few.filter(F.col("use") != CHECK).select("use", "text"), _counts, "use int, feature int, n long").groupBy("feature").agg(n(POSITIVE).alias("p"), n(ANY).alias("u"))
    clean = (F.col("u") / size[ANY] - prior * F.col("p") / size[POSITIVE]) / (1 - prior)  # the share of clean documents, by the same correction
    kept = counts.filter((F.col("p") >= max(3, LEAST * size[POSITIVE])) & (clean <= MOST)).select("feature").collect()
    keep = np.zeros(1 << BITS, bool)
    keep[[r["feature"] for r in kept]] = True
    shipped = docs.sparkSession.sparkContext.broadcast(np.packbits(keep).tobytes())
    found = in_batches(few, _numbers(shipped), "use int, place long, same long, y int, cols binary, vals binary").collect()
    parts = {use: sorted((r for r in found if r["use"] == use), key=lambda r: (r["place"], r["same"])) for use in (POSITIVE, ANY, CHECK)}
    pos, unl, check = (Sparse([(bytes(r["cols"]), bytes(r["vals"])) for r in parts[use]]) for use in (POSITIVE, ANY, CHECK))
    w, b = train(pos, unl, prior)
    slope, offset = calibrate(check.scores(w, b), np.array([int(r["y"] > 0) for r in parts[CHECK]])) if check.n else (1.0, 0.0)
    return {"weights": (w * slope).astype(np.float32).tobytes(), "bias": float(b * slope + offset)}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each use, in how many of the texts a feature is."""
    features, n = Features(), np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for a, b, texts in text_parts(batch, most=1 << 19):
            row, col, _ = features.rows(texts)
            use = batch.column("use").slice(a, b - a).to_numpy()
            for u in (POSITIVE, ANY):
                n[u] += np.bincount(col[use[row] == u], minlength=1 << BITS)
    for u in (POSITIVE, ANY):
        at = np.nonzero(n[u])[0]
        yield pa.record_batch([pa.array(np.full(len(at), u, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[u][at])], names=["use", "feature", "n"])


def _numbers(keep):
    """Kept features of each text and their values, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(np.unpackbits(np.frombuffer(keep.value, np.uint8)).astype(bool))
        for batch in batches:
            for a, b, texts in text_parts(batch, most=1 << 19):
                row, col, val = features.rows(texts)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                pieces = [[x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)] for x in (col.astype(np.int32), val)]
                same = [batch.column(c).slice(a, b - a) for c in ("use", "place", "same", "y")]
                yield pa.record_batch([*same, *(pa.array(p, pa.binary()) for p in pieces)], names=["use", "place", "same", "y", "cols", "vals"])

    return run


class Scorer:
    def __init__(self, model: dict) -> None:
        self.w, self.b = np.frombuffer(model["weights"], np.float32).astype(np.float64), model["bias"]
        self.features = Features(self.w != 0)

    def __call__(self, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
        out = np.zeros(batch.num_rows)
        for a, b, texts in text_parts(batch, text_col, 2 << 20):
            row, col, val = self.features.rows(texts)
            out[a:b] = 1 / (1 + np.exp(-np.clip(np.bincount(row, self.w[col] * val, b - a) + self.b, -30, 30)))
        return out


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row; null texts count as empty, which get the score of no feature.  Without a model every score is 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            s = scorer(batch, "text")
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_batches(rows, run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score 0.5 or more.  No shuffle: batches are scored and filtered where they are."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch, text_col) < 0.5))

    return in_batches(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted")
