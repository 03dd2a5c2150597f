"""Token ids as Parquet list columns that can be read in parts.

Spark's own writer makes the files, so they land on any file system it knows
and a lost task's output is never seen.  Ids are 32-bit integers, dictionary-
encoded while the dictionary pays and otherwise as they are; row groups have at
most `group_bytes`, pages at most `page_rows` rows, and each has its index, so a
read of some doc_ids or of n_tokens alone skips the ids.

Encoding: a pre-tokeniser that drops white space splits there in any case, so
the ids of a text are those of its white-space-delimited chunks; by_chunk() tells
whether a tokenizer is of this kind, and texts of others are encoded whole.  Each distinct
chunk of a batch goes through the tokenizers library once, in joined strings,
and the most frequent ones stay in a bounded cache of the worker.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_codes, gather, in_batches, kept, scratch, slices, table, text_parts

#: Chunks that a worker keeps the ids of.
CACHE = 200_000
TOKENIZER = "word_bpe_49k.json"

#: Bytes of input for which there is a partition at least, and where that stops.
PART_BYTES, MOST_PARTS = 256 << 20, 100_000


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The tokenizer's file as text; name may be a path."""
    import os

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return f.read()


#: Normalisers that change nothing across white space.
PLAIN = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}


def by_chunk(spec: str) -> tuple[bool, bool]:
    """Whether the ids of a text are those of its white-space-delimited chunks, and whether letters are lower-cased, by what the tokenizer says of itself.

    True only where the normaliser is of known kinds (replacing nothing but
    white space by a space) and the first pre-tokeniser drops white space:
    by its kind, or as it keeps just what a pattern matches that can't match any.
    """
    steps = lambda x, of: [] if not x else x[of] if x["type"] == "Sequence" else [x]
    told = json.loads(spec)
    norms, pres = steps(told.get("normalizer"), "normalizers"), steps(told.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in PLAIN and (n["type"] != "Replace" or (n["pattern"].get("Regex"), n["content"]) == (r"\s+", " ")) for n in norms)
    first = pres[0] if pres else {"type": None}
    drops = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]:
        rest = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", first["pattern"].get("Regex", "."))  # classes that leave white space out
        drops = not re.search(r"\\s|\\S|\\[WDPX]|\[\^|\.|[ \t\n]|\(\?", rest)
    strips = any(t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens") or [])
    return plain and drops and not strips and (told.get("post_processor") or told.get("truncation") or told.get("padding")) is None, any(n["type"] == "Lowercase" for n in norms)


class ChunkEncoder:
    """Ids of texts, by distinct chunk where the tokenizer drops white space and no piece spans it; else of whole texts."""

    def __init__(self, spec: str, cache: int = CACHE) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_str(spec), cache
        self.chunked, self.lowers = by_chunk(spec)
        # ids of remembered chunks one after another, and for each its place and number of ids
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, and where each text begins (one more at the end)."""
        if not self.chunked:
            parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        rows, codes, distinct = chunk_codes(texts)
        if not len(distinct):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        # where ASCII letters are lower-cased by the tokenizer, doing it here makes fewer chunks
        plain = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<")))
        folded = (pc.if_else(plain, pc.ascii_lower(distinct), distinct) if self.lowers else distinct).dictionary_encode()
        codes = folded.indices.to_numpy().astype(np.int64)[codes]
        starts, lengths, flat = self._look_up(folded.dictionary.to_pylist())
        ids, begins = gather(starts, lengths, flat, codes)
        return ids, begins[rows]

    def _look_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk the place and number of its ids in an array of ids; new chunks are remembered while there is room."""
        get = self.slots.get
        slot = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        missing = np.nonzero(slot < 0)[0]
        new = [chunks[i] for i in missing.tolist()]
        n, ids = self._encode(new)
        at = len(self.ids) + np.cumsum(n) - n
        starts, lengths = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[missing], lengths[missing] = at, n
        known = slot >= 0
        starts[known], lengths[known] = self.starts[slot[known]], self.lengths[slot[known]]
        flat = np.concatenate([self.ids, ids])
        keep = min(len(new), self.room - len(self.slots))
        if keep > 0:
            self.slots.update(zip(new[:keep], range(len(self.starts), len(self.starts) + keep), strict=True))
            self.starts, self.lengths = np.concatenate([self.starts, at[:keep]]), np.concatenate([self.lengths, n[:keep]])
            self.ids = flat[: len(self.ids) + int(n[:keep].sum())].copy()
        return starts, lengths, flat

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids.  Chunks are joined by spaces, 400 in a string; a token belongs to the chunk in which it starts."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a in range(0, len(chunks), 40_000):
            groups = [chunks[i : i + 400] for i in range(a, min(a + 40_000, len(chunks)), 400)]
            for g, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                at = np.fromiter((o[0] for o in e.offsets), np.int64)
                if (np.diff(at) < 0).any():  # offsets out of order: one by one
                    each = [x.ids for x in self.tokenizer.encode_batch(g, add_special_tokens=False)]
                    lengths.append(np.fromiter(map(len, each), np.int64, len(g)))
                    ids += [np.array(x, np.int32) for x in each]
                    continue
                ends = np.cumsum(np.fromiter((len(c) + 1 for c in g), np.int64, len(g)))
                lengths.append(np.diff(np.searchsorted(at, ends, "left"), prepend=0))
                ids.append(np.array(e.ids, np.int32))
        return np.concatenate(lengths), np.concatenate(ids)


def encoder(spec: str) -> ChunkEncoder:
    """One for each worker and tokenizer."""
    return kept(__name__, zlib.crc32(spec.encode()), lambda: ChunkEncoder(spec))


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df is read from, as Catalyst knows them; of those that it knows nothing of, 0.  Its estimates of what is made of them may be far off."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int | None = 2, group_bytes: int = 16 << 20, page_rows: int = 2_000) -> None:
    """Write (doc_id, part, first, n_tokens, ids) in ascending doc_id order, null first, equal ids by the text's hash.

    first counts the ids before the document in its part.  Null and empty texts
    have just end_id.  Repeated rows are all written.  An empty table writes
    files without rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # equal rows may be many; their number among all rows deals them out, as any order of them is the same
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-_input_bytes(docs) // PART_BYTES), MOST_PARTS))
    rows = rows.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    in_batches(rows, _encoding(spec, end_id), "doc_id long, part int, first long, n_tokens int, ids array<int>").write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "true").option(
        "compression", "zstd"
    ).parquet(path)


def _encoding(spec, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first, part = encoder(spec.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            for a, b, texts in text_parts(batch):
                ids, begins = enc.encode(texts)
                n = b - a
                if end_id is not None:
                    ids = np.insert(ids, begins[1:], end_id).astype(np.int32)
                    begins = begins + np.arange(n + 1)
                lengths = np.diff(begins)
                for c, d in slices(lengths * 4, 32 << 20):
                    values = pa.ListArray.from_arrays(pa.array((begins[c : d + 1] - begins[c]).astype(np.int32)), pa.array(ids[begins[c] : begins[d]]))
                    yield pa.record_batch(
                        [batch.column("doc_id").slice(a + c, d - c), pa.array(np.full(d - c, part, np.int32)), pa.array(first + begins[c:d]), pa.array(lengths[c:d].astype(np.int32)), values],
                        names=["doc_id", "part", "first", "n_tokens", "ids"],
                    )
                first += int(begins[-1])

    return run


def read_tokens(spark, path: str) -> DataFrame:
    """The rows written, with start: the ids of all documents before it.  Offsets of the parts come from n_tokens alone; there is a row for each part."""
    rows = spark.read.schema("doc_id long, part int, first long, n_tokens int, ids array<int>").parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    # as many rows as the files have parts, which is the number of shuffle partitions
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(docs: DataFrame, **how) -> DataFrame:
    """Documents through the files and back: doc_id, start, n_tokens, ids_crc32 as read from them."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, **how)
    return in_batches(read_tokens(docs.sparkSession, path), _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    return digest(table(spark, sf_dir, "documents"))
