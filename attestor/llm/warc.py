"""WARC archives: writing with revisits, and reading with boundary-chain verification.

Records are written by Spark's text writer, whose line separator is the last
byte of a record; so archives land on any file system, committed by task.

They are read by Spark's text reader, which takes magic at the beginning of a
line as its line separator and deals plain files out in splits (a gzip file
is one split, read as a stream).  A task sees one segment at a time, not a file.
Each segment is a candidate: its offset, and that of its successor by its
Content-Length.  Pointer jumping follows the chain from the start of the file,
first within splits, where it gives the place at which a chain leaves, then over
these places from split to split.  What the chain doesn't reach, as magic inside
of payloads, is dropped; a payload that spans segments is put together again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, scratch, stored, table

#: About the size of a written archive, before it is compressed.
TARGET = 16 << 20
#: Rows of a payload beyond which its revisits are decided without being shuffled; the digests of such payloads are broadcast, one for each HOT rows at most.
HOT = 10_000
#: Beginning of a record, and what separates it from what is before.  No part of the separator is its beginning (the reader misses
#: some of a kind that overlaps itself where splits meet), and no line of a header begins with magic.
MAGIC = b"WARC/1."
SEPARATOR = "\nWARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, target: int = TARGET, compression: str = "gzip") -> None:
    """A record per row.  Of equal payloads of least_bytes or more, that of the least id is a response, the others revisit it.

    Null payloads are empty; a null id is written as such, and is a response
    only where no equal payload has an id; of rows with the same id and payload
    each is a response if one is.  Null URLs are left out, control characters
    in them dropped.  Digests alone are aggregated; payloads are shuffled once,
    those of very frequent ones not at all but for their response's.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x1F\x7F]", "").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    size = rows.agg(F.sum(F.octet_length("payload")), F.count("*")).first()
    per_file = max(1, int(target * (size[1] or 1) / ((size[0] or 0) + 600 * (size[1] or 1))))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    hot = first.filter(F.col("copies") > HOT).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    known = (F.col("n") >= least_bytes) & F.col("hot_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("hot_first"))
    # a decided row goes by its own number, so that it meets nothing and its digest is no hot key
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("payload", F.when(known, "").otherwise(F.col("payload"))).withColumn("key", key)
    rows = rows.join(first.select(F.col("digest").alias("of"), "first"), F.col("key") == F.col("of"), "left").withColumn("first", F.coalesce("hot_first", "first"))
    revisit = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n\r"))
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def follow(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted offsets the index of the one at its successor, -1 if there is none; and where the chain from it leaves them, by pointer jumping."""
    n = len(at)
    where = np.searchsorted(at, after)
    hit = (where < n) & (at[np.minimum(where, max(0, n - 1))] == after) & (after > at)
    jump = np.where(hit, where, np.arange(n))
    step = np.where(hit, where, -1)
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return step, after[jump]


def reached(step: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Marks of what the chains from the entries reach, by pointer jumping; each round doubles the stride."""
    n = len(step)
    on, jump = np.append(entry, False), np.append(np.where(step < 0, n, step), n)
    before = -1
    while on.sum() != before:
        before = on.sum()
        on[jump[np.nonzero(on[:n])[0]]] = True
        on[n] = False
        jump = jump[jump]
    return on[:n]


def segments(spark, path: str) -> DataFrame:
    """(file, split, value): what stands between record boundaries or what looks like them, in order within a split."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _number(urn: bytes) -> int | None:
    digits = urn.strip(b"<>").rpartition(b":")[2]
    return int(digits) if digits.lstrip(b"-").isdigit() else None


def _header(value: bytes, first: bool) -> tuple[dict, int]:
    """Fields of a segment, and where its block begins (-1 if it is no header).  Only a file's first segment has all of the magic.

    Where a block begins with magic, the end of the header's empty line is part of what separates the segment from the next.
    """
    begin = len(MAGIC) if first else 0
    if first and not value.startswith(MAGIC) or value[begin : begin + 3] not in (b"0\r\n", b"1\r\n"):
        return {}, -1
    end = (value + b"\n").find(b"\r\n\r\n", begin)
    if end < 0:
        return {}, -1
    fields = dict(x.split(b":", 1) for x in value[begin + 3 : end].split(b"\r\n") if b":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields.items()}, end + 4


def _payload(block: bytes, http: bool) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if http else block


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


CANDIDATE = "file string, split long, at long, size long, after long, begin long, length long, http boolean, spans boolean"
FIELDS = [("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("after", pa.int64()), ("begin", pa.int64()), ("length", pa.int64()), ("http", pa.bool_()), ("spans", pa.bool_())]
FIELDS += [("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]


def _placed(batches: Iterator[pa.RecordBatch]):
    """(file, split, offset of the value in what the split's segments make up, value, whether it is a file's first) of each segment."""
    now, at = None, 0
    for batch in batches:
        for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value"), strict=True):
            if (file, split) != now:
                now, at, fresh = (file, split), 0, True
            value = value.as_buffer().to_pybytes()
            yield file, split, at, value, fresh and split == 0
            at, fresh = at + len(value) + len(SEPARATOR), False


def _candidates(with_payload: bool):
    """A row for each segment: offsets are those in its split, and all of them count from the magic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = pa.schema(FIELDS), [], 0
        for file, split, place, value, first in _placed(batches):
            fields, begin = _header(value, first)
            at = place if first else place - len(MAGIC)
            row = dict.fromkeys(schema.names) | {"file": file, "split": split, "at": at, "size": len(value) + len(SEPARATOR), "http": False, "spans": False}
            told = fields.get(b"content-length", b"")
            if begin >= 0 and told.isdigit():
                length, revisit, http = int(told), fields.get(b"warc-type") == b"revisit", fields.get(b"content-type", b"").startswith(b"application/http")
                whole = len(value) - begin >= length
                row |= {"after": place + begin + length + 4, "begin": place + begin, "length": length, "http": http, "spans": not whole}
                row |= {"id": _number(fields.get(b"warc-record-id", b"")), "record_type": fields.get(b"warc-type", b"").decode("ascii", "replace"), "refers_to": _number(fields.get(b"warc-refers-to", b"")) if revisit else None}
                row["uri"] = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
                if revisit:
                    stated = fields.get(b"x-payload-length", b"0")
                    row |= {"payload_bytes": int(stated) if stated.isdigit() else 0, "payload_digest": fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("ascii", "replace")}
                elif whole:
                    payload = _payload(value[begin : begin + length], http)
                    row |= {"payload_bytes": len(payload), "payload_digest": _digest(payload), "payload": payload if with_payload else None}
                    held += len(payload) if with_payload else 0
            out.append(row)
            if len(out) >= 2000 or held > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, split, place, value, _ in _placed(batches):
        yield pa.record_batch([pa.array([file]), pa.array([split], pa.int64()), pa.array([place], pa.int64()), pa.array([value], pa.binary())], names=["file", "split", "place", "value"])


def _leave(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    _, out = follow(rows["at"].to_numpy(), rows["after"].to_numpy())
    return pd.DataFrame({"file": rows["file"].to_numpy(), "at": rows["at"].to_numpy(), "leaves": out})


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a split that its entries reach, and for each the last one reached up to it (-1 before any)."""
    rows = rows.sort_values("at")
    at = rows["at"].to_numpy()
    on = reached(follow(at, rows["after"].to_numpy())[0], rows["entry"].to_numpy(bool))
    return pd.DataFrame({"file": rows["file"].to_numpy(), "split": rows["split"].to_numpy(), "at": at, "on": on, "owner": np.maximum.accumulate(np.where(on, at, -1))})


def _entries(found: DataFrame) -> DataFrame:
    """(file, at) where the chain of each file enters a split: from offset 0 on, by pointer jumping over the places at which chains leave splits."""
    leaves = stored(found.groupBy("file", "split").applyInPandas(_leave, "file string, at long, leaves long"), "leaves")
    nodes = leaves.select("file", F.col("leaves").alias("at")).distinct().unionByName(leaves.filter("at = 0").select("file", "at")).distinct()
    jump = stored(leaves.join(nodes, ["file", "at"]).filter("leaves > at"), "jump")
    on = stored(leaves.filter("at = 0").select("file", "at"), "entries")
    before = -1
    while (n := on.count()) != before:
        before = n
        ahead = on.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        on = stored(on.unionByName(ahead).distinct(), "entries")
        then = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
        jump = stored(jump.join(then, ["file", "leaves"], "left").select("file", "at", F.coalesce("then", "leaves").alias("leaves")), "jump")
    return on


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives at path, plain or gzip.

    A file whose chain breaks gives those before the break; an empty one none.
    A record that the file ends within is not given.  A task holds one segment
    of an archive, and the offsets of a split's; a record that holds what looks
    like a boundary is put together in one task.
    """
    raw = in_batches(segments(spark, path), _candidates(with_payload), f"{CANDIDATE}, {RECORD}")
    scan = stored(raw, "candidates")
    splits = scan.groupBy("file", "split").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    splits = stored(splits.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "splits")
    found = scan.join(F.broadcast(splits) if splits.count() <= 1_000_000 else splits, ["file", "split"])
    found = found.withColumns({c: F.col(c) + F.col("base") for c in ("at", "after", "begin")})
    links = found.select("file", "split", "at", F.coalesce("after", F.lit(-1)).alias("after"))
    many = not splits.filter("split > 0").isEmpty()
    marked = links.join(_entries(links).withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False))) if many else links.withColumn("entry", F.col("at") == 0)
    marks = stored(marked.groupBy("file", "split").applyInPandas(_mark, "file string, split long, at long, on boolean, owner long"), "marks")
    names = [f.split()[0] for f in RECORD.split(", ")]
    records = found.filter("length is not null").join(marks.filter("on").select("file", "split", "at"), ["file", "split", "at"])
    out = records.filter("not spans").select(*names)
    long = stored(records.filter("spans").select("file", "at", "begin", "length", "http", *names[:-3]), "spanning")
    if long.isEmpty():
        return out
    # the last record reached up to each segment, in its split or else in one before
    last = marks.groupBy("file", "split").agg(F.max("owner").alias("m"))
    carried = last.select("file", "split", F.coalesce(F.max("m").over(before), F.lit(-1)).alias("carried"))
    owned = marks.join(carried, ["file", "split"]).join(splits, ["file", "split"])
    owned = owned.select("file", "split", (F.col("at") - F.col("base")).alias("rel"), F.greatest("owner", "carried").alias("owner"), "base")
    pieces = in_batches(segments(spark, path), _values, "file string, split long, place long, value binary")
    # at is the magic's offset: it is the value's own for a file's first segment only
    pieces = pieces.withColumn("rel", F.when((F.col("split") == 0) & (F.col("place") == 0), 0).otherwise(F.col("place") - len(MAGIC)))
    pieces = pieces.join(owned, ["file", "split", "rel"]).select("file", F.col("owner").alias("at"), (F.col("place") + F.col("base")).alias("place"), "value")
    whole = long.join(pieces, ["file", "at"]).groupBy("file", "at", "begin", "length", "http", *names[:-3]).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("pieces"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(FIELDS[9:])
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["pieces"]
                data, begin = SEPARATOR.encode().join(p["value"] for p in parts), row["begin"] - parts[0]["place"]
                if len(data) < begin + row["length"]:
                    continue
                payload = _payload(data[begin : begin + row["length"]], row["http"])
                done = {n: row[n] for n in names[:-3]} | {"payload_bytes": len(payload), "payload_digest": _digest(payload), "payload": payload if with_payload else None}
                yield pa.RecordBatch.from_pylist([done], schema)

    return out.unionByName(in_batches(whole, put_together, RECORD))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all pages through archives and back."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
