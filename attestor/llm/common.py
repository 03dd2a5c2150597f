"""Shared folder, internal column names and vectorised word handling."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words of the size and SimHash contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: What separates words of the decontamination contract, after A-Z are lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.  Where it is unset, a local session gets a temporary one; a cluster has no folder that all see, so it must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is not None and not isinstance(found, str):
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="attestor-"))
        found = _local[0]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the session's Python ends."""
    path = f"{shared_dir(spark)}/attestor/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before; the folder is scratch space
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and no lost executor takes it along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that goes to Python; several copies of one are alive at a time, in each worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": (2000, "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (8 << 20, "8m")}


#: What a worker keeps from task to task, by the module it is for and a key.
_kept: dict[tuple, object] = {}


def kept(module: str, key, make):
    """make(), once for each worker and key, until a batch function of another module runs in that worker."""
    if (module, key) not in _kept:
        _kept[module, key] = make()
    return _kept[module, key]


def let_go(module: str) -> None:
    """Drop what is kept for other modules: Spark hands a worker from one query to the next, which would hold the former's tables on top of its own."""
    others = [k for k in _kept if k[0] != module]
    for k in others:
        del _kept[k]
    if others:
        give_back()


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size; what a task's batches held goes back to the system at its end, what other operators kept in the worker at its beginning.

    Spark reads the size of batches from the session when the plan runs, so the
    session keeps these settings; lesser ones that it has stay.
    """
    conf = df.sparkSession.conf
    for key, (most, given) in BATCH.items():
        now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key, None) or "0")
        if not 0 < now <= most:
            conf.set(key, given)

    module = run.__module__

    def bounded(batches):
        let_go(module)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table.  They go through Arrow: plain lists would start Python workers of another kind in each executor, just to hand them on."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), struct)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is.  lower() is the fast way where the text is ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(values: Column, size: Column, join) -> Column:
    """Inclusive running join (sum, greatest and so on, null as the absence of a value) of an array, in log2(size) passes of which each doubles the stretch.

    An accumulator that grows an array element by element would copy it each time.
    """
    strides = F.transform(F.sequence(F.lit(0), F.length(F.bin(size))), power)
    return F.aggregate(strides, values, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, join(F.get(acc, i - k), x)).otherwise(x)))


def power(k: Column) -> Column:
    """2 ** k, an int."""
    return F.call_function("shiftleft", F.lit(1), k)


def space_words(text: Column) -> Column:
    """The number of SPACE_WORD runs; null counts as empty.  Other white space is made spaces first, as a split by one plain character needs no regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(out, " ", -1), "")).cast("long")


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes each, every row in one; a longer row stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls, with 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def text_parts(batch: pa.RecordBatch, name: str = "text", most: int = 8 << 20):
    """(first row, end row, string array) of parts of about `most` bytes."""
    texts = column(batch, name)
    for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), most):
        yield a, b, texts.slice(a, b - a)


def chunk_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, code of each ASCII-space-delimited chunk, and the distinct chunks; leading and trailing empty chunks are among them."""
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    return (offsets - offsets[0]).astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[starts[c]:starts[c]+lengths[c]] over codes c.  Returns them and where each code's part begins (one more at the end)."""
    n = lengths[codes]
    begins = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=begins[1:])
    index = np.arange(begins[-1], dtype=np.int64)
    index += np.repeat(starts[codes] - begins[:-1], n)
    return values[index], begins
