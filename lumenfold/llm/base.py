"""Shared plumbing of the training-data operators.

Everything here works on whole Arrow batches: texts become one byte buffer
with offsets, words become spans of it, and what is shuffled between tasks
travels as a few packed blobs a task instead of one row an item.

Conventions all operators follow unless their docstring says otherwise:
rows with a null id are left out (nothing could address their result); a null
text counts as an empty one; rows that repeat an id are one document each for
their own output and the same document when occurrences are compared; columns
other than the named ones are ignored and may have any name.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow's own pools keep what they once held; a worker that meets one long batch should not.
pa.set_memory_pool(pa.system_memory_pool())

#: Rows of an Arrow batch: texts are long, and both sides of the pipe hold a batch.
BATCH_ROWS = 1_000

#: Bytes that end a word: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Text bytes gathered before packed blobs are cut; bounds a worker's memory (about 14 bytes a text byte while it is sorted).
BLOCK_BYTES = 10 << 20
#: Text bytes hashed in one go; powers of the hash base are kept for so many.
CHUNK_BYTES = 1 << 20

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = (int(n) + 0x10000) // 0x10000 * 0x10000
        _powers[:] = [np.concatenate([[U(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, _BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end] for each span, from prefix sums."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and each text's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text its first word's index (n + 1 values)."""
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes and length."""
    return mix(rolling(_BYTE_VALUE[data], starts, ends) + (ends - starts).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def trim() -> None:
    """Give freed memory back, and the tables of powers, soon made again: a worker lives on after its task, beside others."""
    _powers.clear()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: What tasks of a kind keep between each other in a worker, for `release` to empty.
CACHES: list[dict] = []


def release() -> None:
    """Forget what earlier tasks of other operators left in this worker."""
    for cache in CACHES:
        cache.clear()
    trim()


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of whole texts of about `limit` bytes: first text, end text, bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def pieces(batch: pa.RecordBatch | pa.Table, limit: int = BLOCK_BYTES):
    """Slices of a batch with about `limit` bytes of text each (column `text`)."""
    _, offsets = flat(batch.column("text"))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def blocks(batches, limit: int = BLOCK_BYTES):
    """Tables of about `limit` bytes of text gathered from a partition's batches, in their order."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, limit):
            _, offsets = flat(part.column("text"))
            if held and size + offsets[-1] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
            held.append(part)
            size += int(offsets[-1])
    if held:
        yield pa.Table.from_batches(held)
        held.clear()
        trim()


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: the bytes of values, dealt into runs of so many items."""
    values = np.ascontiguousarray(values)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * values.itemsize, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count numbers for each pair, one after another."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = counts > 0
    starts, counts = np.asarray(starts, np.int64)[full], counts[full]
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[at] = starts - np.concatenate([[0], starts[:-1] + counts[:-1] - 1])
    return np.cumsum(out)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under zstandard; sorted ones are best given as differences."""
    parts, head = [], [len(arrays)]
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(a)]
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b"")
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 * (3 * n + 1), []
    for kind, width, length in head.tolist():
        planes = np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{width}") if length else np.zeros(0, f"{chr(kind)}{width}"))
        at += width * length
    return out


def bucket_bounds(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit hash space begins and the last ends."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of the plan: file sizes for tables, no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Sizes beyond it mean that the optimizer does not know.
_UNKNOWN = 1 << 53


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; a scan of one column. What files take says little, as it depends on their compression."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def fresh(name: str, *taken: str) -> str:
    """A column name that is none of those taken."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


def bucket_count(df: DataFrame, each: int = 2 << 20, least: int = 32) -> int:
    """Buckets for packed shuffles, in proportion to the input, without an upper bound; by partitions where its size is unknown."""
    size = input_bytes(df)
    return max(least, -(-size // each) if size < _UNKNOWN else 4 * df.rdd.getNumPartitions())


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless their path has it already."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    known = {Path(p).resolve() for p in filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))}
    if context.master.startswith("local["):  # workers start in the driver's folder
        known.add(Path.cwd())
    if root in known or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    packed = Path(tempfile.mkdtemp(prefix="lumenfold-")) / "lumenfold.zip"  # on the driver, which serves it
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted((root / "lumenfold").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(packed))


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, unless they are lower already."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns operators need, named doc_id and text, without rows that have no id."""
    bounded(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def one_per_id(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a row an id: the different texts of repeated ids, in order, one after another.

    Only ids are counted; texts move only where some id is repeated."""
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return docs
    joint = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(joint)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir. Where that is unset: below a temporary one
    if driver and executors are one process, else below the warehouse, which all share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        top = "file://" + tempfile.mkdtemp(prefix="lumenfold-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/lumenfold/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
