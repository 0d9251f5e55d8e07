"""Token-id output by bit-plane shuffling.

Ids are dealt into blocks of a fixed number; a block is transposed into bit planes (plane k holds
bit k of every id), each plane is compressed with zstandard, and a chunk index says where each
block and each document begins. High planes of frequent small ids are nearly all zero, so
they cost almost nothing, and a reader can stop at the planes its vocabulary needs.

A data set is a folder of two tables: `blocks` (shard, block, n_ids, planes array<binary>, and the
documents that begin in the block: doc_ids, doc_starts within the shard, doc_sizes) and `shards`
(shard, n_docs, n_ids, first_id: ids in all shards before it). Shards follow ascending doc_id.
Spark's committer writes them, so a lost executor's block files are written again or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import base
from lumenfold.llm.tokens import CODED_BYTES, crc, encode_texts, word_coder

#: Ids of a block; the last of a shard may have fewer.
BLOCK_IDS = 65_536
BLOCKS = "shard int, block int, n_ids int, planes array<binary>, doc_ids array<bigint>, doc_starts array<bigint>, doc_sizes array<bigint>"


def encode_block(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """Bit planes of one block, as many as its largest id has bits; at least one."""
    ids = np.ascontiguousarray(ids, "<u4")
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    compress = zstandard.ZstdCompressor(level=level).compress
    return [compress(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes()) for k in range(width)]


def decode_block(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(zstandard.decompress(plane), np.uint8), bitorder="little", count=n)
        ids |= bits.astype(np.uint32) << np.uint32(k)
    return ids


class _ShardWriter:
    """Blocks of one shard, from ids that arrive in document order."""

    def __init__(self, shard: int, block_ids: int):
        self.shard, self.block_ids, self.block, self.written = shard, block_ids, 0, 0
        self.ids: list[np.ndarray] = []
        self.held, self.total = 0, 0
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[dict]:
        starts = self.total + np.cumsum(sizes) - sizes
        self.docs.append(np.stack([doc_ids, starts, sizes]))
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block_ids:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[dict]:
        if not self.docs and not self.held:
            return
        ids, docs = np.concatenate(self.ids), np.concatenate([np.zeros((3, 0), np.int64), *self.docs], axis=1)
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, max(end, 1) if last else end, self.block_ids):
            part = ids[at : min(at + self.block_ids, end)]
            stop = self.written + len(part)
            n = docs.shape[1] if last and at + self.block_ids >= end else int(np.searchsorted(docs[1], stop))
            mine, docs = docs[:, :n], docs[:, n:]
            yield {"shard": self.shard, "block": self.block, "n_ids": len(part), "planes": encode_block(part), "doc_ids": mine[0], "doc_starts": mine[1], "doc_sizes": mine[2]}
            self.block, self.written = self.block + 1, stop
        self.ids, self.docs = [ids[end:]], [docs] if docs.shape[1] else []
        self.held = len(ids) - end


_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64()))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, block_ids: int = BLOCK_IDS, shard_bytes: int = 8 << 20) -> None:
    """Encode `docs` (doc_id, text) and write the data set to `path`.

    Documents are range-partitioned and sorted by doc_id, a shard a partition; rows that repeat a
    doc_id stand one after another, by text. Null texts are empty and hold the end id alone; an empty table
    gives a data set without rows."""
    docs = base.documents(docs)
    spark = docs.sparkSession
    ranged = docs.repartitionByRange(base.bucket_count(docs, shard_bytes, 8), "doc_id").sortWithinPartitions("doc_id", "text")

    def encoded(batches):
        from pyspark import TaskContext

        writer, coder = _ShardWriter(TaskContext.get().partitionId(), block_ids), word_coder(tokenizer)
        for batch in batches:
            for part in base.pieces(batch, CODED_BYTES):
                ids, sizes = encode_texts(part.column("text"), coder, end_id)
                if rows := list(writer.add(part.column("doc_id").to_numpy(), ids, sizes)):
                    yield _batch(rows)
        if rows := list(writer.flush(True)):
            yield _batch(rows)

    ranged.mapInArrow(encoded, BLOCKS).write.option("compression", "none").mode("overwrite").parquet(f"{path}/blocks")
    counts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.size("doc_ids")).cast("long").alias("n_docs"), F.sum("n_ids").cast("long").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    counts.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).write.mode("overwrite").parquet(f"{path}/shards")


DOCUMENTS = "shard int, doc_id bigint, start bigint, n_tokens bigint, ids binary"


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a data set: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 and, if asked for, ids (little-endian uint32)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, n_docs bigint, n_ids bigint, first_id bigint").parquet(f"{path}/shards")
    n = max(1, shards.count())
    ordered = blocks.repartition(n, "shard").sortWithinPartitions("shard", "block")
    schema = "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def decoded(batches):
        ids, base_id, docs, shard = np.zeros(0, np.uint32), 0, np.zeros((3, 0), np.int64), -1
        for batch in batches:
            for row in range(batch.num_rows):
                at = {k: batch.column(k)[row] for k in batch.schema.names}
                if at["shard"].as_py() != shard:
                    shard, ids, base_id, docs = at["shard"].as_py(), np.zeros(0, np.uint32), 0, np.zeros((3, 0), np.int64)
                ids = np.concatenate([ids, decode_block(at["planes"].as_py(), at["n_ids"].as_py())])
                more = np.stack([at[k].values.to_numpy() for k in ("doc_ids", "doc_starts", "doc_sizes")])
                docs = np.concatenate([docs, more], axis=1)
                done = int(np.searchsorted(docs[1] + docs[2], base_id + len(ids), "right"))
                if not done:
                    continue
                full, docs = docs[:, :done], docs[:, done:]
                parts = [ids[s - base_id : s - base_id + n] for s, n in zip(full[1].tolist(), full[2].tolist(), strict=True)]
                columns = [pa.array([shard] * done, pa.int32()), pa.array(full[0]), pa.array(full[1]), pa.array(full[2]), pa.array([crc(x) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                used = int(full[1, -1] + full[2, -1]) - base_id
                ids, base_id = ids[used:], base_id + used

    found = ordered.mapInArrow(decoded, schema)
    # a row a shard: its size is bounded by the number of partitions that wrote
    return found.join(shards.select("shard", "first_id"), "shard").withColumn("start", F.col("start") + F.col("first_id")).drop("shard", "first_id")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` through the file format and back: doc_id, start, n_tokens, ids_crc32."""
    path = base.shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
