"""Packed exchange: what a task found in its block of texts meets, by hash, what other tasks found.

A task sorts its 64-bit hashes and cuts them into equal ranges of the hash space, one blob a
range. A reducer gets the blobs of one range, so it holds every occurrence of its hashes. Its
verdicts go back the same way, one blob a share of the documents, where a document's are put
together: rows are counted by shares and documents, not by how many ranges a document's hashes
fall into. Blobs are byte planes under zstandard: sorted hashes as differences, places as 32-bit
numbers, and a table of the block's documents.

Before anything is sent, a task settles what it can alone, so a hash that a third of all rows
share is sent once a task, not once a row; and what is sent is spread evenly, as hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from lumenfold.llm.base import bucket_bounds, group_starts, mix, pack, ragged, trim, unpack

#: bucket: range of the hash space. share null: blob is a message to it; else a verdict on that share's documents.
MESSAGES = "bucket int, share int, blob binary"
VERDICTS = "share int, blob binary"
#: A document's own: its marks, each of as many 32-bit numbers as were given.
MARKS = "doc_id bigint, blob binary"


def message(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([None], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "share", "blob"])


def divided(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A bucket's verdicts that pass through, and its messages."""
    share = table.column("share")
    return table.filter(share.is_valid()).select(["share", "blob"]), table.filter(share.is_null()).column("blob").to_pylist()


def message_rows(hashes: np.ndarray, places: np.ndarray, doc_ids: np.ndarray, firsts: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of MESSAGES. hashes: sorted; places: each one's index in the block's stream; document k's stream begins at firsts[k]."""
    bounds = bucket_bounds(hashes, n_buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        h, at = hashes[bounds[b] : bounds[b + 1]], places[bounds[b] : bounds[b + 1]]
        used = np.zeros(len(doc_ids), bool)
        used[np.searchsorted(firsts, at, "right") - 1] = True
        blob = pack(np.diff(h, prepend=np.uint64(0)), at.astype(np.uint32), np.diff(doc_ids[used], prepend=np.int64(0)), np.diff(firsts[used], prepend=np.int64(0)))
        yield message(b, blob)


#: A bucket's messages are judged in so many ranges of their hashes, one after another.
_RANGES = 8


def read_messages(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All messages of a bucket, range of hashes by range: hashes (sorted), each one's document id and
    place within its document. Blobs stay packed as two columns; only a range at a time is spelt out."""
    parts = []
    for blob in blobs:
        h, at, doc_ids, firsts = unpack(blob)
        parts.append((np.cumsum(h, dtype=np.uint64), at, np.cumsum(doc_ids), np.cumsum(firsts)))
    low, high = min(int(h[0]) for h, *_ in parts), max(int(h[-1]) for h, *_ in parts)
    edges = np.array([low + (high - low) * i // _RANGES for i in range(1, _RANGES)], np.uint64)
    bounds = [np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]) for h, *_ in parts]
    for i in range(_RANGES):
        held = []
        for (h, at, doc_ids, firsts), bound in zip(parts, bounds, strict=True):
            here = at[bound[i] : bound[i + 1]].astype(np.int64)
            k = np.searchsorted(firsts, here, "right") - 1
            held.append((h[bound[i] : bound[i + 1]], doc_ids[k], here - firsts[k]))
        h, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        if len(h):
            yield h[order], doc[order], at[order]


def verdict_batch(doc: np.ndarray, values: np.ndarray, n_shares: int, bucket: int | None = None) -> pa.RecordBatch:
    """A row a share with marks on its documents, as VERDICTS, or as MESSAGES that pass through a
    bucket. values: a row of numbers below 2**32 a mark."""
    values = values if values.ndim == 2 else values[:, None]
    share = (mix(doc.astype(np.uint64)) >> np.uint64(32)) % np.uint64(n_shares)
    order = np.lexsort((doc, share))
    doc, values, share = doc[order], values[order].astype(np.uint32), share[order]
    starts, blobs = group_starts(share), []
    for a, b in pairwise([*starts.tolist(), len(doc)]):
        first = group_starts(doc[a:b])
        blobs.append(pack(np.diff(doc[a:b][first], prepend=np.int64(0)), np.diff(np.append(first, b - a)), *np.ascontiguousarray(values[a:b].T)))
    columns = {"share": pa.array(share[starts].astype(np.int32)), "blob": pa.array(blobs, pa.binary())}
    if bucket is not None:
        columns = {"bucket": pa.array(np.full(len(starts), bucket, np.int32)), **columns}
    return pa.RecordBatch.from_pydict(columns)


def put_together(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, pa.Array]:
    """Documents of unpacked verdicts, sorted, and the marks of each."""
    doc = np.concatenate([np.repeat(np.cumsum(x[0]), x[1]) for x in parts])
    values = np.stack([np.concatenate(v) for v in zip(*(x[2:] for x in parts), strict=True)], axis=1)
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    starts = group_starts(doc)
    return doc[starts], ragged(values[order].reshape(-1), np.diff(np.append(starts, len(doc))) * values.shape[1])


def by_document(verdicts: DataFrame) -> DataFrame:
    """MARKS: a row for each document that verdicts name, with all its marks."""

    def run(table: pa.Table) -> pa.Table:
        doc, marks = put_together([unpack(x) for x in table.column("blob").to_pylist()])
        trim()
        return pa.table([pa.array(doc, pa.int64()), marks], names=["doc_id", "blob"])

    return verdicts.groupBy("share").applyInArrow(run, MARKS)


def reducer(judge, n_shares: int):
    """For groupBy("bucket").applyInArrow: judge(hashes, doc ids, places) -> (doc ids, places) of the
    occurrences it marks, called for each range of a bucket's hashes; verdicts that tasks reached alone
    pass through. Memory is given back before a group ends, as the worker lives on beside others."""

    def found(blobs: list[bytes]) -> pa.RecordBatch:
        marks = [judge(*x) for x in read_messages(blobs)]
        return verdict_batch(*(np.concatenate(x) for x in zip(*marks, strict=True)), n_shares)

    def run(table: pa.Table) -> pa.Table:
        own, blobs = divided(table)
        out = pa.concat_tables([own, pa.Table.from_batches([found(blobs)]).cast(own.schema)]) if blobs else own
        del blobs
        trim()
        return out

    return run


def marked(blob: bytes | None) -> np.ndarray:
    """Sorted distinct places of a document's marks, of one number each."""
    return np.unique(np.frombuffer(blob or b"", np.uint32)).astype(np.int64)
