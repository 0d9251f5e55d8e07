"""Substring dedup with Rabin-Karp hashes of every fixed-length word window.

A task hashes each window of its texts from prefix sums of a polynomial over word hashes. Spark
brings equal hashes together (see exchange.py), the smallest document id among them keeps its
window, and every other document's windows are marked. Marked windows of a document merge into
maximal intervals of words, which are cut out. Hashes have 64 bits: among n windows some two
different ones are taken for equal with a chance of n * n / 2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import base, exchange
from lumenfold.llm.base import blocks, chunks, flat, group_starts, mix, rolling, spread, word_hashes, word_spans
from lumenfold.llm.numbering import keyed

#: Words of a window.
WINDOW = 13
#: Text bytes whose windows a bucket holds, and whose marks a share of documents, on average.
BUCKET_BYTES, SHARE_BYTES = 8 << 20, 16 << 20


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of every text, texts one after another, and how many windows each has."""
    out, counts = [], []
    for _, _, part, at in chunks(data, offsets):
        starts, ends, first = word_spans(part, at)
        n = np.maximum(np.diff(first) - window + 1, 0)
        where = spread(first[:-1], n)
        out.append(mix(rolling(word_hashes(part, starts, ends), where, where + window)))
        counts.append(n)
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def find(docs: DataFrame, window: int = WINDOW, bits: int = 0) -> DataFrame:
    """doc_id and blob: the windows (first word's index) whose words also start in a document with a smaller id.

    docs: a row an id. Ids that differ in their low `bits` alone are no one's copies, but marked each on its own."""
    size = base.text_bytes(docs)
    n_buckets, n_shares = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // SHARE_BYTES))

    def one(table):
        doc_ids = table.column("doc_id").to_numpy()
        hashes, counts = window_hashes(*flat(table.column("text")), window)
        if not len(hashes):
            return
        firsts = np.cumsum(counts) - counts
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        doc_of = np.repeat(doc_ids, counts)[order]
        starts = group_starts(hashes)
        rank = doc_of >> bits
        later = rank > np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(order))))
        if later.any():
            k = order[later]
            yield exchange.verdict_batch(doc_of[later], k - np.repeat(firsts, counts)[k], n_shares, int(doc_ids[0]) % n_buckets)
        has = counts > 0
        hashes, order = hashes[~later], order[~later]
        del doc_of, rank, later
        yield from exchange.message_rows(hashes, order, doc_ids[has], firsts[has], n_buckets)

    def settle(batches):
        base.release()
        for table in blocks(batches):
            yield from one(table)

    def judge(hashes, doc, at):
        starts = group_starts(hashes)
        rank = doc >> bits
        later = rank > np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(doc))))
        return doc[later], at[later]

    verdicts = docs.mapInArrow(settle, exchange.MESSAGES).groupBy("bucket").applyInArrow(exchange.reducer(judge, n_shares), exchange.VERDICTS)
    return exchange.by_document(verdicts)


def kept_mask(n_words: int, windows: np.ndarray, window: int) -> np.ndarray:
    """Which words no marked window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    windows = windows[windows + window <= n_words]
    edge[windows] += 1
    edge[windows + window] -= 1
    return np.cumsum(edge[:-1]) == 0


def deduplicated(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word and end of each interval cut out) and kept_text
    (kept words joined by one space), or with `digests` its SHA-256 instead of spans and text.

    A text that no window repeats keeps all its words. Null and empty texts have no words; texts
    shorter than the window lose none. Rows that repeat a doc_id never count as each other's copies, and each
    loses what its own text repeats."""
    own = keyed(base.documents(docs), "key")
    found = find(own.texts, window, own.bits)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digests else "spans array<array<bigint>>, kept_text string")

    def cut(batches):
        for batch in batches:
            texts, blobs, ids = batch.column("text").to_pylist(), batch.column("blob").to_pylist(), batch.column("doc_id")
            rows = []
            for text, mine in zip(texts, blobs, strict=True):
                words = (text or "").encode().split()
                keep = kept_mask(len(words), exchange.marked(mine), window) if mine else np.ones(len(words), bool)
                kept = b" ".join([words[k] for k in np.flatnonzero(keep)] if mine else words)
                if digests:
                    rows.append((len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest()))
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                    rows.append((len(words), len(words) - int(keep.sum()), edges.reshape(-1, 2).tolist(), kept.decode()))
            names = ["n_words", "n_removed", "kept_sha256"] if digests else ["n_words", "n_removed", "spans", "kept_text"]
            kinds = [pa.int64(), pa.int64(), pa.string()] if digests else [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *names])

    return own.rows.join(found.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "blob").mapInArrow(cut, schema)


def rewritten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with all their columns, repeated windows cut from `text`; what stands between kept words stays.

    Where an interval is cut, one space is left. A text that loses all its words becomes empty, one
    that loses none stays as it is, null included. Rows without a doc_id stay as they are; rows that repeat one
    lose each what its own text repeats of smaller ids."""
    key, marks = base.fresh("__id", *docs.columns), base.fresh("__marks", *docs.columns)
    base.bounded(docs.sparkSession)
    own = keyed(docs, key)
    found = find(own.texts, window, own.bits).toDF(key, marks)
    joined = own.rows.join(found, key, "left").select(*docs.columns, marks)
    at = docs.columns.index("text")

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, mine in enumerate(batch.column(marks).to_pylist()):
                if not mine or texts[i] is None:
                    continue
                raw = texts[i].encode()
                starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                keep = kept_mask(len(starts), exchange.marked(mine), window)
                if keep.all():
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))).reshape(-1, 2)
                texts[i] = b" ".join(raw[starts[a] : ends[b - 1]] for a, b in edges.tolist()).decode()
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(batch.num_columns - 1)]))

    return joined.mapInArrow(cut, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of `documents`: doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), WINDOW, digests=True)
