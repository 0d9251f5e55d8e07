"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the vocabulary's pattern is one piece. A piece starts as single bytes; the tree
over byte positions holds, for each live pair of neighbours, the rank of their concatenation, and
every inner node the smallest rank below it with the leftmost position. The root therefore names
the next merge, and a merge changes three leaves: its own, its left neighbour's and the one that
disappears, each in logarithmic time. A piece of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import base
from lumenfold.llm.base import chunks, flat
from lumenfold.llm.tokens import Coder, joined

#: Pieces whose ids a worker remembers.
CACHED_PIECES = 600_000
_NONE = 1 << 60
#: Bits of a tree value that hold the position; ranks stand above them, so that min() is leftmost.
_SHIFT = 28


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece; a piece that is a token itself is that token, as the tiktoken library has it."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # of the symbol that starts here
    before = list(range(-1, n - 1))  # start of the symbol before it
    get = ranks.get
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank << _SHIFT | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        middle = end[i]
        if middle >= n:
            return _NONE
        rank = get(piece[i : end[middle]])
        return _NONE if rank is None else rank << _SHIFT | i

    while (least := tree[1]) != _NONE:
        i = least & ((1 << _SHIFT) - 1)
        gone = end[i]
        end[i] = end[gone]
        if end[i] < n:
            before[end[i]] = i
        put(gone, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder of whole texts; distinct pieces are encoded once and remembered up to a bound."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.coder = Coder(self._encode, CACHED_PIECES)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([encode_piece(x.encode(), self.ranks) for x in pieces])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        found = [self.pattern.findall(x) for x in texts]
        first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        pieces = pa.array([p for x in found for p in x], pa.large_string()).dictionary_encode()
        ids, each = self.coder.gather(self.coder.codes(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], np.cumsum(each)])[first])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        ids = ids.astype(np.int64)
        return self.bytes[base.spread(self.starts[ids], self.sizes[ids])]


_held: dict = {}


def encoder(path: str | None = None) -> ByteBpe:
    if path not in _held:
        _held[path] = ByteBpe(path)
    return _held[path]


RESULT = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


def encode(docs: DataFrame, ranks: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (little-endian uint32) with the bytes decoded from them, or, with
    `digests`, the SHA-256 of either. A map over rows: nothing is shuffled, null texts are empty."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else RESULT

    def run(batches):
        bpe = encoder(ranks)
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            ids_of = batch.column("doc_id")
            for i, j, _, _ in chunks(np.zeros(0, np.uint8), offsets):
                ids, counts = bpe.encode_batch([x or "" for x in batch.column("text").slice(i, j - i).to_pylist()])
                raw, decoded = ids.astype("<u4"), bpe.decode(ids)
                at = np.concatenate([[0], np.cumsum(counts)])
                byte_at = np.concatenate([[0], np.cumsum(bpe.sizes[ids.astype(np.int64)])])[at]
                out = [[], []]
                for k in range(j - i):
                    for to, x in zip(out, (raw[at[k] : at[k + 1]], decoded[byte_at[k] : byte_at[k + 1]]), strict=True):
                        to.append(hashlib.sha256(x).hexdigest() if digests else x.tobytes())
                kind = pa.string() if digests else pa.binary()
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([ids_of.slice(i, j - i), pa.array(counts, pa.int64()), *(pa.array(x, kind) for x in out)], names=names)

    return base.documents(docs).mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
