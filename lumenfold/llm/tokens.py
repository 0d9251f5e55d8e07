"""Distinct words or pieces are encoded once by a library and gathered for every place they stand at."""

from __future__ import annotations

import gc
import os
import re
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from lumenfold.llm.base import CACHES, chunks, flat, release, spread, trim

#: Words whose ids a worker remembers; beyond it the later half is forgotten.
CACHED_WORDS = 250_000
#: Text bytes whose words are told apart in one go.
CODED_BYTES = 3 << 20


#: The coder in use; others give up their memory to it, as a worker serves one stage after another.
_active: dict = {}
_held: dict = {}
CACHES += [_active, _held]


class Coder:
    """Ids of words through `encode`: list of words -> list of id sequences, remembered up to a bound."""

    def __init__(self, encode, bound: int = CACHED_WORDS):
        self.encode, self.bound = encode, bound
        self.forget()

    def forget(self) -> None:
        self.code: dict = {}
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def shrink(self) -> None:
        """Keep the half learned first: frequent words are met early."""
        keep = self.bound // 2
        self.code = {w: c for w, c in self.code.items() if c < keep}
        self.n_ids = int(self.start[keep])
        trim()

    def learn(self, words: list) -> None:
        ids, sizes = self.encode(words)
        at, total = len(self.code), len(ids)
        while at + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + total] = ids
        self.size[at : at + len(words)] = sizes
        self.start[at : at + len(words)] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += total
        self.code.update(zip(words, range(at, at + len(words)), strict=True))

    def codes(self, words: list) -> np.ndarray:
        """Codes of distinct words."""
        if (other := _active.get("coder")) is not self:
            if other is not None:
                other.forget()
                trim()
            _active["coder"] = self
        if len(self.code) > self.bound:
            self.shrink()
        found = list(map(self.code.get, words))
        if None in found:
            self.learn([w for w, c in zip(words, found, strict=True) if c is None])
            found = list(map(self.code.__getitem__, words))
        return np.array(found, np.int64)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each word has."""
        sizes = self.size[codes]
        return self.ids[spread(self.start[codes], sizes)], sizes


def word_tokenizer(path: str | None = None):
    """The tokenizers library on one thread, read once a worker."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _held[path] = Tokenizer.from_file(path)
    return _held[path]


def joined(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Id lists as one array and their lengths."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


#: Letters of one case, or marks other than the apostrophe: the vocabulary's pattern keeps each such run whole.
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+")
#: Plain parts that are encoded as one text.
_TOGETHER = 512

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def parted(column: pa.Array) -> pa.Array:
    """The texts with ASCII letters lower-cased and a space between a letter and a mark after it.

    The vocabulary's normaliser lower-cases anyway and its pattern cuts there anyway, so ids stay
    the same; but far fewer distinct words are left. Texts that may hold a special token stay."""
    data, offsets = flat(column)
    if data.tobytes().find(b"<|") >= 0:
        return column
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & ((data[1:] & 0xDF) != 0x97)
    cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
    out = np.insert(data, cut, 0x20)
    moved = offsets + np.searchsorted(cut, offsets)
    return pc.ascii_lower(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(moved), pa.py_buffer(out)))


def word_coder(path: str | None = None) -> Coder:
    """Ids of white-space separated words. This vocabulary's pattern and normaliser never look
    across white space, so a text's ids are its words' ids one after another. Plain words are
    encoded many to a text, and told apart by the ids that end a word."""
    key = ("coder", path)
    if key not in _held:
        release()  # of other vocabularies
        tokenizer = word_tokenizer(path)
        vocabulary = tokenizer.get_vocab()
        final = np.zeros(max(vocabulary.values()) + 1, bool)
        final[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

        def one_by_one(words: list) -> tuple[np.ndarray, np.ndarray]:
            return joined([x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)])

        def encode(words: list) -> tuple[np.ndarray, np.ndarray]:
            plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
            some = [w for w, ok in zip(words, plain.tolist(), strict=True) if ok]
            texts = [" ".join(some[i : i + _TOGETHER]) for i in range(0, len(some), _TOGETHER)]
            ids = joined([x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])[0]
            ends = np.flatnonzero(final[ids]) + 1
            if len(ends) != len(some) or len(ids) != (ends[-1] if len(ends) else 0):
                return one_by_one(words)
            other_ids, other_sizes = one_by_one([w for w, ok in zip(words, plain.tolist(), strict=True) if not ok])
            sizes = np.zeros(len(words), np.int64)
            sizes[plain], sizes[~plain] = np.diff(ends, prepend=0), other_sizes
            out = np.zeros(int(sizes.sum()), np.uint32)
            is_plain = np.repeat(plain, sizes)
            out[is_plain], out[~is_plain] = ids, other_ids
            return out, sizes

        _held[key] = Coder(encode)
    return _held[key]


def coded(column: pa.Array, coder: Coder, prepare=None):
    """For runs of texts: first text, end text, each text's first word (n + 1 values), each word's code.

    Words are cut at ASCII white space; an empty one may stand at a text's ends and has no ids."""
    _, offsets = flat(column)
    collecting = gc.isenabled()
    gc.disable()  # millions of words live here that no collection would free
    try:
        for i, j, _, _ in chunks(np.zeros(0, np.uint8), offsets, CODED_BYTES):
            part = column.slice(i, j - i)
            if isinstance(part, pa.ChunkedArray):
                part = pa.concat_arrays(part.chunks)
            part = part.fill_null("").cast(pa.large_string())
            lists = pc.ascii_split_whitespace(prepare(part) if prepare else part)
            first = lists.offsets.to_numpy().astype(np.int64)
            found = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
            yield i, j, first - first[0], coder.codes(found.dictionary.to_pylist())[found.indices.to_numpy()]
    finally:
        if collecting:
            gc.enable()


def encode_texts(column: pa.Array, coder: Coder, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each with the end id, and how many each text has."""
    end = np.array([end_id] if end_id is not None else [], np.uint32)
    out, counts = [], np.zeros(len(column), np.int64)
    for i, j, first, codes in coded(column, coder, parted):
        ids, each = coder.gather(codes)
        ends = np.concatenate([[0], np.cumsum(each)])[first]
        counts[i:j] = np.diff(ends) + len(end)
        out.append(np.insert(ids, ends[1:], end[0]) if len(end) else ids)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
