import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import binary_output, byte_bpe, packing
from lumenfold.llm.base import shared_dir
from lumenfold.llm.tokens import encode_texts, word_coder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
RANKS = byte_bpe.load_ranks()
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def with_ids(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_word_by_word_ids_are_the_texts_ids(text):
    ids, counts = encode_texts(pa.array([text, None, text]), word_coder(), 1)
    own = ids_of(text)
    assert ids.tolist() == own + [1] + own
    assert counts.tolist() == [len(own), 1, len(own)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_segment_tree_merges_as_tiktoken_does(text):
    ids, _ = byte_bpe.encoder().encode_batch([text])
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert byte_bpe.encoder().decode(ids).tobytes() == text.encode()


def test_a_long_piece_merges_too():
    piece = b"ab" * 5_000
    assert byte_bpe.encode_piece(piece, RANKS) == TIKTOKEN.encode_ordinary(piece.decode())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_bit_planes_round_trip(ids):
    planes = binary_output.encode_block(np.array(ids, np.uint32))
    assert binary_output.decode_block(planes, len(ids)).tolist() == ids


def test_files_give_back_every_document(spark, docs, empty):
    path = shared_dir(spark)
    binary_output.write(docs, path, block_ids=100, shard_bytes=1 << 12)
    out = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in binary_output.read(spark, path).collect())
    at, want = 0, []
    for doc, text in with_ids(docs):
        ids = ids_of(text)
        want.append((doc, at, len(ids), crc(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert out == sorted(want)
    path = shared_dir(spark)
    binary_output.write(empty, path)
    assert binary_output.read(spark, path).count() == 0


def test_byte_bpe_query(spark, docs, empty):
    out = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode(docs, digests=True).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc, text in with_ids(docs):
        ids = TIKTOKEN.encode_ordinary(text)
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())))
    assert out == sorted(want)
    assert byte_bpe.encode(empty).count() == 0


def test_packing_places_every_id_once(spark, docs, empty):
    rows = packing.packed(docs, capacity=64).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc, text in with_ids(docs):
        if doc == 8:  # repeated: both rows are packed
            continue
        ids, at = ids_of(text), 0
        for start, length, sum_, total in sorted(pieces[doc]):
            assert (start, total, sum_) == (at, len(ids), crc(ids[at : at + length]))
            at += length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_size"]))
    for places in sequences.values():
        at = 0
        for offset, length, size in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
        assert size == (at if at & (at - 1) == 0 else 64)
    assert packing.packed(empty).count() == 0


def test_column_generation_wastes_little():
    rng = np.random.default_rng(3)
    lengths, demand = np.unique(np.minimum(2047, 1 + rng.lognormal(6, 1, 5_000).astype(int)), return_counts=True)
    places = packing.plan(lengths, demand)
    sizes = np.zeros(int((places["sequence"] + places["copies"]).max()), np.int64)
    for s, n, size in zip(places["sequence"], places["copies"], places["size"], strict=True):
        sizes[s : s + n] = size
    assert places["copies"].sum() == demand.sum()
    assert (lengths @ demand) / sizes.sum() > 0.99


def test_pricing_finds_the_best_pattern():
    lengths, values = np.array([3, 5, 7]), np.array([3.3, 5.1, 7.9])
    sack = packing.Knapsack(lengths, values, 16)
    fills = np.arange(1, 17)
    costs = packing.stored(fills, 16) - sack.best[1:]
    best = min(packing.stored(3 * a + 5 * b + 7 * c, 16) - (3.3 * a + 5.1 * b + 7.9 * c) for a in range(6) for b in range(4) for c in range(3) if 0 < 3 * a + 5 * b + 7 * c <= 16)
    assert abs(costs.min() - best) < 1e-9
    items = np.array(sack.items(int(fills[costs.argmin()])))
    assert abs(packing.stored(int(lengths[items].sum()), 16) - values[items].sum() - best) < 1e-9


def test_columns_are_priced_until_the_bound():
    """Every column comes from a knapsack, later ones enter where the first basis leaves a gap, and the bound is a bound."""
    rng = np.random.default_rng(1)
    entered = 0
    for lengths in (np.array([700, 703, 900, 1030]), np.sort(rng.choice(np.arange(300, 1200), 60, False)), np.sort(rng.choice(np.arange(500, 1500), 120, False))):
        demand = rng.integers(1, 300, len(lengths))
        program = packing.solve(lengths, demand.astype(float), 2048)
        entered += program.entered
        assert program.solved > 0
        # never below the tokens, within the gap of what dual values prove unless pricing found nothing more
        assert lengths @ demand - 1e-6 <= program.bound * (1 + 1e-6) <= program.cost * (1 + 2e-6)
        assert program.bound >= program.cost * (1 - 2 * packing.GAP)
        made = np.zeros(len(lengths))
        for (which, times), uses in zip(program.patterns, program.uses, strict=True):
            assert times @ lengths[which] <= 2048 and uses >= 0
            made[which] += times * uses
        assert np.allclose(made, demand, rtol=1e-5)
    assert entered > 0
