"""Language-model scoring by masked pseudo-likelihood.

A small network sees the words on both sides of a token, never the token itself, and gives its
probability; a document's score is the sum of the logarithms over all its tokens.

Vocabulary: every word of the corpus (ASCII letters lower-cased), with its count in a table by ranges
of hashes. The most frequent ones, as many as the root of the corpus's tokens asks for, have an id each;
the others share hashed ids, and within one a word has its share of the id's tokens, which documents
learn by a join on hashes. Network: each of 2 * SIDE neighbours gives an embedding scaled by weights of
its offset, their sum goes through tanh, and the output is a softmax a digit of the id, in a tree of
LEVELS. Training is data-parallel in rounds: documents are dealt by hash to shards of rounds, each shard
of a round takes Adagrad steps from what the last round's shards came to on average, and shards, rounds
and steps in each follow the corpus's tokens alone, never its partitions. Then a second map scores every
document.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import base
from lumenfold.llm.base import blocks, bucket_bounds, bucket_count, chunks, flat, group_starts, pack, remove, shared_dir, spread, unpack, word_hashes, word_spans, written

SIDE = 3
WIDTH = 16
#: Digits of an id, and the least number of words with an own id and of hashed ids.
LEVELS, LEAST_KNOWN, LEAST_HASHED = 3, 2_000, 400
#: Text bytes whose words are looked up together.
LOOKUP_BYTES = 8 << 20
#: Tokens of a step, and the least; a small corpus has STEPS steps.
STEP_TOKENS, LEAST_STEP, STEPS = 1 << 15, 1 << 10, 64
RATE = 0.1
#: Parameter sets averaged in one task.
FAN_IN = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and how many each text has."""
    out, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, part, at in chunks(data, offsets):
        part = _LOWER[part]
        starts, ends, first = word_spans(part, at)
        out.append(word_hashes(part, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(out), np.concatenate(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """bucket, tokens, words and blob (hashes as differences, counts): every word of each range of hashes, a row a range."""
    n_buckets = bucket_count(docs, LOOKUP_BYTES)

    def count(batches):
        for table in blocks(batches):
            h, _ = words_of(*flat(table.column("text")))
            h, n = np.unique(h, return_counts=True)
            bounds = bucket_bounds(h, n_buckets)
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(bounds[b], bounds[b + 1])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(np.diff(h[s], prepend=np.uint64(0)), n[s].astype(np.uint32))], pa.binary())], names=["bucket", "blob"])

    def total(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        h = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in parts])
        n = np.concatenate([x for _, x in parts]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        begin = group_starts(h[order])
        h, n = h[order][begin], np.add.reduceat(n[order], begin)
        blob = pack(np.diff(h, prepend=np.uint64(0)), n)
        return pa.table([table.column("bucket")[:1], pa.array([int(n.sum())], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "tokens", "words", "blob"])

    return docs.mapInArrow(count, "bucket int, blob binary").groupBy("bucket").applyInArrow(total, "bucket int, tokens bigint, words bigint, blob binary")


def _counted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, n = unpack(blob)
    return np.cumsum(h, dtype=np.uint64), n


def sizes(tokens: int) -> tuple[int, int]:
    """Words with an own id, and the base of ids' digits, for a corpus of so many tokens."""
    known = max(LEAST_KNOWN, isqrt(tokens) // 2)
    slots, base = known + max(LEAST_HASHED, known // 5), 1
    while base**LEVELS < slots:
        base += 1
    return known, base


def vocabulary_of(counts: DataFrame, tokens: int) -> Vocabulary:
    """The corpus's most frequent words and, of hashed ids, the logarithms of their tokens."""
    known, base = sizes(tokens)

    def most(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                h, n = _counted(blob)
                top = np.lexsort((h, -n))[:known]
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top])], names=["word", "n"])

    rows = counts.select("blob").mapInArrow(most, "word bigint, n bigint").orderBy(F.desc("n"), "word").limit(known).collect()  # a root of the tokens
    vocabulary = Vocabulary(np.array([r["word"] for r in rows], np.int64).view(np.uint64), base)

    def shared(batches):
        for batch in batches:
            total = np.zeros(vocabulary.PAD, np.int64)
            for blob in batch.column("blob").to_pylist():
                h, n = _counted(blob)
                np.add.at(total, vocabulary.ids(h), n)
            some = np.flatnonzero(total)
            some = some[some >= len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    for r in counts.select("blob").mapInArrow(shared, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row a hashed id
        vocabulary.log_tokens[r["id"]] = np.log(r["n"])
    return vocabulary


class Vocabulary:
    """Ids of word hashes: the known words' by frequency, then hashed ones; PAD stands outside texts."""

    def __init__(self, words: np.ndarray, base: int = sizes(0)[1]):
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.base, self.PAD = base, base**LEVELS
        #: Of each id, the logarithm of the tokens that its words share; 0 of an id that is one word's.
        self.log_tokens = np.zeros(self.PAD)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.words)
        other = n + ((hashes >> np.uint64(20)) % np.uint64(self.PAD - n)).astype(np.int64)
        if not n:
            return other
        at = np.minimum(np.searchsorted(self.words, hashes), n - 1)
        return np.where(self.words[at] == hashes, self.order[at], other)

    def stream(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with SIDE pads before and after each, where the tokens stand, how many each text has, and their hashes."""
        h, counts = words_of(data, offsets)
        return *self.padded(self.ids(h), counts), counts, h

    def padded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with the pads, and where the tokens stand."""
        place = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(counts)), counts))
        out = np.full(len(ids) + SIDE * (len(counts) + 1), self.PAD)
        out[place] = ids
        return out, place


class Network:
    def __init__(self, flat_values: np.ndarray | None = None, seed: int = 7, base: int = sizes(0)[1]):
        self.base = base
        shapes = {"embedding": (base**LEVELS + 1, WIDTH), "offset": (2 * SIDE + 1, WIDTH), "bias": (WIDTH,)}
        for k in range(LEVELS):
            shapes |= {f"out{k}": (base**k, base, WIDTH), f"out{k}_bias": (base**k, base)}
        if flat_values is None:
            rng = np.random.default_rng(seed)
            drawn = {"embedding", *(f"out{k}" for k in range(LEVELS))}
            self.p = {k: (rng.normal(0, 0.1, s) if k in drawn else np.ones(s) if k == "offset" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
            self.p["embedding"][-1] = 0
            self.p["offset"][SIDE] = 0  # a token never sees itself
        else:
            self.p, at = {}, 0
            for k, s in shapes.items():
                n = int(np.prod(s))
                self.p[k] = flat_values[at : at + n].reshape(s).astype(np.float32)
                at += n
        self.squares = None

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def state(self) -> np.ndarray:
        """Parameters, and Adagrad's sums of squares after them."""
        return np.concatenate([self.flat(), *(v.reshape(-1) for v in self.squares.values())])

    @classmethod
    def resumed(cls, state: np.ndarray, base: int) -> Network:
        """A network that trains on from a state."""
        half = len(state) // 2
        network, squares = cls(state[:half].copy(), base=base), cls(state[half:].copy(), base=base)
        network.squares = squares.p
        return network

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        low = int(at[0]) - SIDE
        e = self.p["embedding"][ids[low : int(at[-1]) + SIDE + 1]]
        n = len(e) - 2 * SIDE
        total = np.zeros((n, WIDTH), np.float32)
        for o in range(2 * SIDE + 1):
            if o != SIDE:
                total += e[o : o + n] * self.p["offset"][o]
        return np.tanh(total[at - low - SIDE] + self.p["bias"]), e, low

    @staticmethod
    def _by_id(ids: np.ndarray, limit: int) -> np.ndarray:
        """A stable order by id."""
        return np.argsort(ids.astype(np.uint16 if limit < 1 << 16 else np.int32), kind="stable")

    def _level(self, k: int, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]], np.ndarray]:
        """Of sorted ids: logits of the k-th digit less their largest, the digits, and the runs of rows under each node."""
        prefix, digit = np.divmod(ids // self.base ** (LEVELS - 1 - k), self.base)
        begin = group_starts(prefix)
        runs = [(p, slice(s, t)) for p, s, t in zip(prefix[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True)]
        x, w = self.p[f"out{k}_bias"][prefix], self.p[f"out{k}"]
        for p, rows in runs:
            x[rows] += h[rows] @ w[p].T
        x -= x.max(axis=1, keepdims=True)
        return x, digit, runs, begin

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(token | both sides) at each place."""
        out = np.zeros(len(at))
        for i in range(0, len(at), STEP_TOKENS):
            part = at[i : i + STEP_TOKENS]
            h, _, _ = self._hidden(ids, part)
            order = self._by_id(ids[part], self.base**LEVELS)
            of, h, row = ids[part][order], h[order], np.arange(len(part))
            got = np.zeros(len(part))
            for k in range(LEVELS):
                x, digit, _, _ = self._level(k, of, h)
                got += x[row, digit] - np.log(np.exp(x).sum(axis=1))
            out[i + order] = got
        return out

    def _begin(self) -> None:
        if self.squares is None:
            self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    def train(self, ids: np.ndarray, at: np.ndarray, step: int = STEP_TOKENS) -> None:
        """One pass of Adagrad over the tokens."""
        self._begin()
        for i in range(0, len(at), step):
            self._step(ids, at[i : i + step])

    def _step(self, ids: np.ndarray, at: np.ndarray) -> None:
        p, n = self.p, len(at)
        h, e, first = self._hidden(ids, at)
        order = self._by_id(ids[at], self.base**LEVELS)
        of, sorted_h, row = ids[at][order], h[order], np.arange(n)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        under = np.zeros_like(h)
        for k in range(LEVELS):
            x, digit, runs, begin = self._level(k, of, sorted_h)
            np.exp(x, out=x)
            x /= x.sum(axis=1, keepdims=True)
            x[row, digit] -= 1
            w, gw = p[f"out{k}"], g[f"out{k}"]
            for node, rows in runs:
                gw[node] = x[rows].T @ sorted_h[rows]
                under[rows] += x[rows] @ w[node]
            g[f"out{k}_bias"][[node for node, _ in runs]] = np.add.reduceat(x, begin)
        back = np.empty_like(under)
        back[order] = under
        back *= 1 - h * h
        g["bias"] = back.sum(axis=0)
        wide = np.zeros((len(e) - 2 * SIDE, WIDTH), np.float32)
        wide[at - first - SIDE] = back
        to = np.zeros_like(e)
        for o in range(2 * SIDE + 1):
            if o != SIDE:
                g["offset"][o] = (wide * e[o : o + len(wide)]).sum(axis=0)
                to[o : o + len(wide)] += wide * p["offset"][o]
        seen = ids[first : first + len(e)]
        order = self._by_id(seen, self.base**LEVELS + 1)
        begin = group_starts(seen[order])
        g["embedding"][seen[order][begin]] = np.add.reduceat(to[order], begin)
        g["embedding"][-1] = 0
        for k, v in p.items():
            grad = g[k] / np.float32(n) * np.float32(64)
            self.squares[k] += grad * grad
            v -= np.float32(RATE) * grad / np.sqrt(self.squares[k])


def schedule(tokens: int) -> tuple[int, int]:
    """Tokens of a step, and how many rounds and shards of each: both, and the steps in each, are the cube root of the steps in all."""
    step = min(STEP_TOKENS, max(LEAST_STEP, tokens // STEPS))
    return step, max(1, round((tokens / step) ** (1 / 3)))


def _labels(spark: SparkSession, n: int) -> list[int]:
    """Numbers of n shards that hash partitioning deals to n partitions, one each."""
    found = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.expr(f"pmod(hash(id), {n})").alias("to")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in found.collect())  # n rows


def trained(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> Network:
    """The network after all rounds; the same for any partitioning of the documents."""
    spark, size = docs.sparkSession, vocabulary.base
    step, rounds = schedule(tokens)
    labels = _labels(spark, rounds)
    network = Network(base=size)
    network._begin()
    state, n = network.state(), len(network.flat())

    def deal(batches):
        for table in blocks(batches):
            ids, at, counts, _ = vocabulary.stream(*flat(table.column("text")))
            ids = ids[at].astype(np.uint32)
            key = table.column("key").to_numpy().view(np.uint64)
            piece = (key % np.uint64(rounds * len(labels))).astype(np.int64)
            ends = np.cumsum(counts)
            order = np.argsort(piece, kind="stable")
            begin = group_starts(piece[order])
            for s, t in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
                some = order[s:t]
                blob = pack(key[some], counts[some], ids[spread(ends[some] - counts[some], counts[some])])
                of, shard = divmod(int(piece[some[0]]), len(labels))
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([labels[shard]], pa.int32()), pa.array([blob], pa.binary())], names=["round", "shard", "blob"])

    path = shared_dir(spark)
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key"))
    keyed.mapInArrow(deal, "round int, shard int, blob binary").write.partitionBy("round").parquet(path)
    dealt = spark.read.schema("shard int, blob binary, round int").parquet(path)
    schema = "part bigint, tokens double, state binary"

    def row(part: int, weight: float, values: np.ndarray) -> pa.Table:
        return pa.table([pa.array([part], pa.int64()), pa.array([weight]), pa.array([values.astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "state"])

    def average(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("part").to_pylist(), table.column("tokens").to_pylist(), table.column("state"), strict=True), key=lambda x: x[:2])
        weight, total = sum(x[1] for x in found), np.zeros(2 * n)
        for _, w, blob in found:
            total += w / weight * np.frombuffer(blob.as_py(), np.float32)
        return row(found[0][0] // FAN_IN, weight, total)

    for k in range(rounds):

        def learn(table: pa.Table) -> pa.Table:
            parts = [unpack(x) for x in table.column("blob").to_pylist()]
            key, counts, ids = (np.concatenate([x[i] for x in parts]) for i in range(3))
            order = np.argsort(key, kind="stable")
            ids = ids[spread((np.cumsum(counts) - counts)[order], counts[order])]
            stream, at = vocabulary.padded(ids, counts[order])
            network = Network.resumed(state, size)
            if len(at):
                network.train(stream, at, step)
            return row(labels.index(table.column("shard")[0].as_py()), float(len(at)) or 1e-9, network.state())

        found = dealt.where(F.col("round") == k).select("shard", "blob").repartition(len(labels), "shard").groupBy("shard").applyInArrow(learn, schema)
        left = len(labels)
        while True:
            found = found.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(average, schema)
            left = -(-left // FAN_IN)
            if left == 1:
                break
        got = found.collect()  # one state, or none of a round without documents
        if got:
            state = np.frombuffer(bytes(got[0]["state"]), np.float32)
    remove(spark, path)
    return Network(state[:n].copy(), base=size)


SCORED = "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_probability double"


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens) and mean_log_probability, a row a document.

    Null, empty and blank texts have no tokens: their sum is 0 and their mean null. Rows that
    repeat an id are scored each on its own; an empty table gives no rows."""
    docs = base.documents(docs)
    counts = written(word_counts(docs))
    tokens = counts.agg(F.sum("tokens")).first()[0] or 0
    vocabulary = vocabulary_of(counts, tokens)
    parameters = trained(docs, vocabulary, tokens).flat()
    n_buckets = bucket_count(docs, LOOKUP_BYTES)
    names = ["block", "bucket", "blob"]

    def score(batches):
        """A blob a block of documents, in bucket -1: ids, tokens and what the network gives; and one for each range of hashes: words without an own id, their documents and how often."""
        from pyspark import TaskContext

        network = Network(parameters, base=vocabulary.base)
        for k, table in enumerate(blocks(batches)):
            block = (TaskContext.get().partitionId() << 32) + k
            words, owners, lengths, sums, done = [], [], [], [], 0
            for part in base.pieces(table, 8 << 20):
                ids, at, n, h = vocabulary.stream(*flat(part.column("text")))
                ids_at = ids[at]
                total = np.concatenate([[0.0], np.cumsum(network.log_probabilities(ids, at) - vocabulary.log_tokens[ids_at])])
                ends = np.cumsum(n)
                lengths.append(n)
                sums.append(total[ends] - total[ends - n])
                rare = np.flatnonzero(ids_at >= len(vocabulary.words))
                words.append(h[rare])
                owners.append(done + np.searchsorted(ends, rare, "right"))
                done += len(n)
            ids = table.column("doc_id").to_numpy()
            out = [(-1, pack(ids, np.concatenate(lengths), np.concatenate(sums)))]
            h, of = np.concatenate(words), np.concatenate(owners).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(begin, len(h))).astype(np.uint32)
            h, of = h[begin], of[begin]
            bounds = bucket_bounds(h, n_buckets)
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(bounds[b], bounds[b + 1])
                out.append((b, pack(np.diff(h[s], prepend=np.uint64(0)), of[s], times[s])))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=names)

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        """For each block, the sum of the logarithms of its documents' word counts."""
        out = []
        known = _counted(held.column("blob")[0].as_py()) if len(asked) else None
        for block, bucket, blob in zip(*(asked.column(c).to_pylist() for c in names), strict=True):
            h, of, times = unpack(blob)
            logs = np.log(known[1][np.searchsorted(known[0], np.cumsum(h, dtype=np.uint64))]) * times
            each, inverse = np.unique(of, return_inverse=True)
            out.append((block, bucket, pack(each, np.bincount(inverse, logs))))
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=names)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
        ids, n, sums = unpack(rows[0][1])
        for _, blob in rows[1:]:
            of, more = unpack(blob)
            sums[of] += more
        sums = np.round(sums, 3)
        means = [round(x / k, 6) if k else None for x, k in zip(sums.tolist(), n.tolist(), strict=True)]
        return pa.table([pa.array(ids), pa.array(n, pa.int64()), pa.array(sums), pa.array(means, pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_probability"])

    kind = "block bigint, bucket int, blob binary"
    found = written(docs.mapInArrow(score, kind), "none")
    rare = found.where("bucket >= 0").groupBy("bucket").cogroup(counts.select("bucket", "blob").groupBy("bucket")).applyInArrow(look_up, kind)
    return found.where("bucket < 0").unionByName(rare).groupBy("block").applyInArrow(add, SCORED)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every text of `documents`; columns of `scored`."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
