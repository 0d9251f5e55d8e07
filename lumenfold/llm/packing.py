"""Packing by cutting-stock column generation.

Documents are cut into full pieces and one remainder; the corpus is then known by its histogram of
piece lengths, which has at most `capacity` entries however many documents there are. A linear
program over patterns (multisets of lengths that fit a sequence) minimises stored tokens. All its
columns come from a knapsack dynamic program over exact fills: first with the lengths themselves as
dual values, for as long as some length has demand that no pattern took, which gives a basis; then
with the basis's own dual values, until what the basis costs is within GAP of the bound that dual
values prove, or no pattern has a negative reduced cost. Patterns' counts are rounded down, what
is left goes by best fit, and pieces, ranked within their length, take the places that patterns
offer to that length.

A sequence is stored padded to the capacity, except one whose fill is a power of two, which is
stored as it is: such patterns cost their fill in the program, all others the capacity.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import base
from lumenfold.llm.tokens import CODED_BYTES, crc, encode_texts, word_coder

CAPACITY = 2048
#: The program ends when stored tokens are within this share of the bound that its dual values prove,
#: or when as many pivots as there are lengths have saved less than a tenth of it.
GAP = 1e-4
#: Reduced costs and steps this small are rounding.
_EPS, _STEP = 1e-7, 1e-9
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def stored(fill: np.ndarray | int, capacity: int) -> np.ndarray | int:
    """Tokens that a sequence of this fill takes."""
    fill = np.asarray(fill)
    return np.where(fill & (fill - 1) == 0, fill, capacity)


#: Lengths (indices) of a pattern, and how many of each.
Pattern = tuple[np.ndarray, np.ndarray]


class Knapsack:
    """The most that items can be worth at each exact fill, items of any number; of equal worth the longest is last."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, capacity: int):
        self.sizes, self.capacity, n = sizes, capacity, len(sizes)
        best, took = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
        best[0] = 0.0
        fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
        down, worth = sizes[::-1], values[::-1]
        for f in range(int(sizes[0]), capacity + 1):
            skip = n - fits[f]
            found = best[f - down[skip:]] + worth[skip:]
            k = int(found.argmax())
            best[f], took[f] = found[k], n - 1 - skip - k
        self.best, self.took = best, took
        # the best fill up to each room
        self.top = np.maximum.accumulate(best)
        self.at = np.maximum.accumulate(np.where(best == self.top, np.arange(capacity + 1), 0))

    def items(self, fill: int) -> list[int]:
        """Items of the best content of exactly this fill."""
        out = []
        while fill:
            out.append(int(self.took[fill]))
            fill -= int(self.sizes[out[-1]])
        return out


def _pattern(items: list[int]) -> Pattern:
    return np.unique(np.array(items, np.int64), return_counts=True)


def priced_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray, int]:
    """A pattern for each length, how often it is used, and how many knapsacks were solved.

    The lengths are dual values that no pattern is worth more than it costs at. A knapsack over the
    lengths with demand left gives for each of them, longest first, the best pattern that holds it;
    it is used until it takes the last of some length, whose pattern in the basis it becomes. No
    later pattern holds that length, so the basis is triangular."""
    m, left = len(lengths), demand.astype(float).copy()
    patterns: list[Pattern | None] = [None] * m
    uses, open_, solved = np.zeros(m), np.ones(m, bool), 0
    while open_.any():
        here = np.flatnonzero(open_)
        sack = Knapsack(lengths[here], lengths[here].astype(float), capacity)
        solved += 1
        for i in here[::-1].tolist():
            if not open_[i]:
                continue
            items = here[sack.items(int(sack.at[capacity - lengths[i]]))]
            if not open_[items].all():  # taken up by a pattern of this round
                continue
            which, times = pattern = _pattern([i, *items.tolist()])
            r = int((left[which] / times).argmin())
            used = left[which[r]] / times[r]
            left[which] = np.maximum(left[which] - times * used, 0)
            last = int(which[r])
            patterns[last], uses[last], left[last], open_[last] = pattern, used, 0.0, False
    return patterns, uses, solved


def _columns(sack: Knapsack, lengths: np.ndarray, values: np.ndarray, capacity: int) -> list[Pattern]:
    """For each length the best pattern that holds it, and the best of each fill that is stored as it is; with negative reduced cost."""
    found = {}
    for i in np.flatnonzero(values + sack.top[capacity - lengths] > capacity + _EPS).tolist():
        found[tuple(sorted([i, *sack.items(int(sack.at[capacity - lengths[i]]))]))] = True
    fills = np.arange(1, capacity + 1)
    cost = stored(fills, capacity)
    for f in fills[(cost < capacity) & (sack.best[1:] > cost + _EPS)].tolist():
        found[tuple(sorted(sack.items(f)))] = True
    return [_pattern(list(items)) for items in found]


@dataclass
class Program:
    """Patterns of the basis, how often each is used, tokens stored, the bound below them that dual values
    prove, knapsacks solved, and columns that entered the basis after the first."""

    patterns: list[Pattern]
    uses: np.ndarray
    cost: float
    bound: float
    solved: int
    entered: int


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> Program:
    """The linear program over patterns of distinct, ascending lengths <= capacity with a positive demand each."""
    patterns, uses, solved = priced_basis(lengths, demand, capacity)
    pay = lambda p: float(stored(int(p[1] @ lengths[p[0]]), capacity))
    cost = np.array([pay(p) for p in patterns])
    bound, entered, m = float(lengths @ demand), 0, len(lengths)
    if cost @ uses * (1 - gap) <= bound:
        return Program(patterns, uses, float(cost @ uses), bound, solved, entered)
    basis = np.zeros((m, m))
    for r, (which, times) in enumerate(patterns):
        basis[which, r] = times
    inverse = np.linalg.inv(basis)
    # demands a little apart: no two lengths run out in the same pivot, so none is for nothing
    uses = inverse @ (demand * (1 + 1e-7 * (1 + np.arange(m) * 0.6180339887 % 1)))
    milestone, due = float(cost @ uses), m
    while True:
        values = cost @ inverse
        sack = Knapsack(lengths, values, capacity)
        solved += 1
        # scaled until no pattern is worth more than it costs, values prove a bound
        ratio = float((sack.best[1:] / stored(np.arange(1, capacity + 1), capacity)).max())
        now, bound = float(cost @ uses), max(bound, float(values @ demand) / max(ratio, 1.0))
        columns = _columns(sack, lengths, values, capacity)
        if now * (1 - gap) <= bound or not columns:
            break
        if entered >= due:
            if now > milestone * (1 - gap / 10):
                break
            milestone, due = now, entered + m
        sizes = np.array([len(which) for which, _ in columns])
        first = np.cumsum(sizes) - sizes
        which, times = (np.concatenate([c[k] for c in columns]) for k in (0, 1))
        pays = np.array([pay(c) for c in columns])
        before = entered
        for _ in range(m):
            reduced = pays - np.add.reduceat(times * values[which], first)
            q = int(reduced.argmin())
            if reduced[q] > -_EPS:
                break
            step = inverse[:, columns[q][0]] @ columns[q][1]
            leaves = np.flatnonzero(step > _STEP)
            k = int((uses[leaves] / step[leaves]).argmin())
            r = int(leaves[k])
            used, row = uses[r] / step[r], inverse[r] / step[r]
            others, across = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
            others = others[others != r]
            uses[others] = np.maximum(uses[others] - used * step[others], 0)
            inverse[np.ix_(others, across)] -= np.outer(step[others], row[across])
            inverse[r], uses[r], patterns[r], cost[r] = row, used, columns[q], pays[q]
            values = values + reduced[q] * row
            entered += 1
        if entered == before:  # what is left is rounding
            break
    return Program(patterns, uses, float(cost @ uses), bound, solved, entered)


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Places for all pieces: for each length, runs of ranks [rank, rank + copies) that stand at
    `offset` of sequences sequence, sequence + 1, ..., stored in `size` tokens each."""
    out: list[tuple[int, int, int, int, int, int]] = []
    next_rank = dict.fromkeys(lengths.tolist(), 0)
    sequence = 0

    def place(content: list[int], copies: int) -> None:
        nonlocal sequence
        size, offset = int(stored(sum(content), capacity)), 0
        # a length that stands k times in a pattern takes k runs of ranks
        for length in content:
            out.append((length, next_rank[length], copies, sequence, offset, size))
            next_rank[length] += copies
            offset += length
        sequence += copies

    left = demand.astype(np.int64).copy()
    partial = lengths < capacity
    if (~partial).any():
        k = int(np.flatnonzero(~partial)[0])
        place([int(lengths[k])], int(left[k]))
        left[k] = 0
    inner, want = lengths[partial], left[partial]
    if len(inner):
        program = solve(inner, want.astype(float), capacity)
        want = want.copy()
        for (which, times), n in zip(program.patterns, np.floor(program.uses * (1 + 1e-6) + 1e-6).astype(np.int64).tolist(), strict=True):
            n = min(n, int((want[which] // times).min()))
            if n:
                want[which] -= n * times
                place(np.repeat(inner[which], times)[::-1].tolist(), n)
        # best fit, longest first; open sequences by the room they have left
        room: list[tuple[int, int]] = []
        opened: list[list[int]] = []
        for length in np.repeat(inner, want)[::-1].tolist():
            k = bisect.bisect_left(room, (length, -1))
            if k == len(room):
                opened.append([length])
                bisect.insort(room, (capacity - length, len(opened) - 1))
            else:
                space, to = room.pop(k)
                opened[to].append(length)
                bisect.insort(room, (space - length, to))
        for content in opened:
            place(content, 1)
    table = np.array(sorted(out), np.int64).reshape(-1, 6)
    return dict(zip(("length", "rank", "copies", "sequence", "offset", "size"), table.T, strict=True))


def cut(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: as many full ones as there are, then the remainder."""

    def run(batches):
        coder = word_coder(tokenizer)
        for batch in batches:
            for part in base.pieces(batch, CODED_BYTES):
                ids, sizes = encode_texts(part.column("text"), coder, end_id)
                n = -(-sizes // capacity)
                start = base.spread(np.zeros(len(n), np.int64), n) * capacity
                total = np.repeat(sizes, n)
                length = np.minimum(capacity, total - start)
                at = np.repeat(np.cumsum(sizes) - sizes, n) + start
                sums = [crc(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.repeat(part.column("doc_id").to_numpy(), n), start, length, sums, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                del ids
        base.trim()

    return base.documents(docs).mapInArrow(run, PIECES)


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """rank: 0, 1, ... among pieces of a length. Ranks are counted within salted shares of a length and
    shifted by the shares before, so that no task holds all pieces of a common length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return salted.withColumn("local", local).join(shifts, ["length", "salt"]).withColumn("rank", (F.col("local") + F.col("shift")).cast("long")).drop("salt", "local", "shift")


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: PIECES, sequence_id, offset (gapless from 0) and sequence_size (tokens stored).

    A null or empty text is the end id alone, one piece. Rows that repeat a doc_id are packed each
    on its own. An empty table gives no rows."""
    pieces = base.written(cut(docs, tokenizer, end_id, capacity))
    histogram = sorted((r[0], r[1]) for r in pieces.groupBy("length").count().collect())  # `capacity` rows at most
    lengths, demand = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    places = plan(lengths, demand, capacity)
    keys = places["length"] << np.int64(44) | places["rank"]
    # a share of a length holds about 50,000 pieces or fewer
    salts = max(16, -(-int(demand.max(initial=0)) // 50_000))

    def seat(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length << np.int64(44) | rank, "right") - 1
            columns = [places["sequence"][k] + rank - places["rank"][k], places["offset"][k], places["size"][k]]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *map(pa.array, columns)], names=[*names, "sequence_id", "offset", "sequence_size"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked(pieces, salts).select(*columns, "rank").mapInArrow(seat, f"{PIECES}, sequence_id bigint, offset bigint, sequence_size bigint")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in sequences of at most 2048 tokens; columns of `packed`."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
