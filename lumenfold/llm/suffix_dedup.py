"""Exact duplicate strings with a logarithmic family of suffix arrays.

Every string of `length` bytes that also starts earlier in the corpus is removed. The work:

1. Anchors. Each window of `length` bytes names one of its k-grams by a rule that looks at the window's
   bytes alone (the least hash, leftmost of equals), so equal windows name the same k-gram at the
   same place in them. Consecutive windows mostly share their anchor: an instance is an anchor
   with its run of windows. Only instances whose k-gram hash occurs again anywhere can hold a repeat.
2. Those instances' bytes meet in buckets by the anchor's hash. Anchors so common that one bucket
   should not hold them (their number is bounded, see HOT_ANCHORS) have their windows dealt one by
   one, by the window's own hash.
3. A bucket's instances come in batches, in corpus order, to an index (SuffixFamily). A batch gets a
   suffix array: its anchors in the order of the bytes from there on, and then of those before. It
   is merged with every level of the index, a scan of two sorted runs. Where all bytes are equal,
   the whole run repeats. Where the k-gram is, bytes are compared both ways from the anchor,
   which says for each window of the run whether it repeats; an anchor that has more than
   MOST_PAIRED different surroundings is scanned by all its windows instead, so that work stays in
   proportion to them. What is left of the batch becomes a level, and levels of like size
   merge, so an index of n suffixes has at most log n levels. Bytes are compared, never hashes.

Tasks run their own blocks through such an index first, so what they see twice is sent once.
An index can be kept: `extended` returns its levels as rows, and meets the next batch with them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import base, exchange
from lumenfold.llm.base import blocks, bucket_bounds, byte_values, chunks, flat, group_starts, mix, pack, rolling, spread, trim, unpack, written
from lumenfold.llm.numbering import keyed

LENGTH = 100
#: Anchors of a batch, and windows that are scanned together.
BATCH_ANCHORS, BATCH = 1 << 16, 1 << 16
#: Surroundings of an anchor that are compared pair by pair.
MOST_PAIRED = 24
#: Anchors with LEAST_HOT instances or more are dealt by window, the HOT_ANCHORS most common ones at
#: most: the list that tasks get has a bounded size, and an anchor beyond it a bounded share of all.
HOT_ANCHORS = 50_000
LEAST_HOT = 2_000
#: Text bytes whose anchors a bucket holds, and whose marks a share of documents, on average.
BUCKET_BYTES, SHARE_BYTES = 4 << 20, 16 << 20
#: Bytes of a text hashed together; a longer text is one chunk.
_PLACE_BITS = np.uint64(30)


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of a and b share, `most` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


class Anchors:
    """Anchors with what surrounds them. Of each: its hash, document, first window, number of windows and
    the bytes from that window to the anchor; their bytes lie one after another in `text`."""

    def __init__(self, h, doc, start, windows, back, text, length: int):
        self.h, self.doc, self.text, self.length = h, doc, text, length
        self.start, self.windows, self.back = (x.astype(np.int64) for x in (start, windows, back))
        self.sizes = self.windows + length - 1
        self.at = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, i: np.ndarray) -> Anchors:
        return Anchors(self.h[i], self.doc[i], self.start[i], self.windows[i], self.back[i], self.text[spread(self.at[i], self.sizes[i])], self.length)

    @staticmethod
    def joined(parts: list[Anchors]) -> Anchors:
        return Anchors(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("h", "doc", "start", "windows", "back", "text")), parts[0].length)

    def in_order(self) -> Anchors:
        """In corpus order."""
        return self.take(np.lexsort((self.start, self.doc)))

    def keys(self) -> np.ndarray:
        """A row an anchor: `length` bytes from it on, half as many before it, backwards, both filled up with
        zeros, and how many of either are its own. Equal rows are equal surroundings."""
        n, behind = self.length, self.length - self.length // 2
        out = np.zeros((len(self), n + behind + 5), np.uint8)
        if not len(self):
            return out
        padded = np.concatenate([np.zeros(n, np.uint8), self.text, np.zeros(n, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, n)
        ahead, place = self.sizes - self.back, self.at + self.back + n
        for i in range(0, len(self), 1 << 14):
            k = slice(i, i + (1 << 14))
            out[k, :n] = np.where(np.arange(n) < ahead[k, None], view[place[k]], 0)
            out[k, n : n + behind] = np.where(np.arange(behind) < self.back[k, None], view[place[k] - n][:, ::-1][:, :behind], 0)
        out[:, -5], out[:, -4], out[:, -3], out[:, -2] = ahead >> 8, ahead, self.back >> 8, self.back
        out[:, -1] = 1  # strings end where zeros do
        return out

    @staticmethod
    def unpacked(blob: bytes, length: int) -> Anchors:
        h, *rest = unpack(blob)
        return Anchors(np.cumsum(h, dtype=np.uint64), *rest, length)

    def window_keys(self, i: np.ndarray) -> np.ndarray:
        """The `length` bytes of all windows of anchors i, one after another."""
        return _strings(np.lib.stride_tricks.sliding_window_view(self.text, self.length)[spread(self.at[i], self.windows[i])])

    def packed(self) -> bytes:
        return pack(np.diff(self.h, prepend=np.uint64(0)), self.doc, self.start.astype(np.uint32), self.windows.astype(np.uint32), self.back.astype(np.uint16), self.text)


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-width strings, which sort like bytes."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1)


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of two sorted runs together, a's first among equals, and where each group of equals begins.

    A stable sort of two runs is one merging scan."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    return order, group_starts(both[order])


def held_by(level: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted keys, the first place of its equals in the sorted level, and how many there are."""
    order, starts = _merged(level, keys)
    ends = np.append(starts[1:], len(order))
    of_level = np.concatenate([[0], np.cumsum(order < len(level))])
    first, count = of_level[starts], of_level[ends] - of_level[starts]
    group = np.repeat(np.arange(len(starts)), ends - starts)
    mine = order >= len(level)
    begin, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    begin[order[mine] - len(level)], n[order[mine] - len(level)] = first[group[mine]], count[group[mine]]
    return begin, n


class SuffixLevel:
    """A suffix array: anchors in the order of their keys."""

    def __init__(self, anchors: Anchors, keys: np.ndarray | None = None):
        self.anchors = anchors
        self.keys = anchors.keys() if keys is None else keys

    def __len__(self) -> int:
        return len(self.anchors)

    def grams(self, gram: int) -> np.ndarray:
        return _strings(self.keys[:, :gram])

    def merged(self, other: SuffixLevel) -> SuffixLevel:
        order, _ = _merged(_strings(self.keys), _strings(other.keys))
        return SuffixLevel(Anchors.joined([self.anchors, other.anchors]).take(order), np.concatenate([self.keys, other.keys])[order])


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


class SuffixFamily:
    """The index: levels of geometrically growing size."""

    def __init__(self, length: int = LENGTH, levels: list[SuffixLevel] | None = None):
        self.length, self.gram, self.levels = length, length // 2, sorted(levels or [], key=len, reverse=True)

    def add(self, batch: Anchors) -> list[Runs]:
        """Index anchors in corpus order, all later than those before; runs (document, first window, windows) that
        the index or an earlier anchor of the batch has."""
        keys = batch.keys()
        order = np.argsort(_strings(keys), kind="stable")
        keys = keys[order]
        strings = _strings(keys)
        again = np.zeros(len(order), bool)
        again[1:] = strings[1:] == strings[:-1]
        for level in self.levels:
            again |= held_by(_strings(level.keys), strings)[1] > 0
        drop, fresh = order[again], order[~again]
        out = [(batch.doc[drop], batch.start[drop], batch.windows[drop])]
        level = SuffixLevel(batch.take(fresh), keys[~again])
        if len(level):
            out += self._partly(level, fresh)
            while self.levels and len(self.levels[-1]) <= 2 * len(level):
                level = self.levels.pop().merged(level)
            self.levels.append(level)
        return out

    def _partly(self, mine: SuffixLevel, rank: np.ndarray) -> list[Runs]:
        """Repeats of a part of a run. rank: places of the batch's anchors in corpus order."""
        grams = mine.grams(self.gram)
        starts = group_starts(grams)
        own = np.diff(np.append(starts, len(grams)))
        held = [held_by(level.grams(self.gram), grams) for level in self.levels]
        all_of = own + sum((n[starts] for _, n in held), np.zeros(len(starts), np.int64))
        crowded = np.repeat(all_of > MOST_PAIRED, own)
        pair, out = ~crowded, []
        for step in range(1, int(own[all_of <= MOST_PAIRED].max(initial=1))):
            i = np.flatnonzero((grams[step:] == grams[:-step]) & pair[step:])
            x, y = i + step, i
            later = rank[x] > rank[y]
            out += self._compared(mine, np.where(later, x, y), mine, np.where(later, y, x))
        for level, (begin, n) in zip(self.levels, held, strict=True):
            n = np.where(pair, n, 0)
            out += self._compared(mine, np.repeat(np.arange(len(grams)), n), level, spread(begin, n))
        where = np.flatnonzero(all_of > MOST_PAIRED)
        weights = np.add.reduceat(mine.anchors.windows, starts)[where] if len(where) else np.zeros(0, np.int64)
        i = 0
        while i < len(where):  # anchors with about BATCH windows at a time
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(weights[i:]), BATCH)))
            groups = where[i:j]
            members = spread(starts[groups], own[groups])
            members = members[np.argsort(rank[members])]
            theirs = [(level, spread(begin[starts[groups]], n[starts[groups]])) for level, (begin, n) in zip(self.levels, held, strict=True)]
            known = np.concatenate([np.zeros(0, f"S{self.length}"), *(level.anchors.window_keys(k) for level, k in theirs if len(k))])
            wanted = mine.anchors.window_keys(members)
            both = np.concatenate([known, wanted])
            at = np.argsort(both, kind="stable")
            first = np.zeros(len(both), bool)
            first[at[group_starts(both[at])]] = True
            seen = ~first[len(known) :]
            windows = mine.anchors.windows[members]
            places = spread(mine.anchors.start[members], windows)[seen]
            out.append((np.repeat(mine.anchors.doc[members], windows)[seen], places, np.ones(len(places), np.int64)))
            i = j
        return out

    def _compared(self, mine: SuffixLevel, x: np.ndarray, other: SuffixLevel, y: np.ndarray) -> list[Runs]:
        """Which windows of anchors x of a level their partners y of a level have too."""
        out, n = [], self.length
        for i in range(0, len(x), 1 << 15):
            a, b, k = mine.keys[x[i : i + (1 << 15)]], other.keys[y[i : i + (1 << 15)]], x[i : i + (1 << 15)]
            ahead, behind = (np.minimum(*(z[:, c].astype(np.int64) << 8 | z[:, c + 1] for z in (a, b))) for c in (-5, -3))
            right, far = common(a[:, :n], b[:, :n], ahead), common(a[:, n:-5], b[:, n:-5], behind)
            # a window d bytes before the anchor needs d bytes behind it and the rest ahead
            near = np.maximum(n - right, 0)
            hit = near <= far
            k, far, near = k[hit], far[hit], near[hit]
            out.append((mine.anchors.doc[k], mine.anchors.start[k] + mine.anchors.back[k] - far, far - near + 1))
        return out

    def extend(self, anchors: Anchors) -> Runs:
        """`add` for anchors in corpus order, in batches."""
        out = [(np.zeros(0, np.int64),) * 3]
        for i in range(0, len(anchors), BATCH_ANCHORS):
            out += self.add(anchors.take(np.arange(i, min(i + BATCH_ANCHORS, len(anchors)))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Instances:
    """Anchors of texts: for each, its hash, its place, the run of windows first..last, and its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        gram = length // 2
        width = length - gram + 1
        found = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(4))]
        for i, _, part, at in chunks(data, offsets):
            if len(part) < length:
                continue
            n = len(part) - gram + 1
            where = np.arange(n)
            h = mix(rolling(byte_values(part), where, where + gram))
            key = (h >> _PLACE_BITS << _PLACE_BITS) | where.astype(np.uint64)
            full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
            full[:n] = key
            grid = full.reshape(-1, width)
            ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            windows = np.maximum(np.diff(at) - length + 1, 0)
            first = spread(at[:-1], windows)
            anchor = (np.minimum(behind[first], ahead[first + width - 1]) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
            starts = group_starts(anchor)
            ends = np.append(starts[1:], len(anchor)) - 1
            for to, x in zip(found, (mix(~h[anchor[starts]]), anchor[starts] + offsets[i], first[starts] + offsets[i], first[ends] + offsets[i], np.searchsorted(at, first[starts], "right") - 1 + i), strict=True):
                to.append(x)
        # anchors are least hashes: mixed again, theirs are spread evenly
        self.hash, self.at, self.first, self.last, self.text = (np.concatenate(x) for x in found)


#: The share that no document is in: blobs of it are pairs of an anchor's hash and its number of instances.
_HOT = -1


def repeated_anchors(docs: DataFrame, length: int, n_buckets: int, n_shares: int) -> DataFrame:
    """Verdicts on which of a document's instances have an anchor hash that occurs again; and, of share
    _HOT, hashes and their numbers of instances, where over LEAST_HOT."""

    def one(table):
        doc_ids = table.column("doc_id").to_numpy()
        found = Instances(*flat(table.column("text")), length)
        if not len(found.hash):
            return
        firsts = np.searchsorted(found.text, np.arange(len(doc_ids)))
        order = np.argsort(found.hash, kind="stable")
        h = found.hash[order]
        starts = group_starts(h)
        times = np.diff(np.append(starts, len(h)))
        many = np.repeat(times > 1, times)
        if many.any():
            k = order[many]
            yield exchange.verdict_batch(doc_ids[found.text[k]], k - firsts[found.text[k]], n_shares, int(doc_ids[0]) % n_buckets)
        first = order[starts]
        h = h[starts]
        bounds = bucket_bounds(h, n_buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            s = slice(bounds[b], bounds[b + 1])
            used, k = np.unique(found.text[first[s]], return_inverse=True)
            yield exchange.message(b, pack(np.diff(h[s], prepend=np.uint64(0)), k.astype(np.uint32), (first[s] - firsts[found.text[first[s]]]).astype(np.uint32), times[s].astype(np.uint32), doc_ids[used]))

    def find(batches):
        base.release()
        for table in blocks(batches):
            yield from one(table)

    def judged(blobs: list[bytes]) -> list[pa.RecordBatch]:
        parts = []
        for blob in blobs:
            h, k, place, times, ids = unpack(blob)
            parts.append((np.cumsum(h, dtype=np.uint64), ids[k], place, times))
        h, doc, place, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = group_starts(h)
        each = np.diff(np.append(starts, len(h)))
        total = np.add.reduceat(times[order].astype(np.int64), starts)
        again = order[np.repeat(each > 1, each)]
        out = [exchange.verdict_batch(doc[again], place[again], n_shares)]
        if (hot := total >= LEAST_HOT).any():
            blob = np.stack([h[starts][hot].view(np.int64), total[hot]], axis=1).tobytes()
            out.append(pa.RecordBatch.from_arrays([pa.array([_HOT], pa.int32()), pa.array([blob], pa.binary())], names=["share", "blob"]))
        return out

    def judge(table: pa.Table) -> pa.Table:
        own, blobs = exchange.divided(table)
        out = pa.concat_tables([own, *(pa.Table.from_batches([x]).cast(own.schema) for x in (judged(blobs) if blobs else []))])
        del blobs
        trim()
        return out

    return docs.mapInArrow(find, exchange.MESSAGES).groupBy("bucket").applyInArrow(judge, exchange.VERDICTS)


def hot_anchors(repeated: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors that are dealt by window: the HOT_ANCHORS most common ones at most."""

    def spelt(batches):
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column("blob").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["h", "total"])

    said = repeated.where(F.col("share") == _HOT).select("blob").mapInArrow(spelt, "h bigint, total bigint")
    rows = said.orderBy(F.desc("total"), "h").limit(HOT_ANCHORS).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _by_window(found: Anchors) -> Anchors:
    """Each window on its own, its start as anchor and its own hash as hash."""
    start = spread(found.start, found.windows)
    at = spread(found.at, found.windows)
    values = byte_values(found.text)
    h = mix(rolling(values, at, at + found.length))
    one = np.ones(len(start), np.int64)
    return Anchors(h, np.repeat(found.doc, found.windows), start, one, one * 0, found.text[spread(at, one * found.length)], found.length)


def _dealt(anchors: Anchors, hot: np.ndarray) -> Anchors:
    """anchors with the hot ones' windows one by one."""
    is_hot = np.isin(anchors.h, hot)
    if not is_hot.any():
        return anchors
    return Anchors.joined([anchors.take(np.flatnonzero(~is_hot)), _by_window(anchors.take(np.flatnonzero(is_hot)))])


def _messages(anchors: Anchors, n_buckets: int):
    order = np.argsort(anchors.h, kind="stable")
    bounds = bucket_bounds(anchors.h[order], n_buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield exchange.message(b, anchors.take(order[bounds[b] : bounds[b + 1]]).packed())


def _extract(length: int, hot: np.ndarray, n_buckets: int, n_shares: int, all_of_them: bool):
    """For mapInArrow: a block's instances (those that blob names, or all), dealt to buckets; what the block repeats itself is settled."""

    def one(table):
        data, offsets = flat(table.column("text"))
        found = Instances(data, offsets, length)
        if all_of_them:
            k = np.arange(len(found.hash))
        else:
            firsts = np.searchsorted(found.text, np.arange(len(offsets)))
            k = np.concatenate([np.zeros(0, np.int64), *(exchange.marked(b) + firsts[i] for i, b in enumerate(table.column("blob").to_pylist()))])
            k = k[k < len(found.hash)]
        doc_ids = table.column("doc_id").to_numpy()
        first, windows = found.first[k], found.last[k] - found.first[k] + 1
        mine = Anchors(found.hash[k], doc_ids[found.text[k]], first - offsets[found.text[k]], windows, found.at[k] - first, data[spread(first, windows + length - 1)], length)
        del found
        family = SuffixFamily(length)
        doc, start, runs = family.extend(_dealt(mine, hot).in_order())
        if len(doc):
            yield exchange.verdict_batch(doc, np.stack([start, runs], axis=1), n_shares, int(doc[0]) % n_buckets)
        for level in family.levels:
            yield from _messages(level.anchors, n_buckets)

    def run(batches):
        base.release()
        for table in blocks(batches, 6 << 20):
            yield from one(table)

    return run


def _unpacked(blobs: list[bytes], length: int) -> Anchors:
    return Anchors.joined([Anchors.unpacked(x, length) for x in blobs])


def _sizes(docs: DataFrame) -> tuple[int, int]:
    size = base.text_bytes(docs)
    return max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // SHARE_BYTES))


def later_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and blob: runs (start, windows) of windows that also start earlier in the corpus. docs: a row an id."""
    n_buckets, n_shares = _sizes(docs)
    repeated = written(repeated_anchors(docs, length, n_buckets, n_shares))
    hot = hot_anchors(repeated)
    marked = exchange.by_document(repeated.where(F.col("share") != _HOT))

    def search(table: pa.Table) -> pa.Table:
        own, blobs = exchange.divided(table)
        if blobs:
            doc, start, runs = SuffixFamily(length).extend(_unpacked(blobs, length).in_order())
            batch = exchange.verdict_batch(doc, np.stack([start, runs], axis=1), n_shares)
            own = pa.concat_tables([own, pa.Table.from_batches([batch]).cast(own.schema)])
        del blobs
        trim()
        return own

    found = docs.join(marked, "doc_id").select("doc_id", "text", "blob").mapInArrow(_extract(length, hot, n_buckets, n_shares, False), exchange.MESSAGES)
    return exchange.by_document(found.groupBy("bucket").applyInArrow(search, exchange.VERDICTS))


#: Rows of a kept index: a level of a bucket, or (level -1, bucket -1) the hot anchors' hashes; buckets: how many there are.
INDEX = "buckets int, bucket int, level int, blob binary"
_FOUND = "share int, bucket int, level int, blob binary"


def extended(docs: DataFrame, index: DataFrame | None = None, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """A batch of documents met with a kept index (INDEX; None: an empty one): later_windows of the batch, where all
    of the index counts as earlier, and the index with the batch in it. Both are written tables.

    Ids must be distinct, within the batch and from those of the index (see `keyed`). The number of buckets is the first batch's. Anchors once dealt by window stay so, and what the
    index holds of an anchor that becomes hot in this batch is dealt anew. An index holds every
    anchor, so a batch costs an exchange of about five times its text."""
    n_buckets, n_shares = _sizes(docs)
    hot = hot_anchors(written(repeated_anchors(docs, length, n_buckets, n_shares)))
    held = None
    if index is not None:
        index = written(index)
        n_buckets, said = index.select("buckets").first()[0], index.where("level = -1").select("blob").collect()  # a row
        known = np.frombuffer(said[0][0], np.uint64) if said else np.zeros(0, np.uint64)
        new, hot = np.setdiff1d(hot, known), np.union1d(hot, known)

        def anew(batches):
            for batch in batches:
                for bucket, level, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "level", "blob")), strict=True):
                    mine = Anchors.unpacked(blob, length)
                    is_new = np.isin(mine.h, new)
                    kept = [(bucket, level, mine.take(np.flatnonzero(~is_new)).packed())] if not is_new.all() else []
                    moved = [(m.column("bucket")[0].as_py(), None, m.column("blob")[0].as_py()) for m in (_messages(_by_window(mine.take(np.flatnonzero(is_new))), n_buckets) if is_new.any() else [])]
                    rows = kept + moved
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "level", "blob"])

        # levels keep their number, what was dealt anew has none
        held = index.where("level >= 0").select("bucket", "level", "blob").mapInArrow(anew, "bucket int, level int, blob binary").select("bucket", F.lit(None).cast("int").alias("share"), "blob", F.coalesce("level", F.lit(-2)).alias("level"))

    def search(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        level = table.column("level")
        own, blobs = exchange.divided(table.filter(level.is_null()))
        old = [(n, Anchors.unpacked(x, length)) for n, x in zip(level.to_pylist(), table.column("blob").to_pylist(), strict=True) if n is not None]
        family = SuffixFamily(length, [SuffixLevel(a) for n, a in old if n >= 0])
        moved = [a for n, a in old if n < 0]
        if moved:  # it was in the index before, so what it repeats of it is known
            family.extend(Anchors.joined(moved).in_order())
        rows = [(s, bucket, None, b) for s, b in zip(own.column("share").to_pylist(), own.column("blob").to_pylist(), strict=True)]
        if blobs:
            doc, start, runs = family.extend(_unpacked(blobs, length).in_order())
            batch = exchange.verdict_batch(doc, np.stack([start, runs], axis=1), n_shares)
            rows += [(s, bucket, None, b) for s, b in zip(batch.column("share").to_pylist(), batch.column("blob").to_pylist(), strict=True)]
        rows += [(None, bucket, n, x.anchors.packed()) for n, x in enumerate(family.levels)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        out = pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["share", "bucket", "level", "blob"])
        trim()
        return out

    new_rows = docs.mapInArrow(_extract(length, hot, n_buckets, n_shares, True), exchange.MESSAGES).withColumn("level", F.lit(None).cast("int"))
    rows = new_rows if held is None else new_rows.unionByName(held)
    found = written(rows.groupBy("bucket").applyInArrow(search, _FOUND))
    levels = found.where("share is null").select(F.lit(n_buckets).cast("int").alias("buckets"), "bucket", "level", "blob")
    spark = docs.sparkSession
    levels = levels.unionByName(spark.createDataFrame([(n_buckets, -1, -1, bytearray(hot.tobytes()))], INDEX))
    return written(exchange.by_document(found.where("share is not null").select("share", "blob"))), written(levels)


def kept_bytes(n: int, blob: bytes | None, length: int) -> np.ndarray:
    """Mask of the bytes that no run of removed windows covers."""
    edge = np.zeros(n + 1, np.int64)
    start, windows = np.frombuffer(blob or b"", np.uint32).reshape(-1, 2).astype(np.int64).T
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(start + windows - 1 + length, n), -1)
    return np.cumsum(edge[:-1]) == 0


def deduplicated(docs: DataFrame, length: int = LENGTH, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and, with `digests`, kept_sha256, else
    spans (start and end byte of each) and kept (the remaining bytes).

    Texts are UTF-8 bytes, null texts are empty; texts shorter than `length` lose nothing, and a text of
    any length is one document. Different texts of one doc_id stand one after another in the order of their
    digests, each with its own cuts; equal texts of one doc_id are one document, and each such row has its
    result. An empty table gives no rows; other columns may have any name."""
    own = keyed(base.documents(docs), "key")
    found = later_windows(own.texts, length)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digests else "spans array<array<bigint>>, kept binary")

    def cut(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            rows = []
            for i, blob in enumerate(batch.column("blob").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                keep = kept_bytes(len(text), blob, length) if blob else None
                kept = text if keep is None else text[keep]
                edges = np.zeros((0, 2), np.int64) if keep is None else np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8))).reshape(-1, 2)
                rows.append((len(text), len(text) - len(kept), len(edges), *([hashlib.sha256(np.ascontiguousarray(kept)).hexdigest()] if digests else [edges.tolist(), kept.tobytes()])))
            names = ["n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digests else ["spans", "kept"])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), *([pa.string()] if digests else [pa.list_(pa.list_(pa.int64())), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", *names])

    return own.rows.join(found.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "blob").mapInArrow(cut, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100-byte strings of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), LENGTH, digests=True)
