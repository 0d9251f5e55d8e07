"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is its set of word n-grams. Documents with equal sets are one class and stand in the join
once. Shingles that only one class has are first in the global order (rarest first), so they fill
prefixes and never travel beyond the first exchange; what is left of a set is its shared shingles,
with their document frequencies, which is all an exact overlap needs.

If two sets of sizes n reach the threshold, they share at least T = ceil(threshold * n) shingles
for either n, so for every l their (n - T + l)-prefixes share at least l. With l = 1, prefixes
give each document's possible partners and split the corpus into groups that no link leaves.
Groups are joined on their own, large ones in pairs of blocks; there each document lengthens its
prefix to the l with the least estimated cost (postings read, plus verification of the documents
that can hold l of them), and only documents that share l prefix shingles are verified.

Hashes have 64 bits, those of whole sets 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import base, exchange
from lumenfold.llm.base import blocks, bucket_bounds, chunks, flat, group_starts, mix, pack, ragged, rolling, spread, trim, unpack, word_hashes, word_spans, written
from lumenfold.llm.components import components, roots

#: Words of a shingle, and the similarity as a fraction, unless a caller says otherwise.
WORDS, SIMILAR = 5, (80, 100)
#: Longest extension of a prefix.
MOST_MATCHES = 8
#: Documents of a block of a large group.
BLOCK = 512
#: Text bytes whose shingles a bucket holds, and whose documents a share, on average.
BUCKET_BYTES, SHARE_BYTES = 4 << 20, 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A shared shingle of a document and how many classes have it.
ENTRY = np.dtype([("hash", "<u8"), ("df", "<u4")])


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the lower-cased texts, repeats included, and how many each text has."""
    out, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, part, at in chunks(data, offsets):
        part = _LOWER[part]
        starts, ends, first = word_spans(part, at)
        n = np.diff(first)
        short = (n > 0) & (n < words)
        grams = np.where(short, 1, np.maximum(n - words + 1, 0))
        size = np.repeat(np.where(short, n, words), grams)
        where = spread(first[:-1], grams)
        out.append(mix(rolling(word_hashes(part, starts, ends), where, where + size) + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
        counts.append(grams)
    return np.concatenate(out), np.concatenate(counts)


#: A document: its set's size and 128-bit fingerprint, and for the first of each class ENTRYs of the shingles that other classes have too.
FOUND = "doc_id bigint, n bigint, print binary, blob binary"
#: Numbers of 32 bits in a set's size and fingerprint, and in an ENTRY.
_SET, _ENTRY = 5, 3


def _words(*columns: np.ndarray) -> np.ndarray:
    """64-bit numbers as two of 32 bits each, low half first, and others as they are: a row an item."""
    parts = []
    for c in columns:
        parts += [c & np.uint64(0xFFFFFFFF), c >> np.uint64(32)] if c.dtype == np.uint64 else [c]
    return np.stack([x.astype(np.uint32) for x in parts], axis=1)


def shared_shingles(docs: DataFrame, words: int) -> DataFrame:
    """FOUND of every document. Sizes, fingerprints and shared shingles come back to a document's share packed (see exchange.py)."""
    size = base.text_bytes(docs)
    n_buckets, n_shares = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // SHARE_BYTES))

    def one(table):
        doc_ids = table.column("doc_id").to_numpy()
        h, counts = shingles(*flat(table.column("text")), words)
        of = np.repeat(np.arange(len(doc_ids), dtype=np.int32), counts)
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], of[order]
        first = np.ones(len(hs), bool)
        first[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        mask = np.zeros(len(h), bool)
        mask[order[first]] = True
        del order
        n = np.bincount(of[mask], minlength=len(doc_ids))
        edge = np.concatenate([[0], np.cumsum(n)])
        h = h[mask]
        prints = []
        for salt in (0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
            prints.append(total[edge[1:]] - total[edge[:-1]])
        del h, of, mask, total
        prints = np.ascontiguousarray(np.stack(prints, axis=1))
        yield exchange.verdict_batch(doc_ids, _words(n, prints[:, 0], prints[:, 1]), n_shares, int(doc_ids[0]) % n_buckets)
        # of equal sets in the block, the smallest id speaks
        by = np.lexsort((doc_ids, prints[:, 1], prints[:, 0]))
        lead = np.zeros(len(doc_ids), bool)
        lead[by] = np.concatenate([[True], (prints[by[1:]] != prints[by[:-1]]).any(axis=1)])[: len(by)]
        keep = first & lead[ds]
        hs, ds = hs[keep], ds[keep]
        bounds = bucket_bounds(hs, n_buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            used, k = np.unique(ds[bounds[b] : bounds[b + 1]], return_inverse=True)
            yield exchange.message(b, pack(np.diff(hs[bounds[b] : bounds[b + 1]], prepend=np.uint64(0)), k.astype(np.uint32), doc_ids[used], prints[used, 0]))

    def find(batches):
        base.release()
        for table in blocks(batches):
            yield from one(table)

    def judged(blobs: list[bytes]) -> pa.RecordBatch:
        parts = []
        for blob in blobs:
            h, k, ids, prints = unpack(blob)
            parts.append((np.cumsum(h, dtype=np.uint64), ids[k], prints[k]))
        h, doc, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(h, kind="stable")
        h, doc, prints = h[order], doc[order], prints[order]
        del order
        starts = group_starts(h)
        each = np.diff(np.append(starts, len(h)))
        again = np.repeat(each > 1, each)
        h, doc, prints = h[again], doc[again], prints[again]
        # one entry a class: its first document is the same in all buckets, as every block that has the class is here
        order = np.lexsort((doc, prints, h))
        h, doc, prints = h[order], doc[order], prints[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (prints[1:] != prints[:-1])
        h, doc = h[new], doc[new]
        starts = group_starts(h)
        df = np.diff(np.append(starts, len(h)))
        shared = np.repeat(df > 1, df)
        return exchange.verdict_batch(doc[shared], _words(h[shared], np.repeat(df, df)[shared]), n_shares)

    def judge(table: pa.Table) -> pa.Table:
        own, blobs = exchange.divided(table)
        out = pa.concat_tables([own, pa.Table.from_batches([judged(blobs)]).cast(own.schema)]) if blobs else own
        del blobs
        trim()
        return out

    def together(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        doc, sets = exchange.put_together([x for x in parts if len(x) == 2 + _SET])
        sets = np.frombuffer(b"".join(sets.to_pylist()), np.uint32).reshape(-1, _SET)
        entries, at = pa.nulls(len(doc), pa.binary()), [x for x in parts if len(x) == 2 + _ENTRY]
        if at:
            some, blobs = exchange.put_together(at)
            place = np.searchsorted(some, doc)
            has = some[np.minimum(place, len(some) - 1)] == doc
            entries = blobs.take(pa.array(place, mask=~has))
        out = pa.table([pa.array(doc, pa.int64()), pa.array(sets[:, 0], pa.int64()), ragged(np.ascontiguousarray(sets[:, 1:]).reshape(-1), np.full(len(doc), _SET - 1)), entries], names=["doc_id", "n", "print", "blob"])
        trim()
        return out

    verdicts = docs.mapInArrow(find, exchange.MESSAGES).groupBy("bucket").applyInArrow(judge, exchange.VERDICTS)
    return verdicts.groupBy("share").applyInArrow(together, FOUND)


def least_overlap(n: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    return -(-n * similar[0] // similar[1])


def size_class(n: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Classes of sizes: sets whose classes are more than one apart can't link."""
    width = max(np.log(similar[1] / similar[0]) * 1.0001, 1e-9) if similar[0] else np.inf
    return np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int64)


CANDIDATES = "doc_id bigint, n bigint, cls bigint, prefix int, blob binary"


def _candidates(similar):
    """Documents whose 1-prefix holds a shared shingle; entries in the global order, prefix: how many of them are in it."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, blob in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "blob")), strict=True):
                if not n or not blob:
                    continue
                entries = np.frombuffer(blob, ENTRY)
                prefix = n - int(least_overlap(np.int64(n), similar)) + 1 - (n - len(entries))
                if prefix > 0:
                    entries = entries[np.lexsort((entries["hash"], entries["df"]))]
                    out.append((doc, n, int(size_class(np.int64(n), similar)), min(prefix, len(entries)), entries.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n", "cls", "prefix", "blob"])

    return run


def _prefix_tokens(batches):
    for batch in batches:
        docs, tokens = batch.column("doc_id").to_numpy(), [np.zeros(0, np.int64)]
        for prefix, blob in zip(batch.column("prefix").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            tokens.append(np.frombuffer(blob, ENTRY, prefix)["hash"].view(np.int64) if prefix == len(blob) // ENTRY.itemsize else np.ascontiguousarray(np.frombuffer(blob, ENTRY, prefix)["hash"]).view(np.int64))
        sizes = batch.column("prefix").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(np.concatenate(tokens))), pa.array(np.repeat(docs, sizes)), pa.array(np.repeat(batch.column("cls").to_numpy(), sizes))], names=["token", "doc_id", "cls"])


def adaptive_join(n: np.ndarray, entries: list[np.ndarray], key: np.ndarray, side: np.ndarray, cross: np.ndarray, similar: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs (indices) of documents with the same key; where `cross`, only of different sides.

    n: sizes of whole sets; entries: each one's shared shingles in the global order."""
    m = len(n)
    sizes = np.fromiter(map(len, entries), np.int64, m)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(m), sizes)
    token = np.concatenate([e["hash"] for e in entries]) if m else np.zeros(0, np.uint64)
    _, token = np.unique(mix(token ^ mix(key.astype(np.uint64))[of]), return_inverse=True)
    need = least_overlap(n, similar)
    level = np.maximum(1, np.repeat(need - sizes, sizes) + spread(np.zeros(m, np.int64), sizes) + 1)
    indexed = np.flatnonzero(level <= MOST_MATCHES)
    order = indexed[np.lexsort((level[indexed], token[indexed]))]
    width = MOST_MATCHES + 1
    code, post = token[order] * width + level[order], of[order]
    begin = np.searchsorted(code, token * width)
    # cost of each l: postings read, and verification of as many documents as those postings can make
    cost = np.full((MOST_MATCHES + 1, m), np.inf)
    mean = float(sizes.mean()) if m else 0.0
    for l in range(1, MOST_MATCHES + 1):
        reads = np.where(level <= l, np.searchsorted(code, token * width + l, "right") - begin, 0)
        scan = np.bincount(of, reads, m)
        cost[l] = np.where(l <= np.maximum(need, 1), scan + scan / l * mean, np.inf)
    matches = cost.argmin(axis=0)
    pairs_x, pairs_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    marked = np.zeros(int(token.max(initial=-1)) + 1, bool)
    for x in range(m):
        l = int(matches[x])
        span = slice(first[x], first[x] + sizes[x])
        mine = token[span]
        prefix = level[span] <= l
        start = begin[span][prefix]
        stop = np.searchsorted(code, mine[prefix] * width + l, "right")
        met = post[spread(start, stop - start)]
        met = met[met < x]
        if len(met) < l:
            continue
        met = np.flatnonzero(np.bincount(met, minlength=x) >= l)
        met = met[(np.minimum(n[met], n[x]) * similar[1] >= np.maximum(n[met], n[x]) * similar[0])]
        if cross[x]:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        marked[mine] = True
        shared = np.add.reduceat(marked[token[spread(first[met], sizes[met])]].astype(np.int64), np.cumsum(sizes[met]) - sizes[met])
        marked[mine] = False
        met = met[shared * similar[1] >= (n[met] + n[x] - shared) * similar[0]]
        pairs_x.append(np.full(len(met), x))
        pairs_y.append(met)
    return np.concatenate(pairs_x), np.concatenate(pairs_y)


#: Rows of a bucket, on average.
ROWS = 1000

LINKS = "doc_id bigint, links bigint, root bigint"


def _joined(similar):
    def run(table: pa.Table) -> pa.Table:
        doc, n, times, key, side = (table.column(k).to_numpy() for k in ("doc_id", "n", "times", "key", "side"))
        cross = table.column("is_cross").to_numpy(zero_copy_only=False).astype(bool)
        entries = [np.frombuffer(b, ENTRY) for b in table.column("blob").to_pylist()]
        x, y = adaptive_join(n, entries, key, side, cross, similar)
        links = np.bincount(x, times[y], len(doc)) + np.bincount(y, times[x], len(doc))
        nodes, root = roots(doc[x], doc[y])
        # a document may be here under several keys
        total = np.zeros(len(nodes), np.int64)
        hit = links > 0
        np.add.at(total, np.searchsorted(nodes, doc[hit]), links[hit].astype(np.int64))
        trim()
        return pa.table([pa.array(a, pa.int64()) for a in (nodes, total, root)], names=["doc_id", "links", "root"])

    return run


def joined(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and n_links (documents linked
    directly, equal sets included), a row a document.

    Two sets link when similar[1] * intersection >= similar[0] * union. Fewer words than `words` make
    one shingle; null, empty and blank texts have none and link with nothing. Rows that repeat an id
    give one row; they are one document, of their different texts in order, one after another. Texts
    of any length are read whole, equal sets always link, an empty table gives no rows, and columns
    other than doc_id and text may have any name."""
    found = written(shared_shingles(base.one_per_id(base.documents(docs)), words))
    sets = found.select("doc_id", "n", "print")
    classes = sets.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"))
    candidates = written(found.where("blob is not null").select("doc_id", "n", "blob").mapInArrow(_candidates(similar), CANDIDATES))

    tokens = written(candidates.select("doc_id", "cls", "prefix", "blob").mapInArrow(_prefix_tokens, "token bigint, doc_id bigint, cls bigint"))
    heads = written(tokens.groupBy("token", "cls").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")))
    within = tokens.join(heads.where("b < top"), ["token", "cls"]).select(F.col("doc_id").alias("a"), "b")
    beside = heads.select("token", (F.col("cls") + 1).alias("cls"), F.col("b").alias("a")).join(heads.select("token", "cls", "b"), ["token", "cls"]).select("a", "b")
    groups = components(within.unionByName(beside)).withColumnRenamed("node", "doc_id")

    members = written(groups.join(candidates.select("doc_id", "n", "cls", "blob"), "doc_id").join(classes.select(F.col("rep").alias("doc_id"), "times"), "doc_id"))
    sizes = members.groupBy("component", "cls").agg(F.count("*").alias("size"))
    large = sizes.groupBy("component").agg(F.sum("size").alias("whole")).where(F.col("whole") > BLOCK).select("component", F.lit(True).alias("is_large"))
    sizes = written(sizes.join(large, "component").select("component", "cls", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    near = [sizes.select("component", (F.col("cls") + step).alias("cls"), F.col("blocks").alias(f"b{step}")) for step in (-1, 1)]
    copies = sizes.join(near[0], ["component", "cls"], "left").join(near[1], ["component", "cls"], "left")
    # a document of a large group goes to a bucket for each block that it meets
    copies = copies.agg(F.sum(F.col("size") * (F.col("blocks") + F.coalesce("b-1", F.lit(0)) + F.coalesce("b1", F.lit(0)))), F.sum("size")).first()
    sizes = sizes.drop("size")
    dealt = members.join(large, "component", "left").join(sizes, ["component", "cls"], "left")
    for step, to in ((1, "above"), (-1, "below")):
        dealt = dealt.join(sizes.select("component", (F.col("cls") - step).alias("cls"), F.col("blocks").alias(to)), ["component", "cls"], "left")
    dealt = dealt.withColumn("side", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("blocks")), F.lit(0)).cast("long"))
    with_others = lambda n, key, cross: f"CASE WHEN {n} > 0 THEN transform(sequence(0, {n} - 1), o -> struct(xxhash64(component, {key}) AS key, {cross} AS is_cross)) ELSE array() END"
    keys = F.expr(
        "CASE WHEN is_large THEN concat("
        + ", ".join([with_others("blocks", "cls, least(side, o), cls, greatest(side, o)", "side <> o"), with_others("above", "cls, side, cls + 1, cast(o AS bigint)", "true"), with_others("below", "cls - 1, cast(o AS bigint), cls, side", "true")])
        + ") ELSE array(struct(xxhash64(component) AS key, false AS is_cross)) END"
    )
    dealt = dealt.withColumn("k", F.explode(keys)).withColumn("side", F.xxhash64("cls", "side"))
    n_buckets = max(1, -(-(members.count() - (copies[1] or 0) + (copies[0] or 0)) // ROWS))
    linked = written(dealt.select("doc_id", "n", "times", "blob", "k.key", "side", "k.is_cross", F.pmod("k.key", F.lit(n_buckets)).alias("bucket")).groupBy("bucket").applyInArrow(_joined(similar), LINKS))

    links = linked.groupBy("doc_id").agg(F.sum("links").alias("links")).withColumnRenamed("doc_id", "rep")
    joint = components(linked.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(joint, "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return sets.where("n > 0").join(known, "print").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("n_links").cast("long")).unionByName(alone)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` by 4-word shingles at Jaccard 0.85: doc_id, n_shingles, component_id, n_links."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, (85, 100))
