"""Centroid clustering (Lloyd's rounds) by filtering kd-trees.

Vectors are integers. Each block of a partition gets a kd-tree once; its nodes hold the number of
vectors below, their integer sums and their bounding box, and it is written with its vectors, so that every
round reads trees. A round sends the centroids down: the one nearest to the middle of a box strictly
dominates another if every corner of the box is strictly nearer to it, and what is dominated is
pruned. A node with one centroid left is assigned whole, by count and sums; leaves that keep several
are resolved exactly, ties to the smaller number. Tasks return a row a centroid, which Spark sums.

All arithmetic is on integers: in doubles as long as no intermediate value can reach 2**53, else in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import base
from lumenfold.llm.base import written

CENTROIDS, ROUNDS, SCALE, DIMENSIONS = 40, 5, 256, 64
SEED = "2:"
#: Vectors of a tree at most, and of a leaf: so many to twice as many.
BLOCK, LEAF = 8192, 32
#: Components beyond it could make a squared distance that no long holds.
LARGEST = 1 << 26

TREES = "vec_id binary, points binary, lo binary, hi binary, sums binary, first binary, size binary"


class Tree:
    """A complete binary tree over vectors in tree order: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.points, self.lo, self.hi, self.sums, self.first, self.size = ids, points, lo, hi, sums, first, size

    @classmethod
    def of(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Nodes are halved at the median of their box's widest side, level by level."""
        n = len(ids)
        order, first, size, at = np.arange(n), [0], [n], 0
        depth = max(0, int(np.log2(max(1, n / leaf))))
        for _ in range(depth):
            for node in range(at, len(first)):
                a, m = first[node], size[node]
                mine = order[a : a + m]
                its = points[mine]
                side = int((its.max(axis=0) - its.min(axis=0)).argmax())
                order[a : a + m] = mine[np.argpartition(its[:, side], m // 2)]
                first += [a, a + m // 2]
                size += [m // 2, m - m // 2]
            at = 2 * at + 1
        ids, points, first, size = ids[order], points[order], np.array(first), np.array(size)
        at = first[len(first) // 2 :]  # the last level tiles the points
        lo, hi, sums = (np.zeros((len(first), points.shape[1]), np.int64) for _ in range(3))
        for out, f in ((lo, np.minimum), (hi, np.maximum), (sums, np.add)):
            out[len(first) // 2 :] = f.reduceat(points, at)
            for node in range(len(first) // 2 - 1, -1, -1):
                out[node] = f(out[2 * node + 1], out[2 * node + 2])
        return cls(ids, points, lo, hi, sums, first, size)

    def packed(self) -> list[bytes]:
        return [base.pack(a.reshape(-1)) for a in (self.ids, _narrow(self.points), _narrow(self.lo), _narrow(self.hi), self.sums, self.first, self.size)]

    @classmethod
    def unpacked(cls, blobs: list[bytes], dimensions: int) -> Tree:
        ids, points, lo, hi, sums, first, size = (base.unpack(b)[0] for b in blobs)
        return cls(ids, *(a.astype(np.int64).reshape(-1, dimensions) for a in (points, lo, hi, sums)), first, size)

    def assigned(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """(node, centroid) for nodes assigned whole; then positions of the other points, their centroids and squared distances."""
        c = _exact(centroids, self.lo, self.hi)
        lo, hi, norms = self.lo.astype(c.dtype), self.hi.astype(c.dtype), (c * c).sum(axis=1)
        whole, open_, last = [], [], len(self.first) // 2
        nodes, alive = np.array([0]), np.ones((1, len(c)), bool)
        while len(nodes):
            middle, spread = lo[nodes] + hi[nodes], hi[nodes] - lo[nodes]
            # four times the squared distance to the middle, without the part all centroids share
            away = np.where(alive, norms * 4 - 4 * (middle @ c.T), np.inf if c.dtype == float else np.iinfo(np.int64).max)
            best = away.argmin(axis=1)
            for z in np.unique(best).tolist():
                mine, u = np.flatnonzero(best == z), c - c[z]
                # the corner that lies furthest towards each other centroid: still strictly nearer to z?
                margin = (norms - norms[z])[None, :] - (middle[mine] @ u.T + spread[mine] @ np.abs(u).T)
                alive[mine] &= margin <= 0
                alive[mine, z] = True
            alone = alive.sum(axis=1) == 1
            whole += zip(nodes[alone].tolist(), alive[alone].argmax(axis=1).tolist(), strict=True)
            down = ~alone & (nodes < last)
            stuck = ~alone & (nodes >= last)
            open_ += zip(nodes[stuck].tolist(), alive[stuck], strict=True)
            nodes, alive = np.concatenate([2 * nodes[down] + 1, 2 * nodes[down] + 2]), np.concatenate([alive[down], alive[down]])
        if not open_:
            return whole, *(np.zeros(0, np.int64) for _ in range(3))
        its = np.array([n for n, _ in open_])
        at = base.spread(self.first[its], self.size[its])
        choice = np.repeat(np.array([a for _, a in open_]), self.size[its], axis=0)
        x = self.points[at].astype(c.dtype)
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + norms
        cluster = np.where(choice, far, np.inf if c.dtype == float else np.iinfo(np.int64).max).argmin(axis=1)
        return whole, at, cluster, far[np.arange(len(at)), cluster].astype(np.int64)


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(np.abs(a).max(initial=0))
    return a.astype(np.int16 if most < 1 << 15 else np.int32)


def _exact(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Centroids as doubles if every sum of products below stays below 2**53, else as they are."""
    most = int(max(np.abs(a).max(initial=0) for a in (c, lo, hi)))
    return c.astype(float) if 16 * most * most * c.shape[1] < 1 << 53 else c


def trees(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """The written trees of vectors (vec_id, embedding): a row a block."""

    def build(batches):
        base.release()
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            x = pa.concat_arrays(table.column("embedding").chunks).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)
            x = np.floor(scale * x)
            fits = (np.abs(x) <= LARGEST).all(axis=1)
            if not fits.any():
                return
            blobs = Tree.of(table.column("vec_id").to_numpy()[fits], x[fits].astype(np.int64), leaf).packed()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["vec_id", "points", "lo", "hi", "sums", "first", "size"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == block:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return written(vectors.mapInArrow(build, TREES))


def _of(batch: pa.RecordBatch, dimensions: int):
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield Tree.unpacked(list(row), dimensions)


def stepped(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of means, empty ones as they were."""
    k, dimensions = centroids.shape

    def sums(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for tree in _of(batch, dimensions):
                whole, at, cluster, _ = tree.assigned(centroids)
                for node, z in whole:
                    count[z] += tree.size[node]
                    total[z] += tree.sums[node]
                for z in np.unique(cluster).tolist():
                    mine = at[cluster == z]
                    count[z] += len(mine)
                    total[z] += tree.points[mine].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["z", "n", "total"])

    found = forest.mapInArrow(sums, "z int, n bigint, total array<bigint>")
    # sums of longs over all rows may pass 64 bits
    found = found.groupBy("z").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(dimensions)))
    out = centroids.copy()
    for row in found.collect():  # a row a centroid
        out[row["z"]] = [int(row[f"t{i}"]) // row["n"] for i in range(dimensions)]
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = SEED, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector kept.

    Kept are vectors of exactly `dimensions` components, none null or non-finite; a component x is
    floor(scale * x). Vectors with a component beyond 2**26 then are left out, as no long could hold their
    distances, and so are rows without an id. Rows that repeat an id are vectors of their own, equal vectors as
    well; with fewer than k vectors each is a centroid. An empty table gives no rows; other columns may have any name."""
    base.bounded(vectors.sparkSession)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null")
    sound = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    kept = kept.where(sound & (F.size("embedding") == dimensions))
    small = F.forall("embedding", lambda v: F.floor(v * float(scale)).between(-LARGEST, LARGEST))
    # the first k by digest; equal ids by their components
    chosen = kept.where(small).select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("digest"), "embedding").orderBy("digest", "embedding").limit(k).collect()
    schema = f"{id_col} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not chosen:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = np.floor(scale * np.array([r["embedding"] for r in chosen], float)).astype(np.int64)
    forest = trees(kept, dimensions, scale, block, leaf)
    for _ in range(rounds):
        centroids = stepped(forest, centroids)

    def place(batches):
        for batch in batches:
            for tree in _of(batch, dimensions):
                whole, at, cluster, far = tree.assigned(centroids)
                ids, z, d = [tree.ids[at]], [cluster], [far]
                for node, c in whole:
                    mine = slice(tree.first[node], tree.first[node] + tree.size[node])
                    ids.append(tree.ids[mine])
                    z.append(np.full(tree.size[node], c))
                    d.append(((tree.points[mine] - centroids[c]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(t)) for v, t in ((ids, np.int64), (z, np.int32), (d, np.int64))], names=["vec_id", "cluster", "distance"])

    placed = written(forest.mapInArrow(place, "vec_id bigint, cluster int, distance bigint"))
    # k rows, a parameter
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["cluster"]: int(r["s"]) for r in each}
    names = F.array(*(F.sha2(F.lit(",".join(map(str, c.tolist()))).cast("binary"), 256) for c in centroids))
    inertia = F.array(*(F.lit(sums.get(z, 0)).cast("long") for z in range(len(centroids))))
    return placed.select(
        F.col("vec_id").alias(id_col), "cluster", "distance",
        F.element_at(inertia, F.col("cluster") + 1).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(names, F.col("cluster") + 1).alias("centroid_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids over `embeddings`, five rounds."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
