"""Embedding near-dedup as an exact metric range join.

On unit vectors, cosine >= c means chord distance <= r = sqrt(2 - 2c), a metric. Pivots partition the
vectors of a label into cells by the nearest pivot. By the triangle inequality a partner of x can
only live in cell j if x is within r of the surface between its own pivot i and j, so x also visits
those cells; each cell then finds all partners of the vectors at home in it, on its own. Inside
a cell rows are ordered by distance to its pivot, and blocks whose distances differ by more
than r are skipped by the same inequality. Large cells are tiled, so that no task holds more than
two blocks. Equal vectors are joined once, with their number.

A label of n vectors has n / (2 * BLOCK) pivots, but no more than the root of n: cells are then no
larger than a tile for as long as finding a vector's cells costs less than searching them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.base import written
from lumenfold.llm.components import components

THRESHOLD = 0.98
#: Vectors of a tile's side, and half of those that are placed together.
BLOCK = 2048
#: Widens every bound on distances: rounding never loses a pair; the exact cosine decides.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    # by a power of two, which changes no bit of a cosine, so that squares neither vanish nor overflow
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a bipartite 0/1 matrix; -1 without a link."""
    row, column, n = np.full(adjacent.shape[0], -1), np.full(adjacent.shape[1], -1), 0
    for seed in np.flatnonzero(adjacent.any(axis=1)).tolist():
        if row[seed] >= 0:
            continue
        front = np.array([seed])
        while len(front):
            row[front] = n
            new = np.flatnonzero(adjacent[front].any(axis=0) & (column < 0))
            column[new] = n
            front = np.flatnonzero(adjacent[:, new].any(axis=1) & (row < 0)) if len(new) else new
        n += 1
    return row, column


FOUND = "rep bigint, links bigint, root bigint"


def _tile(threshold: float, radius: float):
    def run(table: pa.Table) -> pa.Table:
        """Homes of one block against everybody of another: links of each home, and who hangs together."""
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        rep, times, away = (table.column(k).to_numpy() for k in ("rep", "times", "away"))
        x = _matrix(table.column("embedding"))
        h, o = np.flatnonzero(home), np.flatnonzero(~home)
        out_rep, out_links, out_root = [], [], []
        h, o = h[np.argsort(away[h])], o[np.argsort(away[o])]
        norm = np.linalg.norm(x, axis=1)
        for i in range(0, len(h), 512):
            mine = h[i : i + 512]
            near = o[(away[o] >= away[mine[0]] - radius) & (away[o] <= away[mine[-1]] + radius)]
            if not len(near):
                continue
            close = (x[mine] @ x[near].T) / (norm[mine][:, None] * norm[near][None, :]) >= threshold
            close &= rep[mine][:, None] != rep[near][None, :]
            links = close @ times[near]
            row, column = _linked(close)
            nodes, group = np.concatenate([rep[mine], rep[near]]), np.concatenate([row, column])
            some = group >= 0
            root = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(root, group[some], nodes[some])
            out_rep.append(nodes[some])
            out_links.append(np.concatenate([links, np.zeros(len(near), np.int64)])[some])
            out_root.append(root[group[some]])
        empty = np.zeros(0, np.int64)
        return pa.table([pa.array(np.concatenate(a) if a else empty, pa.int64()) for a in (out_rep, out_links, out_root)], names=["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other vectors with an equal label and cosine >= threshold), component_id (the
    smallest id reachable by links) and kept (vec_id = component_id), a row a vector.

    Vectors that are null, empty, zero or hold a null or non-finite component, and those without a
    label, link with nothing; vectors of different lengths neither. Any finite magnitudes are
    compared alike. Rows without an id are left out; rows that repeat an id are vectors of their own
    that share its component. Equal vectors link whatever their number; an empty table gives no rows;
    columns other than the three named may have any name."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null")
    finite = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = rows.withColumn("sound", finite & F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull())
    sound = rows.where("sound").select("vec_id", "label", "embedding")
    classes = written(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")))

    # any choice of pivots gives the same links
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    wanted = F.least(F.ceil(F.col("n") / (2 * block)), F.ceil(F.sqrt(F.col("n").cast("double")))).alias("wanted")
    dealt = classes.withColumn("dim", F.size("embedding")).join(sizes.select("label", "dim", wanted, F.ceil(F.col("n") / (2 * block)).alias("salts")), ["label", "dim"])
    # min over a hash bucket picks one vector of it: a pre-aggregated draw without a sort
    pivots = dealt.groupBy("label", "dim", F.pmod(F.xxhash64("rep"), F.col("wanted")).alias("slot")).agg(F.min_by("embedding", F.xxhash64("rep", F.lit(1))).alias("embedding"), F.max("salts").alias("salts"))
    # each share of a label's vectors meets a copy of its pivots
    pivots = written(pivots).select("label", "dim", "slot", "embedding", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    dealt = dealt.select("label", "dim", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("salts")).alias("salt"), "rep", "times", "embedding")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    def place(rows: pa.Table, its: pa.Table) -> pa.Table:
        x, p = _unit(_matrix(rows.column("embedding"))), _unit(_matrix(its.sort_by("slot").column("embedding")))
        cosine = x @ p.T
        own = cosine.argmax(axis=1)
        at, cell, home = [], [], []
        for i in np.unique(own).tolist():
            mine = np.flatnonzero(own == i)
            # the plane midway between pivots i and j lies (cos_i - cos_j) / |p_i - p_j| away from x
            gap = np.linalg.norm(p - p[i], axis=1)
            k, j = np.nonzero(cosine[mine, i][:, None] - cosine[mine] <= radius * gap + SLACK)
            at.append(mine[k])
            cell.append(j)
            home.append(j == i)
        at, cell, home = (np.concatenate(v) for v in (at, cell, home))
        out = rows.select(["rep", "times", "label", "embedding"]).take(pa.array(at))
        away = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[at, cell]))
        for name, v in (("cell", pa.array(cell, pa.int32())), ("home", pa.array(home)), ("away", pa.array(away))):
            out = out.append_column(name, v)
        return out

    label_type = classes.schema["label"].dataType.simpleString()
    shares = ["label", "dim", "salt"]
    placed = dealt.groupBy(*shares).cogroup(pivots.groupBy(*shares)).applyInArrow(place, f"rep bigint, times bigint, label {label_type}, embedding array<double>, cell int, home boolean, away double")
    placed = written(placed)

    cell_sizes = placed.groupBy("label", F.size("embedding").alias("dim"), "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    tiles = placed.withColumn("dim", F.size("embedding")).join(cell_sizes, ["label", "dim", "cell"])
    nb_home, nb_all = (F.ceil(F.col(k) / block).cast("int") for k in ("homes", "all"))
    tiles = tiles.withColumn("nh", F.greatest(F.lit(1), nb_home)).withColumn("na", F.greatest(F.lit(1), nb_all)).withColumn("salt", F.xxhash64("rep"))
    columns = ["label", "dim", "cell", "rep", "times", "embedding", "away"]
    as_home = tiles.where("home").select(*columns, F.pmod("salt", "nh").alias("bh"), F.explode(F.expr("sequence(0, na - 1)")).alias("ba"), F.lit(True).alias("home"))
    as_other = tiles.select(*columns, F.explode(F.expr("sequence(0, nh - 1)")).alias("bh"), F.pmod("salt", "na").alias("ba"), F.lit(False).alias("home"))
    found = written(as_home.unionByName(as_other).groupBy("label", "dim", "cell", "bh", "ba").applyInArrow(_tile(threshold, radius), FOUND))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "embedding", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # a label's equal vectors: one row on the right, so a common vector only widens the left, which AQE splits
    linked = sound.join(known, ["label", "embedding"]).select("vec_id", (F.col("links") + F.col("times") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` by label at cosine 0.98: vec_id, n_links, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
