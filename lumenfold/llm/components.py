"""Connected components by alternating large and small stars.

Each round first joins what meets in one task (union-find within a partition keeps a spanning
forest of its edges), then re-hangs every node's neighbours on the smallest node it can see. The
number of rounds is logarithmic in the longest path; each round is a written table, so a lost
executor costs one round at most. Edges stay in DataFrames: nothing is gathered on the driver
but a count and a checksum a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.base import written

EDGES = "a bigint, b bigint"
#: Edges that a task joins in one go.
_TOGETHER = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node of each one's component among them."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        high, low = np.maximum(lu, lv), np.minimum(lu, lv)
        if not (open_ := high != low).any():
            return nodes, nodes[label]
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(up := label[label], label):
            label = up


def _contract(batches):
    held_a, held_b, size = [], [], 0

    def flush():
        nodes, root = roots(np.concatenate(held_a), np.concatenate(held_b))
        moved = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["a", "b"])

    for batch in batches:
        held_a.append(batch.column("a").to_numpy())
        held_b.append(batch.column("b").to_numpy())
        size += batch.num_rows
        if size >= _TOGETHER:
            yield flush()
            held_a, held_b, size = [], [], 0
    if size:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it is connected with) for each node of `edges` (a, b).

    Loops, repeated edges and edges with a null end say nothing; nodes that only loops name are left
    out. An empty table gives no rows."""
    forest = written(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_contract, EDGES))
    said = None
    while True:
        # files of several tasks are read together, so this joins more than the task that wrote could
        forest = forest.mapInArrow(_contract, EDGES)
        # large star: neighbours above u hang on the smallest that u sees
        both = forest.union(forest.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: a node and its neighbours below hang on the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(below.toDF("a", "b"))
        forest = written(small.mapInArrow(_contract, EDGES).distinct())
        state = forest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
        if state == said:
            break
        said = state
    tops = forest.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return forest.toDF("node", "component").union(tops)
