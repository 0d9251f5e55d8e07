"""An index of vectors by cells, for search by cosine.

A coarse quantiser (k-means on the sphere, fitted to a bounded sample) gives every vector a cell, and vectors are
stored by cell: a search reads the cells nearest to what it asks for, and partition pruning leaves
the others unread. Of each cell the index knows its centre and the least cosine of a member with it, so
no member of a cell can be nearer to a query than the angle between query and centre less the cell's
own. Searches either visit a number of cells (approximate), or all cells that this bound leaves (exact).

Vectors that are null, empty, zero, not finite or of another length than most have no direction; they stand
in a cell of their own, which only exact searches visit, as their cosine counts as 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators import windows
from lumenfold.sources import storage

#: Vectors that the quantiser is fitted to, about; a cell gets SAMPLE_A_CELL of them at least.
SAMPLE, SAMPLE_A_CELL = 65_536, 16
#: Vectors of a file: larger cells are written, and joined, in several parts.
PART_ROWS = 65_536
#: Tasks that a search of many queries deals cells to, at least, and vectors of one, about.
DEALS, DEAL_ROWS = 24, 16_384
#: The cell of vectors without a direction.
NOWHERE = -1


@dataclass
class Cells:
    spark: SparkSession
    path: str
    key: str = "vec_id"
    vector: str = "embedding"

    @cached_property
    def centres(self) -> pd.DataFrame:
        """cell, centre, n, parts, least: a row a cell, SAMPLE / SAMPLE_A_CELL at most."""
        return self.spark.read.parquet(f"{self.path}/centres").toPandas().sort_values("cell", ignore_index=True)

    @cached_property
    def _matrix(self) -> np.ndarray:
        found = self.centres["centre"].tolist()
        return np.array(found, float) if found else np.zeros((0, 0))

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def reach(self, target: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Places of cells, the nearest centre first, and the largest cosine that a member of each can have."""
        return _reach(self._matrix, self.centres["least"].to_numpy())(target)


def _reach(centres: np.ndarray, least: np.ndarray):
    """`Cells.reach` as a function of the target alone, which tasks can be given."""
    import numpy as np

    def reach(target):
        target = np.asarray(target, float)
        size = np.linalg.norm(target)
        if centres.shape[1] != len(target) or not size:
            return np.arange(len(centres)), np.zeros(len(centres))
        cosine = np.clip(centres @ target / size, -1, 1)
        apart = np.arccos(cosine) - np.arccos(np.clip(least, -1, 1))
        return np.argsort(-cosine, kind="stable"), np.cos(np.maximum(apart, 0)) + 1e-9

    return reach


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding", part_rows: int = PART_ROWS) -> Cells:
    """Write the index of `vectors` (with all their columns) to `path`. `cells`: the root of their number, unless given;
    never more than the sample supports."""
    spark = vectors.sparkSession
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    told = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    # the length is taken once a vector, not once a component
    unit = F.element_at(F.transform(F.array(F.sqrt(V.dot(x, x))), lambda n: F.transform(x, lambda v: v / n)), 1)
    rows = storage.kept(spark, vectors.withColumn("__told", told).withColumn("__unit", F.when(F.col("__told"), unit)))
    sizes = rows.where("__told").groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    dim, n = (most["dim"], most["n"]) if most else (0, 0)
    rows = rows.withColumn("__told", F.col("__told") & (F.size(vector) == dim))
    known = rows.where("__told").withColumn("__unit", array_to_vector("__unit"))
    wanted = max(1, min(cells or round(n**0.5), max(1, min(n, sample) // SAMPLE_A_CELL)))
    schema = "cell int, centre array<double>"
    if n:
        few = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(np.ceil(min(1.0, sample / n) * (1 << 20)))).select("__unit")
        model = KMeans(k=wanted, seed=7, maxIter=10, featuresCol="__unit", predictionCol="cell", distanceMeasure="cosine").fit(few)
        units = [c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()]
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(units)], schema)
        placed = model.transform(known)
    else:
        centres, placed = spark.createDataFrame([], schema), known.withColumn("cell", F.lit(NOWHERE))
    placed = placed.drop("__unit").unionByName(rows.where("not __told").drop("__unit").withColumn("cell", F.lit(NOWHERE))).drop("__told")
    placed = storage.kept(spark, placed)
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))  # a row a cell
    placed = placed.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    placed.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors").join(F.broadcast(centres), "cell")
    stats = stored.groupBy("cell").agg(F.count("*").alias("n"), (F.max("part") + 1).alias("parts"), F.min(V.cosine(x, F.col("centre"))).alias("least"))
    centres.join(stats, "cell").write.parquet(f"{path}/centres")
    return Cells(spark, path, key, vector)


def _scored(index: Cells, rows: DataFrame, target: list[float], k: int) -> DataFrame:
    score = V.cosine(F.col(index.vector), F.array(*[F.lit(float(v)) for v in target]))
    return rows.drop("cell", "part").withColumn("score", score).orderBy(F.desc(F.round("score", 9)), index.key).limit(k)


def nearest(index: Cells, target: list[float], k: int, visit: int | None = None, where: Column | None = None) -> DataFrame:
    """The k vectors of largest cosine among those of the `visit` nearest cells, or, without a number, among all.

    The exact search first looks into the nearest cells, as many as hold k, and then into those
    that may hold something better than the k-th found there."""
    order, bounds = index.reach(target)
    cells = index.centres["cell"].to_numpy()
    held = index.vectors if where is None else index.vectors.where(where)
    if visit is not None:
        return _scored(index, held.where(F.col("cell").isin([int(c) for c in cells[order[:visit]]])), target, k)
    first = order[: int(np.searchsorted(np.cumsum(index.centres["n"].to_numpy()[order]), k)) + 1]
    found = _scored(index, held.where(F.col("cell").isin([int(c) for c in cells[first]])), target, k).select("score").collect()  # k rows
    least = min(r["score"] for r in found) if len(found) == k else -2.0
    chosen = [int(c) for c in cells[bounds >= least - 1e-9]] + ([NOWHERE] if least <= 1e-9 else [])
    return _scored(index, held.where(F.col("cell").isin(chosen)), target, k)


def nearest_of_all(index: Cells, queries: DataFrame, k: int, visit: int | None = None, query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query, key, score, rank, cell for many queries at once: each meets the cells it visits, in their parts, and keeps its k best.

    With `visit`, the nearest so many cells. Without, exact: the two nearest cells bound each query's k-th
    score, then it visits the other cells whose bound reaches that."""
    spark = index.spark
    target = F.col(vector).cast("array<double>")
    asked = queries.select(F.col(query).alias("__query"), target.alias("__target"), V.whole(target).alias("__whole")).where("__target is not null")
    parts = dict(zip(index.centres["cell"].tolist(), index.centres["parts"].tolist(), strict=True))
    cells = index.centres["cell"].to_numpy()
    nowhere = index.vectors.where(F.col("cell") == NOWHERE).agg(F.coalesce(F.max("part") + 1, F.lit(0))).first()[0]
    reach = _reach(index._matrix, index.centres["least"].to_numpy())
    deals = max(DEALS, -(-int(index.centres["n"].sum()) // DEAL_ROWS))

    def chosen(first: int):
        """Of each query its first cells, or, with a bound on its k-th score, those others that reach it, by where they are dealt to."""

        def run(least: pd.Series, targets: pd.Series) -> pd.Series:
            out = []
            for bound, target in zip(least, targets, strict=True):
                order, bounds = reach(target)
                seen = order[:first].tolist()
                some = seen if bound != bound else [i for i in order.tolist() if bounds[i] >= bound - 1e-9 and i not in seen]
                found = [(int(cells[i]), p) for i in some for p in range(parts[int(cells[i])])] + [(-1, p) for p in range(nowhere if bound <= 1e-9 else 0)]
                dealt = {}
                for cell, p in found:
                    dealt.setdefault((cell * 31 + p) % deals, []).append({"cell": cell, "part": p})
                out.append([{"deal": d, "at": at} for d, at in dealt.items()])
            return pd.Series(out)

        return F.pandas_udf(run, "array<struct<deal:int,at:array<struct<cell:int,part:int>>>>")

    key, of, pick = index.key, index.vector, V.best_cosines(k)
    types = {f.name: f.dataType.simpleString() for f in index.vectors.schema} | {"__query": asked.schema["__query"].dataType.simpleString()}

    def meet(held: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query in the cells that were dealt here."""
        import numpy as np

        given = [t if w else None for t, w in zip(met["__target"], met["__whole"], strict=True)]
        who = {}
        for i, at in enumerate(met["__at"]):
            for x in at:
                who.setdefault((x["cell"], x["part"]), []).append(i)
        out = []
        for at, rows in held.groupby(["cell", "part"], sort=False):
            mine = np.array(who.get(at, []), int)
            if len(mine):
                vectors = [v if w else None for v, w in zip(rows[of], rows["__whole"], strict=True)]
                i, j, score = pick(met["__query"].to_numpy()[mine], [given[x] for x in mine], rows[key].to_numpy(), vectors)
                out.append(pd.DataFrame({"__query": met["__query"].to_numpy()[mine[i]], key: rows[key].to_numpy()[j], "cell": at[0], "score": score}))
        found = pd.concat(out) if out else pd.DataFrame({"__query": [], key: [], "cell": [], "score": []})
        found = found.assign(__order=np.where(found["score"].isna(), np.inf, found["score"].round(9))).sort_values(["__query", "__order", key], ascending=[True, False, True])
        return found.groupby("__query").head(k)[["__query", key, "cell", "score"]]

    def best(met: DataFrame) -> DataFrame:
        return windows.first_per(met, ["__query"], [F.desc(F.round("score", 9)), F.asc(key)], k)

    held = index.vectors.select("cell", "part", key, of, V.whole(F.col(of)).alias("__whole"), F.pmod(F.col("cell") * 31 + F.col("part"), F.lit(deals)).cast("int").alias("__deal"))
    held = held.repartition(deals, "__deal").groupBy("__deal")

    def scored(rows: DataFrame) -> DataFrame:
        to = rows.select("__query", "__target", "__whole", F.explode("__cells").alias("__to")).select("__query", "__target", "__whole", F.col("__to.at").alias("__at"), F.col("__to.deal").alias("__deal"))
        made = held.cogroup(to.repartition(deals, "__deal").groupBy("__deal")).applyInPandas(meet, f"__query {types['__query']}, {key} {types[key]}, cell int, score double")
        return best(made).drop("rank")

    none = F.lit(float("nan"))
    found = scored(asked.withColumn("__cells", chosen(visit or 2)(none, F.col("__target"))))
    if visit is None:
        found = storage.kept(spark, found)  # k rows a query
        kth = found.groupBy("__query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("__least"))
        more = asked.join(kth, "__query", "left").withColumn("__least", F.coalesce("__least", F.lit(-2.0)))
        found = found.unionByName(scored(more.withColumn("__cells", chosen(2)(F.col("__least"), F.col("__target")))))
    return best(found).select(F.col("__query").alias(query), key, "score", "rank", "cell")


def visits_for(index: Cells, queries: DataFrame, k: int, recall: float, query: str = "query_id", vector: str = "embedding") -> int:
    """The least number of cells to visit that finds a share `recall` of the k true neighbours of `queries`, a small
    sample whose results the driver holds: a true neighbour is found from the rank of its cell on."""
    asked = queries.select(F.col(query).alias("__asked"), F.col(vector).alias("__target"))
    true = nearest_of_all(index, asked, k, None, "__asked", "__target").where(F.col("cell") != NOWHERE)
    cells = index.centres["cell"].to_numpy()
    needed = []
    for row in true.join(asked, "__asked").select("__target", "cell").collect():
        order, _ = index.reach(row["__target"])
        needed.append(int(np.flatnonzero(cells[order] == row["cell"])[0]) + 1)
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if needed else 1


def read_bytes(index: Cells, cells: list[int]) -> int:
    """Bytes of the files that a search of these cells reads; their contents aren't read."""
    files = index.vectors.where(F.col("cell").isin(cells)).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
    return files.agg(F.sum("s")).first()[0] or 0
