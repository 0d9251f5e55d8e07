"""Search by cells against all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import vector_cells as C
from lumenfold.sources import storage


def cosine(a, b):
    if len(a) != len(b) or not np.any(a) or not np.any(b):
        return 0.0
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def best(rows, target, k):
    return sorted(((i, round(cosine(np.array(v or []), np.array(target)), 9)) for i, v in rows), key=lambda r: (-r[1], r[0]))[:k]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    out = [(i, (centres[i % 12] + rng.normal(scale=0.3, size=8)).tolist()) for i in range(600)]
    out += [(1000 + i, out[5][1]) for i in range(150)]  # a cell in several parts
    return out + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 3), (2004, [float("nan")] * 8)]


@pytest.fixture(scope="module")
def index(spark, rows):
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, kind int")
    return C.build(df, storage.scratch(spark), cells=15, part_rows=60)


def test_every_vector_has_a_cell(index, rows):
    got = index.vectors.groupBy("cell").agg(F.count("*").alias("n"), (F.max("part") + 1).alias("parts")).collect()
    assert sum(r["n"] for r in got) == len(rows) and len(got) == 16
    assert {r["cell"]: r["n"] for r in got if r["cell"] >= 0} == dict(zip(index.centres["cell"], index.centres["n"], strict=True))
    assert max(r["parts"] for r in got) > 2 and {r["vec_id"] for r in index.vectors.where("cell = -1").collect()} == {2000, 2001, 2002, 2003, 2004}


@pytest.mark.parametrize("k", [1, 10, 200])
def test_exact(index, rows, k):
    sound = [r for r in rows if r[0] != 2004]  # the cosine of a nan is nothing that can be compared
    for target in (rows[0][1], rows[7][1], [0.1] * 8):
        got = [(r["vec_id"], round(r["score"], 9)) for r in C.nearest(index, target, k, where=F.col("vec_id") != 2004).collect()]
        assert sorted(got, key=lambda r: (-r[1], r[0])) == best(sound, target, k)
    some = [r for r in sound if r[0] % 3 == 1]
    got = [r["vec_id"] for r in C.nearest(index, rows[0][1], k, where=(F.col("kind") == 1) & (F.col("vec_id") != 2004)).collect()]
    assert sorted(got) == sorted(i for i, _ in best(some, rows[0][1], k))


def test_exact_in_batches(spark, index, rows):
    asked = [r for r in rows if r[0] % 20 == 0 and r[1] and len(r[1]) == 8 and np.any(r[1])]
    got = {}
    for r in C.nearest_of_all(index, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for i, v in asked:
        assert [got[i][n] for n in range(1, 11)] == [j for j, _ in best([r for r in rows if r[0] != 2004], v, 10)], i


def test_all_cells_are_exact_and_fewer_read_less(index, rows):
    target, cells = rows[3][1], [int(c) for c in index.centres["cell"]]
    assert [r["vec_id"] for r in C.nearest(index, target, 10, visit=len(cells)).collect()] == [i for i, _ in best(rows[:750], target, 10)]
    order, _ = index.reach(target)
    read = [C.read_bytes(index, [cells[i] for i in order[:n]]) for n in (1, 4, len(cells))]
    assert read[0] < read[1] < read[2] and read[0] < read[2] / 5
    plan = C.nearest(index, target, 10, visit=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_recall(spark, index, rows):
    sound = [r for r in rows[:750]]
    asked = spark.createDataFrame([r for r in sound if r[0] % 20 == 0], "query_id long, embedding array<double>")
    visit = C.visits_for(index, spark.createDataFrame([r for r in sound if r[0] % 50 == 7], "query_id long, embedding array<double>"), 10, 0.95)
    assert visit < 8
    hits = n = 0
    got = {}
    for r in C.nearest_of_all(index, asked, 10, visit).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for i, v in sound:
        if i % 20 == 0:
            want = {j for j, _ in best(sound, v, 10)}
            hits, n = hits + len(want & got[i]), n + len(want)
    assert hits / n >= 0.9


def test_recall_on_the_given_vectors(spark):
    """Vectors without clusters: more cells are visited, recall stays."""
    from lumenfold import registry

    queries, sf_dir = registry.queries(), "/root/testdata/sf0.001"
    true = {(r["query_id"], r["vec_id"]) for r in queries["vector_cells_batch"](spark, sf_dir).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in queries["vector_cells_approximate"](spark, sf_dir).collect()}
    assert len(true & found) / len(true) >= 0.9


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    index = C.build(df, storage.scratch(spark))
    assert C.nearest(index, [1.0, 0.0], 5, visit=3).collect() == []
    assert [r["vec_id"] for r in C.nearest(index, [1.0, 0.0], 5).collect()] == [1]


def test_a_stored_table_is_used_until_its_files_change(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    spark.range(5).write.parquet(path)

    def build(to):
        built.append(to)
        spark.read.parquet(path).write.parquet(to)

    def get(*options):
        return spark.read.parquet(storage.reused("test", [spark.read.parquet(path)], options, build)).count()

    assert [get(), get(), get("other"), get()] == [5, 5, 5, 5] and len(built) == 2
    spark.range(3).write.mode("append").parquet(path)
    assert get() == 8 and len(built) == 3
    storage.forget(spark, "test")
    assert get() == 8 and len(built) == 4
