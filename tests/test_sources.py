"""Stores that change, embeddings of a service, options, caches."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import compression, review, scans, windows
from lumenfold.plans import query as Q
from lumenfold.sources import collections, embeddings


def test_collection(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert collections.read(spark, path) is None
    docs = spark.createDataFrame([("a", "f1", 1), ("b", "f1", 2), ("c", "f2", 3), ("c", "f2", 2)], "id string, file_path string, n long")
    collections.upsert(docs, path)
    collections.upsert(spark.createDataFrame([("b", "f3", 9), ("d", "f3", 4)], "id string, file_path string, n long"), path)
    rows = lambda: sorted((r["id"], r["file_path"], r["n"]) for r in collections.read(spark, path).collect())
    assert rows() == [("a", "f1", 1), ("b", "f3", 9), ("c", "f2", 3), ("d", "f3", 4)]
    collections.delete_files(spark, path, spark.createDataFrame([("f3",), ("f9",)], "file_path string"))
    collections.optimize(spark, path)
    collections.optimize(spark, path)
    assert rows() == [("a", "f1", 1), ("c", "f2", 3)]
    assert len(list((tmp_path / "c").glob("generation=*"))) == collections.KEPT
    collections.drop(spark, path)
    assert collections.read(spark, path) is None


def test_service_is_called_in_batches_and_again(spark, tmp_path):
    mark = tmp_path / "failed"

    def call(texts):
        if not mark.exists():
            mark.touch()
            raise OSError("once")
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc"), (4, "dd")], "id long, t string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embeddings.embedded(rows, "id", "t", call, batch=2).collect()}
    assert got == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0], 4: [2.0, 1.0]}
    with pytest.raises(Exception, match="vectors for"):
        embeddings.embedded(rows, "id", "t", lambda texts: [[1.0]] * 9).collect()


def test_options():
    assert Q.checked("5", "0.5") == (5, 0.5) and Q.checked() == (None, None)
    for bad in (("0", None), ("x", None), ("-1", None), (None, "1.1"), (None, "-0.1"), (None, "nan"), (None, "y")):
        with pytest.raises(ValueError):
            Q.checked(*bad)


def test_candidate_cache(spark, tmp_path):
    """What is stored is used for the same files and options, and not for changed ones."""
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    found = lambda: spark.read.parquet(path).where("id > 0")
    stored = scans.cached(found(), "q", "10").inputFiles()
    assert scans.cached(found(), "q", "10").inputFiles() == stored != scans.cached(found(), "q", "11").inputFiles()
    assert scans.cached(spark.read.parquet(path).where("id > 2"), "q", "10").count() == 1
    spark.range(10, 12).write.mode("append").parquet(path)
    assert scans.cached(found(), "q", "10").count() == 5


def test_store_and_gate(spark):
    at = F.to_timestamp(F.lit("2024-01-01"))
    store = compression.stored(spark.createDataFrame([("h1", "x"), ("h1", "x"), ("h2", "y")], "hash string, content string").withColumn("created_at", at))
    store = compression.retrieved(store, spark.createDataFrame([("h1",), ("h1",), ("h9",)], "hash string"))
    store = compression.stored(spark.createDataFrame([("h1", "z"), ("h3", "w")], "hash string, content string").withColumn("created_at", at), store)
    assert sorted((r["hash"], r["content"], r["retrievals"]) for r in store.collect()) == [("h1", "x", 2), ("h2", "y", 0), ("h3", "w", 0)]
    assert [r["hash"] for r in compression.evicted(store, at, "INTERVAL 1 DAY", 1).collect()] == ["h1"]
    counts = spark.createDataFrame([(False, ["1 stale"])], "is_fresh boolean, warnings array<string>")
    fresh = spark.createDataFrame([(True, [])], "is_fresh boolean, warnings array<string>")
    told = lambda *args: tuple(compression.gate(*args).first())
    assert told(counts, False) == (False, "blocked", ["1 stale"]) and told(counts, True)[:2] == (True, "forced")
    assert told(counts, False, fresh) == (True, "fresh after sync", []) and told(fresh, False) == (True, "fresh", [])


def test_remembered_by_scope(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s1")], "scope string, signature string")
    path = f"file://{tmp_path}/said"
    assert not any(r["discussed"] for r in review.remembered(rows, path).collect())
    review.remember(rows.where("scope = 'a'"), path)
    assert {r["scope"]: r["discussed"] for r in review.remembered(rows, path).collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("most", [1, 3, 4, 9])
def test_tail_eviction(spark, most):
    selected, extra = [1, 2, 3], [7, 2, 8, 9]
    want = selected[:most]
    for x in extra:
        if x not in want:
            want = [*(want[:-1] if len(want) >= most else want), x]
    frame = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "k long, place long")
    got = windows.tail_inserted(frame(selected[:most]), frame(extra), "k", most).orderBy("place").collect()
    assert [r["k"] for r in got] == want
