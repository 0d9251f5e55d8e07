"""Incremental syncs against full rebuilds."""

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import storage, sync


def source(spark, contents):
    return spark.createDataFrame([(p, c) for p, c in contents.items()], "file_path string, content string")


def snapshot(files):
    return files.select("file_path", F.sha2("content", 256).alias("content_hash"))


def builder(files, calls=None):
    """A document a word."""

    def build(some):
        if calls is not None:
            calls.append(sorted(r["file_path"] for r in some.collect()))
        words = F.posexplode(F.filter(F.split("content", " "), lambda w: w != ""))
        rows = files.join(some, "file_path").select("file_path", words.alias("at", "word"))
        return rows.select("file_path", F.concat_ws("#", "file_path", "at").alias("id"), "word")

    return build


def state(spark, path):
    docs = sync.documents(spark, path)
    entries = {r["file_path"]: (r["state"], list(r["doc_ids"])) for r in sync.manifest(spark, path).collect()}
    return sorted(tuple(r) for r in docs.select("file_path", "id", "word").collect()) if docs is not None else [], entries


def test_a_sync_equals_a_rebuild(spark):
    path, contents = storage.scratch(spark), {f"f{i}": f"a{i} b{i} c" for i in range(30)} | {"empty": ""}
    files, calls = source(spark, contents), []
    report = sync.sync(spark, path, snapshot(files), builder(files, calls))
    assert (report.generation, report.refreshed, report.removed, report.documents) == (0, 31, 0, 90)
    contents |= {"f3": "new words here and there", "f31": "more"}
    del contents["f5"]
    files = source(spark, contents)
    report = sync.sync(spark, path, snapshot(files), builder(files, calls))
    # what has no documents is tried again
    assert calls[1] == ["empty", "f3", "f31"] and (report.refreshed, report.removed, report.documents) == (3, 1, 6)
    whole = storage.scratch(spark)
    sync.sync(spark, whole, snapshot(files), builder(files))
    assert state(spark, path) == state(spark, whole)
    del contents["empty"]
    files = source(spark, contents)
    sync.sync(spark, path, snapshot(files), builder(files, calls))
    assert len(calls) == 2 and sync.sync(spark, path, snapshot(files), builder(files, calls)).generation is None
    before = state(spark, path)
    sync.compact(spark, path)
    assert state(spark, path) == before and len(sync._complete(spark, path)) == 1
    files = source(spark, contents | {"f9": "last"})
    assert sync.sync(spark, path, snapshot(files), builder(files, calls)).refreshed == 1 and calls[-1] == ["f9"]


def test_bytes_follow_the_change(spark):
    path, contents = storage.scratch(spark), {f"f{i}": " ".join(f"w{i}x{j}" for j in range(400)) for i in range(200)}
    files = source(spark, contents)
    sync.sync(spark, path, snapshot(files), builder(files))
    files = source(spark, contents | {"f7": contents["f7"] + " changed"})
    sync.sync(spark, path, snapshot(files), builder(files))
    assert 0 < sync.written_bytes(spark, path, 1) < sync.written_bytes(spark, path, 0) / 20


def test_some_files_only(spark):
    path, contents = storage.scratch(spark), {"a": "one", "b": "two", "c": "three"}
    files = source(spark, contents)
    sync.sync(spark, path, snapshot(files), builder(files))
    files = source(spark, {"a": "ONE", "c": "THREE"})
    sync.sync(spark, path, snapshot(files), builder(files), spark.createDataFrame([("a",), ("b",), ("z",)], "file_path string"))
    assert state(spark, path)[0] == [("a", "a#0", "ONE"), ("c", "c#0", "three")]


def test_a_failure_marks_files_and_keeps_their_documents(spark):
    path, contents = storage.scratch(spark), {"a": "one", "b": "two"}
    files = source(spark, contents)
    sync.sync(spark, path, snapshot(files), builder(files))
    before, files = state(spark, path), source(spark, {"a": "ONE", "b": "two", "c": "three"})

    def broken(some):
        return builder(files)(some).withColumn("word", F.raise_error(F.lit("no service")))

    with pytest.raises(Exception, match="no service"):
        sync.sync(spark, path, snapshot(files), broken)
    docs, entries = state(spark, path)
    assert docs == before[0] and entries == {"a": ("failed", ["a#0"]), "b": ("fresh", ["b#0"]), "c": ("failed", [])}
    assert "no service" in sync.manifest(spark, path).where("file_path = 'a'").first()["error"]
    sync.sync(spark, path, snapshot(files), builder(files))
    assert state(spark, path)[1] == {"a": ("fresh", ["a#0"]), "b": ("fresh", ["b#0"]), "c": ("fresh", ["c#0"])}
