"""A stored index of files' documents that follows its source by the changes alone.

A sync compares hashes of files with the manifest, builds the documents of what is new, changed or not fresh, and
writes these and the manifest rows of these files as the next generation; nothing else is written or
removed. A document counts if its generation is the one the manifest names for its file, so what older
generations hold of a changed or removed file is out at once, and a generation whose manifest isn't
complete counts for nobody. If documents cannot be built, the files of the sync become failed and keep the documents they
had. `compact` puts all that counts into one generation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources import storage
from lumenfold.streaming.freshness import refresh_sets

#: A file's entry: its state, its hash, the ids of its documents and the generation that holds them.
MANIFEST = "file_path string, content_hash string, state string, doc_ids array<string>, held bigint, error string"


@dataclass
class Report:
    generation: int | None
    refreshed: int
    removed: int
    documents: int


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Generations with a complete manifest, oldest first; names only are listed."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath().getName() for s in files.listStatus(top) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("generation=")) for n in names if n.startswith("generation="))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST of the files that are in the index: the newest row of each."""
    found = _complete(spark, path)
    if not found:
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(f"{MANIFEST}, generation bigint").option("basePath", f"{path}/manifest").parquet(*(f"{path}/manifest/generation={n}" for n in found))
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    last = rows.groupBy("file_path").agg(F.max_by(F.struct(*columns[1:]), "generation").alias("__e"))
    return last.select("file_path", "__e.*").where("state <> 'removed'")


def documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents that count; None before any was written."""
    known = manifest(spark, path)
    held = [r["held"] for r in known.where("held is not null").select("held").distinct().collect()]  # a row a generation
    if not held:
        return None
    rows = spark.read.option("basePath", f"{path}/documents").parquet(*(f"{path}/documents/generation={n}" for n in sorted(held)))
    rows = rows.withColumn("generation", F.col("generation").cast("bigint"))
    return rows.join(known.select("file_path", F.col("held").alias("generation")), ["file_path", "generation"], "left_semi").drop("generation")


def sync(spark: SparkSession, path: str, snapshot: DataFrame, build: Callable[[DataFrame], DataFrame], files: DataFrame | None = None) -> Report:
    """Bring the index up to a snapshot (file_path, content_hash) of all files, or of its rows for `files` (file_path) alone.

    build: makes the documents (file_path, id and more) of the files (file_path) it is given. If that fails, they are
    marked failed and the error is raised."""
    old = manifest(spark, path)
    now = snapshot.select("file_path", "content_hash")
    if files is not None:
        some = files.select("file_path").distinct()
        old, now = old.join(some, "file_path", "left_semi"), now.join(some, "file_path", "left_semi")
    entries = old.select("file_path", "content_hash", "state", F.size("doc_ids").alias("n_docs"))
    acts = refresh_sets(entries, now).join(now, "file_path", "left").join(old.select("file_path", F.col("content_hash").alias("had"), "doc_ids", "held"), "file_path", "left")
    acts = storage.kept(spark, acts)
    counts = {r["action"]: r["n"] for r in acts.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Report(None, 0, 0, 0)
    done = _complete(spark, path)
    number = done[-1] + 1 if done else 0
    place = f"{path}/documents/generation={number}"
    gone = acts.where("action = 'remove'").select("file_path", F.col("had").alias("content_hash"), F.lit("removed").alias("state"), F.array().cast("array<string>").alias("doc_ids"), F.lit(None).cast("bigint").alias("held"), F.lit(None).cast("string").alias("error"))
    fresh = acts.where("action = 'refresh'").select("file_path", "content_hash")

    def said(rows: DataFrame) -> None:
        rows.unionByName(gone).write.mode("overwrite").parquet(f"{path}/manifest/generation={number}")

    written = 0
    try:
        if counts.get("refresh"):
            build(fresh.select("file_path")).write.mode("overwrite").parquet(place)
            ids = spark.read.parquet(place).groupBy("file_path").agg(F.array_sort(F.collect_list("id")).alias("doc_ids"))
            made = fresh.join(ids, "file_path", "left").select("file_path", "content_hash", F.lit("fresh").alias("state"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"), F.lit(number).cast("bigint").alias("held"), F.lit(None).cast("string").alias("error"))
            written = spark.read.parquet(place).count()
        else:
            made = gone.where("false")
        said(made)
    except Exception as error:
        failed = acts.where("action = 'refresh'").select("file_path", "content_hash", F.lit("failed").alias("state"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"), "held", F.lit(str(error).splitlines()[0][:500]).alias("error"))
        said(failed)
        raise
    return Report(number, counts.get("refresh", 0), counts.get("remove", 0), written)


def compact(spark: SparkSession, path: str) -> None:
    """All that counts as one generation; older ones go. Not beside a sync."""
    done = _complete(spark, path)
    rows, known = documents(spark, path), storage.kept(spark, manifest(spark, path))
    number = done[-1] + 1 if done else 0
    if rows is not None:
        rows.repartitionByRange("file_path").sortWithinPartitions("file_path").write.mode("overwrite").parquet(f"{path}/documents/generation={number}")
    known.withColumn("held", F.when(F.col("held").isNotNull(), F.lit(number).cast("bigint"))).write.mode("overwrite").parquet(f"{path}/manifest/generation={number}")
    for n in done:
        storage.remove(spark, f"{path}/documents/generation={n}")
        storage.remove(spark, f"{path}/manifest/generation={n}")


def written_bytes(spark: SparkSession, path: str, generation: int) -> int:
    """Bytes of documents that a generation wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents/generation={generation}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(files.getContentSummary(at).getLength()) if files.exists(at) else 0
