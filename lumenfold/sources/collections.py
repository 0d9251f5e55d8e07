"""Stored tables that change: snapshots of a code graph, and collections of vector documents.

A store is a folder of generations, each a whole table in Parquet. A change writes the next generation
and readers take the newest that is complete, so neither meets a table that is half written, and an
executor that is lost costs a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Generations that are kept, so that readers that began with one can end with it.
KEPT = 3


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Complete generations, oldest first; names only are listed."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath().getName() for s in files.listStatus(top) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))


def write(df: DataFrame, path: str, *partitions: str) -> None:
    """df as the store's next generation; the oldest beyond KEPT go."""
    spark = df.sparkSession
    found = _generations(spark, path)
    df.write.partitionBy(*partitions).parquet(f"{path}/generation={found[-1] + 1 if found else 0}")
    jvm = spark._jvm
    for n in found[: max(0, len(found) + 1 - KEPT)]:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/generation={n}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest generation; None for a store that has none."""
    found = _generations(spark, path)
    return spark.read.parquet(f"{path}/generation={found[-1]}") if found else None


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_snapshot(nodes: DataFrame, path: str) -> None:
    """Nodes (node_id, file_path, language, kind, content, ...) as a snapshot."""
    write(nodes, path, "kind")


def read_snapshot(spark: SparkSession, path: str, mode: str = "full", files: list[str] | None = None) -> DataFrame:
    """A snapshot: `full`; `lite`, without contents, which are then not read; or with contents of some `files` only."""
    nodes = read(spark, path)
    if mode == "lite":
        return nodes.drop("content")
    if mode == "files":
        return nodes.withColumn("content", F.when(F.col("file_path").isin(files or []), F.col("content")))
    return nodes


def document_id(*parts: str):
    """The id of a vector document: a hash of its node, profile and chunker."""
    return F.concat(F.lit("vd_"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32))


def upsert(docs: DataFrame, path: str, key: str = "id") -> None:
    """docs into a collection: rows of its keys go, then docs stand in it. Of docs with one key the greatest row stands."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != key]
    new = docs.groupBy(key).agg(F.max(F.struct(*columns)).alias("__row")).select(key, "__row.*")
    old = read(spark, path)
    write(new if old is None else old.join(new.select(key), key, "left_anti").select(key, *columns).unionByName(new), path)


def delete_files(spark: SparkSession, path: str, files: DataFrame) -> None:
    """Rows of these files (file_path) go from a collection."""
    old = read(spark, path)
    if old is not None:
        write(old.join(files.select("file_path").distinct(), "file_path", "left_anti"), path)


def optimize(spark: SparkSession, path: str, rows_per_file: int = 1 << 20) -> None:
    """The collection in fewer files, sorted by file path, so that filters on it skip row groups."""
    old = read(spark, path)
    if old is not None:
        n = max(1, -(-old.count() // rows_per_file))
        write(old.repartitionByRange(n, "file_path").sortWithinPartitions("file_path"), path)
