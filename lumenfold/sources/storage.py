"""Folders that the driver and all executors share, and tables kept in them until their source changes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _top(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a temporary folder if driver and executors are one process, as in
    tests, else the warehouse, which all share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        top = "file://" + tempfile.mkdtemp(prefix="lumenfold-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lumenfold"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{_top(spark)}/{uuid.uuid4().hex}"


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a cut of lineage that outlives executors."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of a Parquet table as a stream; like a batch reader's, its path may be a file or a folder of files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # a stream's source is a folder
    return reader.option("pathGlobFilter", name).parquet(folder)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fingerprint(*sources: DataFrame) -> str:
    """A hash of what frames select, and of names, sizes and modification times of the files that they read; their
    contents aren't read. A frame without files is told by its plan alone."""
    parts = []
    for df in sources:
        parts.append(f"{df.schema.json()} {df._jdf.queryExecution().analyzed().canonicalized()}")
        files = df.inputFiles()
        if files:
            seen = df.sparkSession.read.format("binaryFile").load(files).agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
            parts.append(f"{seen[0]}:{seen[1]}")
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:32]


def reused(name: str, sources: list[DataFrame], options: tuple, build: Callable[[str], None]) -> str:
    """The folder of something built from `sources`: what stands there for their files as they are now and these options
    is used again; else `build` is given a new folder, which takes its place when it is complete.

    Two that build at once build the same; the later finds the earlier's and drops its own. What older files
    of the same sources left is not removed, as a reader may still hold it; `forget` removes all of a name."""
    spark = sources[0].sparkSession
    key = hashlib.sha256(repr((fingerprint(*sources), options)).encode()).hexdigest()[:32]
    path = f"{_top(spark)}/kept-{name}/{key}"
    if exists(spark, path):
        return path
    fresh = scratch(spark)
    build(fresh)
    jvm = spark._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(to.getParent())
    if files.exists(to) or not files.rename(at, to):
        if not files.exists(to):
            raise OSError(f"cannot move {fresh} to {path}")
        files.delete(at, True)
    return path


def forget(spark: SparkSession, name: str) -> None:
    """Remove all that `reused` keeps under a name."""
    remove(spark, f"{_top(spark)}/kept-{name}")
