"""Freshness of indexed files, in batches and as a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.storage import scratch, stream

EVENTS = "event_id bigint, ts timestamp, file string, kind string"


def refresh_sets(manifest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """file_path, action: refresh what is new, changed, not fresh or without documents; remove what is gone.

    manifest: file_path, content_hash, state, n_docs; snapshot: file_path, content_hash."""
    old = manifest.select("file_path", F.col("content_hash").alias("had"), "state", "n_docs")
    both = snapshot.join(old, "file_path", "full_outer")
    action = F.when(F.col("content_hash").isNull(), "remove").when(F.col("had").isNull() | (F.col("had") != F.col("content_hash")) | (F.col("state") != "fresh") | (F.col("n_docs") == 0), "refresh")
    return both.select("file_path", action.alias("action")).where("action is not null")


def next_state(kind):
    """The state that the last event of a file leaves: changes are stale, waits pending, syncs fresh, errors failed."""
    return F.when(kind == "error", "failed").when(kind == "sync", "fresh").when(kind == "wait", "pending").otherwise("stale")


def final_states(events: DataFrame) -> DataFrame:
    """file, state, event_id after all events; the last by (ts, event_id) wins."""
    last = events.groupBy("file").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max(F.struct("ts", "event_id")).alias("at"))
    return last.select("file", next_state(F.col("kind")).alias("state"), F.col("at.event_id").alias("event_id"))


def stream_states(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep final_states of a streaming frame as a Parquet table at `path`, a version a micro-batch.

    Each batch is reduced to a row a file, joined with the version before, and written as the next, so a batch that is
    run again after a failure writes the same version. Returns the started query."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("file").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max(F.struct("ts", "event_id")).alias("at"))
        before = latest_version(spark, path, number)
        if before is not None:
            old = spark.read.parquet(f"{path}/v={before}").select("file", "kind", F.struct("ts", "event_id").alias("at"))
            new = old.unionByName(new).groupBy("file").agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("at"))
        new.select("file", "kind", "at.ts", "at.event_id").write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
    found = [v for v in found if below is None or v < below]
    return max(found, default=None)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """file, state, event_id of the latest version."""
    rows = spark.read.parquet(f"{path}/v={latest_version(spark, path)}")
    return rows.select("file", next_state(F.col("kind")).alias("state"), "event_id")


def debounced(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """file, start, n: bursts of changes of a file, ended by a pause; works on batches and, behind a watermark, on streams."""
    window = F.session_window("ts", gap)
    return events.groupBy("file", window.alias("w")).agg(F.count("*").alias("n")).select("file", F.col("w.start").alias("start"), "n")


def streamed(spark: SparkSession, events_path: str, select) -> DataFrame:
    """Run the states of a file or a folder of files through the stream once and read the table back."""
    top = scratch(spark)
    rows = select(stream(spark, events_path))
    stream_states(rows, f"{top}/states", f"{top}/progress").awaitTermination()
    return read_states(spark, f"{top}/states")
