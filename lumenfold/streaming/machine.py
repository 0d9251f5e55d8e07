"""The life of an index entry as a state machine over a stream of changes, with timers.

A change makes a file's entry stale; it keeps its documents. If nothing else happens to the file for as long as the
debounce, a timer makes it pending and its documents go. A sync makes it fresh, with new documents; an
error makes it failed, with those it had. An entry that nothing touches for as long as it may live expires.

Time is event time, so a stream that is run again, or in other batches, makes the same transitions: before an event
is applied, so is a timer that was due by then, and a timer that has been overtaken does nothing. Events that
are older than the last one applied to their file, or repeat it, change nothing. State is kept by file in the state
store, and what is written is transitions, so a batch costs what its own files cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.storage import scratch, stream

#: What a change is: change, sync (with the ids of the documents made) or error.
CHANGES = "event_id bigint, ts timestamp, file string, kind string, content_hash string, doc_ids array<string>"
TRANSITIONS = "file string, seq bigint, at timestamp, state string, content_hash string, doc_ids array<string>, event_id bigint"
#: The provider of state that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "seq bigint, state string, content_hash string, doc_ids array<string>, ts bigint, event_id bigint, due bigint, ends bigint"


def _processor(debounce_ms: int, live_ms: int | None):
    """The processor's class, made here so that workers get it with the query and need not import it."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    move = Row("file", "seq", "at", "state", "content_hash", "doc_ids", "event_id")

    class Machine(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.entry = handle.getValueState("entry", _ENTRY)

        def _get(self):
            row = self.entry.get()
            if row is None:
                return {"seq": 0, "state": None, "content_hash": None, "doc_ids": [], "ts": -(1 << 62), "event_id": -(1 << 62), "due": None, "ends": None}
            return dict(zip(("seq", "state", "content_hash", "doc_ids", "ts", "event_id", "due", "ends"), row, strict=True)) | {"doc_ids": list(row[3] if row[3] is not None else [])}

        def _keep(self, e):
            self.entry.update((e["seq"], e["state"], e["content_hash"], e["doc_ids"], e["ts"], e["event_id"], e["due"], e["ends"]))

        def _step(self, out, key, e, at, state):
            e["seq"] += 1
            e["state"] = state
            out.append(move(key[0], e["seq"], at, state, e["content_hash"], list(e["doc_ids"]), e["event_id"]))

        def _timers(self, out, key, e, now):
            """Whatever was due by now, in order."""
            for what, at in sorted((e[w], w) for w in ("due", "ends") if e[w] is not None and e[w] <= now):
                what, at = at, what
                if e[what] is None:
                    continue
                e[what] = None
                if what == "due":
                    e["doc_ids"] = []
                    self._step(out, key, e, at, "pending")
                else:
                    e["due"], e["doc_ids"] = None, []
                    self._step(out, key, e, at, "expired")

        def _wake(self, e, was):
            """One timer a file: for what is due first."""
            at = min({e["due"], e["ends"]} - {None}, default=None)
            if at != was and was is not None:
                self.handle.deleteTimer(was)
            if at != was and at is not None:
                self.handle.registerTimer(at)

        def handleInputRows(self, key, rows, timerValues):
            e, out = self._get(), []
            found = [(r["millis"], r["event_id"], r["kind"], r["content_hash"], r["doc_ids"]) for r in rows]
            was = min({e["due"], e["ends"]} - {None}, default=None)
            for ts, event_id, kind, content_hash, doc_ids in sorted(found, key=lambda r: (r[0], r[1])):
                if (ts, event_id) <= (e["ts"], e["event_id"]):
                    continue
                self._timers(out, key, e, ts)
                e["ts"], e["event_id"], e["due"] = ts, event_id, None
                e["content_hash"] = e["content_hash"] if content_hash is None else content_hash
                if kind == "sync":
                    e["doc_ids"] = list(doc_ids) if doc_ids is not None else []
                if kind == "change":
                    e["due"] = ts + debounce_ms
                e["ends"] = None if live_ms is None else ts + live_ms
                self._step(out, key, e, ts, {"sync": "fresh", "error": "failed"}.get(kind, "stale"))
            self._wake(e, was)
            self._keep(e)
            yield from out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            e, out = self._get(), []
            # what else is due by the watermark comes now, and needs no timer
            self._timers(out, key, e, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
            self._wake(e, None)
            self._keep(e)
            yield from out

        def close(self):
            pass

    return Machine()


def transitions(changes: DataFrame, debounce_ms: int = 250, live_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """TRANSITIONS of a streaming frame of CHANGES; `late`: how much events may be out of order across batches.

    live_ms: how long an entry lives that nothing touches; None: for ever. An expired entry that changes again
    begins anew, its numbers go on."""
    # rows go to Python and back as they are, in batches of all files: a frame a file costs more than its events
    millis = F.unix_millis("ts").alias("millis")  # the processor reckons in these
    keyed = changes.where("file is not null and ts is not null").withWatermark("ts", late).select("ts", millis, "event_id", "file", "kind", "content_hash", "doc_ids").groupBy("file")
    made = TRANSITIONS.replace("at timestamp", "at bigint")
    moves = keyed.transformWithState(statefulProcessor=_processor(debounce_ms, live_ms), outputStructType=made, outputMode="append", timeMode="EventTime")
    return moves.withColumn("at", F.timestamp_millis("at"))


def run(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options):
    """Append the transitions of a streaming frame to the Parquet table at `path`; returns the started query."""
    spark = changes.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, PROVIDER)
    try:
        return transitions(changes, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def current(moves: DataFrame) -> DataFrame:
    """file, state, content_hash, doc_ids, event_id, at: where each file's last transition left it."""
    last = moves.groupBy("file").agg(F.max_by(F.struct("state", "content_hash", "doc_ids", "event_id", "at"), "seq").alias("e"))
    return last.select("file", "e.*")


def replayed(spark: SparkSession, events_path: str, select, files_a_batch: int | None = None, **options) -> DataFrame:
    """The transitions of a file or a folder of files (`select` makes CHANGES of them), run through the stream once."""
    top = scratch(spark)
    rows = select(stream(spark, events_path, **({} if files_a_batch is None else {"maxFilesPerTrigger": files_a_batch})))
    run(rows, f"{top}/moves", f"{top}/progress", **options).awaitTermination()
    return spark.read.schema(TRANSITIONS).parquet(f"{top}/moves")
