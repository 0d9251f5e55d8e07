"""The state machine against a plain loop, in one batch and in many."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import storage
from lumenfold.streaming import machine as M

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(events, debounce, live, watermark):
    """(file, state, doc ids, seconds) of every transition, by file and order."""
    out, entries = [], {}

    def due(f, now):
        e = entries[f]
        for at, what in sorted((e[w], w) for w in ("due", "ends") if e.get(w) is not None and e[w] <= now):
            if e[what] is None:
                continue
            e[what], e["ids"] = None, []
            if what == "ends":
                e["due"] = None
            out.append((f, "pending" if what == "due" else "expired", (), at))

    for i, ts, f, kind, ids in sorted(events, key=lambda e: (e[1], e[0])):
        e = entries.setdefault(f, {"ids": [], "last": (-1, -1)})
        if (ts, i) <= e["last"]:
            continue
        due(f, ts)
        e["last"], e["due"], e["ends"] = (ts, i), ts + debounce if kind == "change" else None, None if live is None else ts + live
        if kind == "sync":
            e["ids"] = ids
        out.append((f, {"sync": "fresh", "error": "failed"}.get(kind, "stale"), tuple(e["ids"]), ts))
    for f in entries:
        due(f, watermark)
    return {f: [x[1:] for x in out if x[0] == f] for f in entries}


def rows(events):
    return [(i, START + timedelta(seconds=ts), f, kind, f"h{i}", [str(x) for x in ids] if ids is not None else None) for i, ts, f, kind, ids in events]


def run(spark, batches, **options):
    top = storage.scratch(spark)
    query = None
    for n, events in enumerate(batches):
        spark.createDataFrame(rows(events), M.CHANGES).coalesce(1).write.mode("append").parquet(f"{top}/in/n={n:03}")
        source = spark.readStream.schema(M.CHANGES).parquet(f"{top}/in/*")
        query = M.run(source, f"{top}/out", f"{top}/progress", **options)
        query.awaitTermination()
    return spark.read.schema(M.TRANSITIONS).parquet(f"{top}/out")


def told(moves):
    out = {}
    for r in moves.orderBy("file", "seq").collect():
        out.setdefault(r["file"], []).append((r["state"], tuple(int(x) for x in r["doc_ids"]), (r["at"].replace(tzinfo=timezone.utc) - START).total_seconds()))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    return [(i, 3 * i + rng.randint(0, 2), f"f{rng.randrange(8)}", rng.choice(["change", "change", "sync", "error"]), [i, i + 1]) for i in range(n)]


@pytest.mark.parametrize("live", [None, 60])
def test_one_batch_equals_a_loop(spark, live):
    events = made(1)
    moves = run(spark, [[*events, *events[5:9]]], debounce_ms=10_000, live_ms=None if live is None else live * 1000)
    last = max(e[1] for e in events)
    assert told(moves) == plain(events, 10, live, last)


def test_many_batches_make_the_same_transitions(spark):
    """A batch costs its own files; what repeats or is older than a file's last event changes nothing."""
    events = made(2, 60)
    events.sort(key=lambda e: (e[1], e[0]))
    parts = [events[:20], [*events[20:40], *events[3:6]], events[40:]]
    moves = run(spark, parts, debounce_ms=10_000)
    assert told(moves) == plain(events, 10, None, max(e[1] for e in events))
    states = {r["file"]: (r["state"], list(r["doc_ids"])) for r in M.current(moves).collect()}
    for f, steps in plain(events, 10, None, max(e[1] for e in events)).items():
        assert states[f] == (steps[-1][0], [str(x) for x in steps[-1][1]])


def test_the_path_of_a_file(spark):
    events = [(1, 0, "a", "change", None), (2, 100, "a", "sync", [7]), (3, 200, "a", "change", None), (4, 205, "a", "error", None), (5, 300, "a", "change", None), (6, 400, "b", "change", None)]
    got = told(run(spark, [events], debounce_ms=10_000))
    assert got["a"] == [("stale", (), 0), ("pending", (), 10), ("fresh", (7,), 100), ("stale", (7,), 200), ("failed", (7,), 205), ("stale", (7,), 300), ("pending", (), 310)]
    assert got["b"] == [("stale", (), 400)]


def test_two_timers_that_are_due_together_come_in_order(spark):
    """A file whose both timers are overtaken by the watermark at once is pending, then expired."""
    events = [(1, 0, "a", "change", [1]), (2, 5, "b", "sync", [2]), (3, 500, "c", "error", None)]
    got = told(run(spark, [events], debounce_ms=10_000, live_ms=60_000))
    assert got["a"] == [("stale", (), 0), ("pending", (), 10), ("expired", (), 60)]
    assert got["b"] == [("fresh", (2,), 5), ("expired", (), 65)] and got["c"] == [("failed", (), 500)]


@pytest.mark.parametrize("parts", [None, 3])
def test_events_may_be_a_file_or_a_folder(spark, tmp_path, parts):
    """A table that is a folder of parts is read like one that is a file."""
    import duckdb

    import __spark_entry__

    given = "/root/testdata/sf0.001/events.parquet"
    if parts is None:
        (tmp_path / "events.parquet").symlink_to(given)
    else:
        spark.read.parquet(given).repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    held = duckdb.connect()
    held.execute(f"CREATE VIEW events AS SELECT * FROM '{given}'")
    for name in ("stream_machine", "stream_manifest"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = held.execute(__spark_entry__.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
