"""Sharding: the law, whole groups where they fit, and no group that could still come closer together."""

import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm.sharding import quotas, sharded


def held(df, rows, shards):
    """Checks what must hold for any table; gives each group's cells."""
    out = df.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0)))
    counts = [len(slots[j]) for j in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        assert [i for _, i in found] == sorted(i for _, i in found)
    cells = defaultdict(Counter)
    for r in out:
        cells[r["text_crc32"]][r["shard"]] += 1
    return cells


def test_odd_documents(docs, empty):
    odd = docs.select("*", F.lit(0).alias("g"), F.lit(1).alias("shard"), F.lit(2).alias("all"))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    cells = held(sharded(odd, 4), rows, 4)
    assert all(len(c) == 1 for c in cells.values() if 1 < sum(c.values()) <= 2)
    held(sharded(odd, 1), rows, 1)
    held(sharded(odd, 30), rows, 30)
    assert sharded(empty, 4).collect() == []


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i if i % 2 else i % 200}") for i in range(2000)]
    cells = held(sharded(spark.createDataFrame(rows, "doc_id long, text string"), 16), rows, 16)
    assert all(len(c) == 1 for c in cells.values())


def test_group_larger_than_a_shard(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i // 6 if i % 2 else i}") for i in range(1200)]
    cells = held(sharded(spark.createDataFrame(rows, "doc_id long, text string"), 16), rows, 16)
    hot = cells[zlib.crc32(b"copy")]
    assert sum(hot.values()) == 400 and len(hot) <= 9 and sorted(hot.values())[-4] >= 50  # six at best


def test_no_room_but_swaps(spark):
    """Every document is linked, so that shards are full from the start."""
    rows = [(i, f"text {(i * 7919) % 60}") for i in range(360)]
    cells = held(sharded(spark.createDataFrame(rows, "doc_id long, text string"), 6), rows, 6)
    inside = sum(n * (n - 1) for c in cells.values() for n in c.values())
    assert inside >= 0.7 * 60 * 6 * 5  # by chance: a sixth


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_quotas(data):
    shards = data.draw(st.integers(1, 6))
    held = data.draw(st.lists(st.integers(0, 50), min_size=shards, max_size=shards))
    capacity = [h + data.draw(st.integers(0, 10)) for h in held]
    wants, left = {}, list(held)
    for i in range(shards):
        for j in range(shards):
            if i != j and left[i]:
                wants[i, j] = data.draw(st.integers(0, left[i]))
                left[i] -= wants[i, j]
    allowed = quotas(wants, held, capacity)
    assert all(0 < n <= wants[k] for k, n in allowed.items())
    after = [h + sum(n for (_, b), n in allowed.items() if b == j) - sum(n for (a, _), n in allowed.items() if a == j) for j, h in enumerate(held)]
    assert all(0 <= a <= c for a, c in zip(after, capacity, strict=True))
    if all(h + sum(n for (_, b), n in wants.items() if b == j) <= c for j, (h, c) in enumerate(zip(held, capacity, strict=True))):
        assert allowed == {k: n for k, n in wants.items() if n}
