"""Operators whose plans avoid trying all pairs, against loops that try them."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import graph, joins, ranking


def test_containing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 9))) for _ in range(80)] + [None]
    needles = ["".join(rng.choices("abc ", k=rng.randint(0, 4))) for _ in range(40)] + ["", None, "zzz", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, hay string")
    seeds = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted((r["id"], r["needle"]) for r in joins.containing(seeds, rows, "needle", "hay").collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in {x for x in needles if x} if t and n in t)


def test_rare_token_neighbours(spark):
    rng = random.Random(2)
    sets = {i: set(rng.choices("abcdefghijklmnop", k=rng.randint(0, 4))) for i in range(60)}
    tokens = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "node_id long, token string")
    nodes = spark.createDataFrame([(i,) for i in sets], "node_id long")
    got = defaultdict(list)
    for r in joins.rare_token_neighbours(tokens, nodes, 0.2, 5).orderBy("node_id", "rank").collect():
        got[r["node_id"]].append((r["peer"], r["shared"]))
    df = defaultdict(int)
    for s in sets.values():
        for t in s:
            df[t] += 1
    rare = {t for t, n in df.items() if 2 <= n <= 12}
    for i, s in sets.items():
        want = sorted(((j, len(s & o & rare)) for j, o in sets.items() if j != i and s & o & rare), key=lambda x: (-x[1], x[0]))[:5]
        assert got[i] == want


@pytest.mark.parametrize("largest, letters", [(4, "abcdefghijklmnop"), (14, "abcdefghijklmnopqrstuvwxyz"), (20, "abcdefghijklmnopqrstuvwxyz")])
def test_most_shared(spark, largest, letters):
    """Sets of all sizes around those that list all their subsets; ties and equal sets."""
    rng = random.Random(largest)
    weights = [1 / (1 + i) for i in range(len(letters))]
    sets = {i: sorted(set(rng.choices(letters, weights, k=rng.randint(0, largest)))) for i in range(90)}
    sets |= {100 + i: sets[i] for i in range(12)} | {200 + i: sets[3] for i in range(9)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "node_id long, tokens array<string>")
    got = defaultdict(list)
    for r in joins.most_shared(df, 5).orderBy("node_id", "rank").collect():
        got[r["node_id"]].append((r["peer"], r["shared"]))
    for i, s in sets.items():
        want = sorted(((j, len(set(s) & set(o))) for j, o in sets.items() if j != i and set(s) & set(o)), key=lambda x: (-x[1], x[0]))[:5]
        assert got[i] == want, i


def test_subsets(spark):
    rng = random.Random(3)
    sets = {i: sorted(set(rng.choices("abcdef", k=rng.randint(1, 4)))) for i in range(40)}
    got = {tuple(r["items"]): r["ids"] for r in joins.subsets(spark.createDataFrame(list(sets.items()), "id long, items array<string>"), "id", "items").collect()}
    for s in sets.values():
        assert got[tuple(s)] == sorted(i for i, o in sets.items() if set(s) <= set(o))[:2]


def test_resolved_calls(spark):
    symbols = spark.createDataFrame([(i, n, f"m::{n}") for i, n in enumerate(["open file", "open door", "open file", "shut door"])], "node_id long, name string, qualified_name string")
    calls = spark.createDataFrame([(1, "Open_File"), (1, "m::open file"), (2, "re open"), (3, "nothing")], "caller long, call string")
    got = {(r["caller"], r["call"]): (r["how"], r["targets"]) for r in joins.resolved_calls(calls, symbols, most=2).collect()}
    assert got == {(1, "Open_File"): ("exact", [0, 2]), (1, "m::open file"): ("exact", [0, 2]), (2, "re open"): ("token", [0, 1])}


def test_resembling(spark):
    rng = random.Random(4)
    docs = {i: set(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for i in range(50)}
    docs |= {100 + i: docs[i] | {"0"} for i in range(30)} | {200: set()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in docs.items()], "doc_id long, tokens array<string>")
    for threshold in (0.3, 0.6, 0.85):
        got = defaultdict(list)
        for r in ranking.resembling(df.withColumnRenamed("doc_id", "query_id"), df, threshold, 4).orderBy("query_id", F.desc("score"), "doc_id").collect():
            got[r["query_id"]].append(r["doc_id"])
        for i, a in docs.items():
            score = {j: (len(a & b) / len(a) + len(a & b) / len(b)) / 2 for j, b in docs.items() if j != i and a and b}
            assert got[i] == sorted((j for j in score if score[j] >= threshold), key=lambda j: (-score[j], j))[:4], (threshold, i)


def test_quantised_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 32)], "vec_id long, embedding array<double>")
    index, recall = ranking.quantised(vectors).cache(), []
    for target in rng.normal(size=(5, 32)):
        got = {r["vec_id"] for r in ranking.nearest_quantised(index, vectors, target.tolist(), 10).collect()}
        cosine = x @ target / np.linalg.norm(x, axis=1)
        recall.append(len(got & set(np.argsort(-cosine)[:10].tolist())) / 10)
    assert np.mean(recall) >= 0.9


def test_diversified_window_and_anchors(spark):
    rng = random.Random(6)
    rows = [(i, round(rng.random(), 3), rng.sample("abcdefgh", rng.randint(1, 3)), i % 17 == 0) for i in range(60)]
    got = [r["node_id"] for r in ranking.diversified(spark.createDataFrame(rows, "node_id long, score double, terms array<string>, is_anchor boolean"), 20, 8).orderBy("place").collect()]
    left, covered, want = sorted(rows, key=lambda r: (-r[1], r[0]))[:20], set(), []
    while len(want) < 8:
        anchors = [r for r in left if r[3]]
        best = min(anchors or left, key=lambda r: ((0 if anchors else -len(set(r[2]) - covered)), -r[1], r[0]))
        left.remove(best)
        covered |= set(best[2])
        want.append(best[0])
    assert got == want


def test_reverse_calls(spark):
    symbols = spark.createDataFrame([(1, "run", "app::run"), (2, "stop", "app::core::stop")], "node_id long, name string, qualified_name string")
    calls = spark.createDataFrame([(7, "app::run"), (8, "run"), (9, "core::stop"), (9, "core::stop")], "caller long, call string")
    got = sorted((r["key"], r["caller"]) for r in graph.reverse_calls(calls, symbols).collect())
    assert got == [("app::run", 7), ("core::stop", 9), ("run", 7), ("run", 8), ("stop", 9)]


def test_edges_among_and_impact_stop(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 1), (4, 4)], "caller long, callee long")
    results = spark.createDataFrame([(1,), (2,), (4,)], "node_id long")
    assert sorted(tuple(r) for r in graph.edges_among(edges, results).collect()) == [(1, 2), (4, 1), (4, 4)]
    got = {r["node"]: r["steps"] for r in graph.impact(edges, spark.createDataFrame([(3,)], "node long"), 9).collect()}
    assert got == {3: 0, 2: 1, 1: 2, 4: 3}
