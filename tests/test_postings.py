"""Ranked search by blocks of postings against scores of all documents."""

import math
import random

import pytest

from lumenfold.operators import postings as P
from lumenfold.operators import ranking
from lumenfold.plans import query as Q
from lumenfold.sources import storage


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = [f"word{i}x" for i in range(60)]
    weights = [1 / (1 + i) for i in range(60)]
    out = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(400)]
    return out + [(1000 + i, out[7][1]) for i in range(30)] + [(2000, ""), (2001, None)]


@pytest.fixture(scope="module")
def index(spark, docs):
    return P.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), storage.scratch(spark), block=16)


def plain(docs, terms):
    sets = {i: set(Q.tokens(t or "", synonyms=False)) for i, t in docs}
    n, mean = len(sets), sum(map(len, sets.values())) / len(sets)
    score = {}
    for t in set(terms):
        df = sum(t in s for s in sets.values())
        for i, s in sets.items():
            if t in s:
                score[i] = score.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(s) / mean))
    return sorted(((i, round(v, 9)) for i, v in score.items()), key=lambda r: (-r[1], r[0]))


QUERIES = [["word0x"], ["word40x", "word3x"], ["word1x", "word2x", "word55x", "missing"], ["word59x"], ["missing"]]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search(index, docs, k):
    for terms in QUERIES:
        got = P.search(index, terms, k)
        assert [(r["doc_id"], round(r["score"], 9)) for r in got.found.collect()] == plain(docs, terms)[:k]


def test_blocks_are_skipped(index):
    one = P.search(index, ["word0x", "word1x"], 5)
    assert one.scored < one.blocks / 2
    all_ = P.search(index, ["word0x", "word1x"], 10_000)
    assert all_.scored == all_.blocks == one.blocks


@pytest.mark.parametrize("k", [3, 50])
def test_many_queries(spark, index, docs, k):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, terms array<string>")
    got = {}
    for r in P.search_many(index, asked, k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], round(r["score"], 9))
    for i, terms in enumerate(QUERIES):
        assert [got.get(i, {})[n + 1] for n in range(len(got.get(i, {})))] == plain(docs, terms)[:k]


def test_the_index_equals_a_scan(spark, index, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    terms = ["word2x", "word9x"]
    scan = {r["doc_id"]: round(r["score"], 9) for r in ranking.bm25(table, terms).collect()}
    assert {r["doc_id"]: round(r["score"], 9) for r in P.search(index, terms, 1000).found.collect()} == scan


def test_empty(spark):
    index = P.build(spark.createDataFrame([], "doc_id long, text string"), storage.scratch(spark))
    assert P.search(index, ["a"], 3).found.collect() == []
    assert P.search_many(index, spark.createDataFrame([(1, ["abc"])], "query_id long, terms array<string>"), 3).collect() == []
