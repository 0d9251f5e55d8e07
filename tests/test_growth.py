"""No step makes rows with the square of a group's size."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators import code as K
from lumenfold.operators import ranking as R
from lumenfold.operators import search as X
from lumenfold.operators import vector_cells as C


def most_rows(df) -> int:
    """The largest number of rows that an operator of the final plan puts out."""
    df.collect()
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        at = left.pop()
        kind = at.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(at.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(at.plan())
        metric = at.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        inner = at.children()
        left += [inner.apply(i) for i in range(inner.size())]
    return most


def test_focus_counts_a_name_that_many_share_and_call_once(spark):
    n = 300
    nodes = spark.range(2 * n).select(F.col("id").alias("node_id"), F.lit("ColdWidget").alias("name"), F.lit("small::ColdWidget").alias("qualified_name"), F.lit("class").alias("kind"), F.lit("src/small/a.ts").alias("file_path"))
    calls = spark.range(n).select(F.col("id").alias("caller"), F.lit("ColdWidget").alias("call"))
    found = K.focus(nodes, calls, ["src/small"], ["ColdWidget"])
    assert most_rows(found) < 20 * n
    assert {r["node_id"] for r in found.where("near_path and near_symbol").collect()} == set(range(2 * n))
    alone = K.focus(nodes.where("node_id = 0"), calls.where("caller = 0"), ["src/small"], ["ColdWidget"])
    assert [(r["is_path"], r["near_path"], r["near_symbol"]) for r in alone.collect()] == [(True, False, False)]  # its own call makes nothing near


def test_vectors_of_a_group_make_no_rows_for_pairs(spark):
    n = 300
    vectors = spark.range(n).select(F.col("id").alias("node_id"), F.lit(1).alias("label"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"), F.array(F.lit("a")).alias("tokens"))
    asked = vectors.withColumnRenamed("node_id", "query_id")
    found = R.dense_duplicates(asked, vectors, vectors.select("node_id", "tokens"), 0.15, 3)
    assert most_rows(found) < 20 * n
    assert found.count() == 3 * n


def test_cells_make_no_rows_for_pairs(spark, tmp_path):
    n = 300
    vectors = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).alias("embedding"))
    index = C.build(vectors, str(tmp_path / "cells"))
    found = C.nearest_of_all(index, vectors.withColumnRenamed("vec_id", "query_id"), 3, visit=len(index.centres))
    assert most_rows(found) < n * n // 4  # k a query and task, not all pairs
    assert {r["vec_id"] for r in found.where("query_id = 7 and rank = 1").collect()} == {7}


def test_cosines_of_matrices_are_those_of_columns(spark):
    odd = [[1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [1.0, -1.0], [float("nan"), 1.0], [1.0, None], None, [1.0], []]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, v array<double>")
    pairs = rows.alias("a").crossJoin(rows.alias("b")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), V.cosine(F.col("a.v"), F.col("b.v")).alias("s"))
    order = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("s", 9)), "j"))
    wanted = pairs.withColumn("r", order).where("r <= 4").orderBy("i", "r").collect()
    given = [None if v is None or None in v else v for v in odd]
    i, j, s = V.best_cosines(4)(range(len(odd)), given, range(len(odd)), given)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(r["i"], r["j"]) for r in wanted]
    assert all(abs(x - r["s"]) < 1e-9 or (x != x and r["s"] != r["s"]) for x, r in zip(s, wanted, strict=True))


def test_rows_of_one_id_count_as_one_in_the_index(spark):
    nodes = spark.createDataFrame([(1, "red bolt"), (1, "red"), (2, None), (3, "")], "node_id long, content string")
    made = X.index(nodes)
    assert sorted(r["v"] for r in made.sparse.collect()) == [1.0, 2.0]
    assert abs(made.dense.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] - 1) < 1e-9


def test_symbols_of_a_file_make_no_rows_for_pairs(spark):
    """A file whose symbols are like each other: they meet in tasks, and blocks of a file find what the whole finds."""
    n = 300
    kind = F.col("id") % 50
    word = lambda c: F.concat(F.lit("word"), c.cast("string"))
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.lit("src/a.ts").alias("file_path"), F.array(F.lit("aaa"), F.lit("bbb"), word(kind)).alias("tokens"), F.array(F.lit("src")).alias("path_tokens"), F.array(word(F.col("id") % 7)).alias("keys"))
    calls = spark.range(n).select(F.col("id").alias("node_id"), F.array(word(F.col("id") % 5)).alias("call_tokens"), F.array(word(F.col("id") % 3)).alias("call_keys"))
    found = K.neighbours(nodes, calls, spark.createDataFrame([], "node_id long, peer long"))
    assert most_rows(found) < 30 * n
    rows = nodes.join(calls, "node_id").withColumn("alone", F.col("node_id") % 2 == 0)
    rows = rows.select("node_id", "alone", F.xxhash64("file_path").alias("file_path"), *(F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("tokens", "path_tokens", "call_tokens", "keys", "call_keys")))
    told = lambda block: sorted(map(tuple, K._beside(rows, 4, block).collect()))
    assert told(4096) == told(64)
    assert len(told(64)) == 4 * n


def test_equal_lists_meet_once(spark):
    n = 300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array(*(F.lit(f"word{i}") for i in range(9))).alias("tokens"))
    docs = docs.unionByName(spark.range(n, n + 5).select(F.col("id").alias("doc_id"), F.array(*(F.lit(f"word{i}") for i in range(10))).alias("tokens")))
    found = R.resembling(docs.withColumnRenamed("doc_id", "query_id"), docs, 0.85, 3)
    assert most_rows(found) < 20 * n
    got = {}
    for r in found.orderBy("query_id", F.desc("score"), "doc_id").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 3)))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and got[299] == [(0, 1.0), (1, 1.0), (2, 1.0)] and got[304] == [(300, 1.0), (301, 1.0), (302, 1.0)]
    assert len(got) == n + 5


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have written for others."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lists_that_share_rare_tokens_are_not_moved_as_pairs(spark, monkeypatch):
    """Lists of few words, so that most pairs share one of their rarest: no row is shuffled for a pair that isn't alike."""
    n, rng = 400, random.Random(5)
    lists = {i: sorted(rng.sample([f"word{w}" for w in range(30)], 10)) for i in range(n)}
    for i in range(0, n, 40):  # of eleven tokens one more
        lists[i + 1] = sorted([*lists[i], "another"])
    docs = spark.createDataFrame(list(lists.items()), "doc_id long, tokens array<string>").localCheckpoint()
    wanted = {}
    for q, a in lists.items():
        scored = sorted((-(o / len(a) + o / len(b)) / 2, d) for d, b in lists.items() if d != q and (o := len(set(a) & set(b))) and (o / len(a) + o / len(b)) / 2 >= 0.85)
        wanted |= {(q, d): round(-s, 6) for s, d in scored[:3]}
    told = lambda: {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in R.resembling(docs.withColumnRenamed("doc_id", "query_id"), docs, 0.85, 3).collect()}
    before = shuffled_rows(spark)
    assert told() == wanted and len(wanted) >= 20
    assert shuffled_rows(spark) - before < 20 * n
    monkeypatch.setattr(R, "BLOCK", 300)
    monkeypatch.setattr(R, "LEAST_SHARE", 200)
    assert told() == wanted  # of many blocks and shares


def test_lists_that_are_much_alike_do_not_move_with_every_pair(spark, monkeypatch):
    """A group of near copies: pairs are numbers, and a list's tokens move once, not once a pair."""
    n = 300
    shared = F.array(*(F.lit(f"word{i}") for i in range(20)))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_append(shared, F.concat(F.lit("own"), F.col("id").cast("string"))).alias("tokens")).localCheckpoint()
    told = lambda: sorted((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in R.resembling(docs.withColumnRenamed("doc_id", "query_id"), docs, 0.85, 3).collect())
    wanted = sorted((q, d, round(20 / 21, 6)) for q in range(n) for d in [x for x in range(4) if x != q][:3])
    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables aren't sent to all tasks unasked
    try:
        assert told() == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled_rows(spark) - before < 40 * n
    monkeypatch.setattr(R, "MOST_HELD", 2000)
    assert told() == wanted  # of queries in parts


def test_sparse_vectors_meet_in_tasks(spark):
    n = 300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("red bolt running "), F.col("id") % 7, F.lit("x small"), F.col("id") % 5).alias("text")).unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "none alike")], "doc_id long, text string"))
    asked = R.sparse_postings(spark.createDataFrame([(i, f"red bolt {i}x nothing") for i in range(40)] + [(99, None)], "item_id long, text string"), "item_id", "text")
    plain = lambda d, cosine: R.sparse_scores(asked, R.sparse_postings(d, "doc_id", "text"), "item_id", "doc_id", cosine)
    told = lambda df: {(r["item_id"], r["doc_id"]): round(r["score"], 9) for r in df.collect()}
    found = R.sparse_matches(asked, docs, "item_id", "doc_id", "text", most=3)
    assert most_rows(found) < 20 * n
    whole = told(plain(docs, False))
    wanted = {k: v for i in range(40) for k, v in sorted(((k, v) for k, v in whole.items() if k[0] == i), key=lambda x: (-x[1], x[0]))[:3]}
    assert told(found) == wanted
    assert told(R.sparse_matches(asked, docs, "item_id", "doc_id", "text", cosine=True)) == told(plain(docs, True))
    twice = docs.unionByName(docs.where("doc_id < 3"))
    assert told(R.sparse_matches(asked, twice, "item_id", "doc_id", "text")) == told(plain(twice, False))


def test_rerank_looks_at_texts_once(spark):
    """The tops and the scores of all symbols come from rows that are written, not from texts and calls made again."""
    from lumenfold import registry

    plan = registry.queries()["hybrid_rerank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "l_orderkey" not in plan


def test_affected_tests_are_not_cut_into_runs(spark):
    n = 300
    word = F.concat(F.lit("Widget"), (F.col("id") % 9).cast("string"), F.lit("Bolt"))
    path = F.when(F.col("id") % 2 == 0, F.lit("src/cold_widget.ts")).otherwise(F.concat(F.lit("src/t"), F.col("id"), F.lit(".test.ts")))
    nodes = spark.range(n).select(F.col("id").alias("node_id"), word.alias("name"), word.alias("qualified_name"), path.alias("file_path"), F.lit("function cold()").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.repeat(F.lit("some content of a symbol "), 9).alias("content"))
    nodes = nodes.unionByName(nodes.where("node_id = 1"))
    calls = spark.range(n).select(F.col("id").alias("caller"), F.when(F.col("id") % 5 == 0, "coldCall").otherwise("other").alias("call"))
    changed = spark.createDataFrame([("src/cold_widget.ts",)], "file_path string")
    found = K.affected_tests(nodes, calls, changed, n)
    assert most_rows(found) < 3 * n
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(found) == told(K.affected_tests(nodes, calls, changed, n, held=2))  # more tokens than tasks may hold
    assert found.count() == n // 2
