import json

from pyspark.sql import functions as F

from lumenfold.operators import aggregates, compression, graph, joins, ranking, windows
from lumenfold.plans import query as Q
from lumenfold.sources import code, diffs, session_logs
from lumenfold.streaming import freshness


def test_budget_never_exceeds_and_cuts_one(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(100)], "id long, cost long")
    out = windows.budgeted(rows, ["id"], F.col("cost"), 60, 5, 100).orderBy("rank").collect()
    assert sum(r["used"] for r in out) <= 60
    assert [r["used"] for r in out] == [15, 15, 15, 15]


def test_bm25_ranks_the_document_that_holds_the_terms(spark):
    docs = spark.createDataFrame([(1, "authenticate user password"), (2, "render page"), (3, "user list")], "doc_id long, text string")
    out = ranking.bm25(docs, ["authenticate", "user", "password"]).orderBy(F.desc("score")).collect()
    assert [r["doc_id"] for r in out] == [1, 3]
    assert ranking.bm25(docs, ["xyzzy"]).count() == 0


def test_diversified_covers_new_terms_first(spark):
    rows = spark.createDataFrame([(1, 1.0, ["a", "b"]), (2, 0.9, ["a", "b"]), (3, 0.1, ["c"])], "node_id long, score double, terms array<string>")
    out = ranking.diversified(rows, 10, 10).orderBy("place").collect()
    assert [r["node_id"] for r in out] == [1, 3, 2]


def test_rerank_is_bounded(spark):
    rows = spark.createDataFrame([(1, 2.0, 1.0, 0.5, 3.0, "fresh"), (2, 0.0, 0.0, 0.0, 0.0, None)], "id long, lexical double, semantic double, structure double, merged double, state string")
    out = {r["id"]: r["score"] for r in ranking.reranked(rows, Q.parse("how does auth work")).collect()}
    assert 0 <= out[2] < out[1] <= 1


def test_simple_cycles_once_each(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "source string, target string")
    assert sorted(r["path"] for r in graph.simple_cycles(edges).collect()) == ["a>b", "a>b>c"]


def test_simple_cycles_of_many_vertices(spark):
    for n in (12, 110):
        ring = [(f"v{i:03}", f"v{(i + 1) % n:03}") for i in range(n)]
        assert [r["length"] for r in graph.simple_cycles(spark.createDataFrame(ring, "source string, target string")).collect()] == [n]


def test_impact_steps(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (3, 1)], "caller long, callee long")
    out = {r["node"]: r["steps"] for r in graph.impact(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 2}


def test_merged_scores_and_marginals(spark):
    drafts = spark.createDataFrame([(1, "graph", 1.0), (1, "fts", 0.5), (2, "fts", 0.4)], "node_id long, source string, score double")
    out = {r["node_id"]: r["score"] for r in aggregates.merged(drafts).collect()}
    assert out == {1: 1.75, 2: 0.4}
    feedback = spark.createDataFrame([("compression", "graph", "json", "function"), ("retrieval", "graph", "json", "function")], "stream string, source string, content_type string, kind string")
    rows = aggregates.feedback_marginals(feedback)
    assert rows.count() == 3
    assert {r["adjustment"] for r in compression.policy(rows).collect()} == {"graph-weight", "graph-level", "kind-boost"}


def test_json_arrays_are_crushed_in_proportion(spark):
    rows = spark.createDataFrame([(1, json.dumps(["a b", "c d", "e f", "g h"])), (2, "x " * 10), (3, None)], "id long, body string")
    out = {r["id"]: r["content"] for r in rows.select("id", compression.crushed(F.col("body"), 3).alias("content")).collect()}
    assert json.loads(out[1])["totalItems"] == 4
    assert out[2] == "x x x ... [compressed]"
    assert out[3] is None


def test_important_lines_keep_their_order(spark):
    text = "import x\nplain words here that are long\nfunction go\nTODO later\nmore plain words in this line"
    out = spark.createDataFrame([(text,)], "t string").select(compression.important_lines(F.col("t"), 6).alias("x")).first()["x"]
    assert out.split("\n") == [x for x in text.split("\n") if x in out.split("\n")]
    assert "function go" in out


def test_diff_additions(spark):
    body = "+++ b/src/a.ts\n+import { b } from 'x';\n+export const run = (a: string) => 1\n-gone\n+class P extends Q implements R, S {\n"
    out = {(r["type"], r["name"], r["file_path"]) for r in diffs.additions(spark.createDataFrame([(1, body)], "diff_id long, content string")).collect()}
    assert out == {("import", "x", "src/a.ts"), ("function", "run", "src/a.ts"), ("class", "P", "src/a.ts")}


def test_source_declarations(spark):
    body = "function one(a) {\n  two();\n}\nclass Three {\n  four() { five(); }\n}\n"
    out = {r["name"]: (r["kind"], r["start_line"], r["end_line"], r["calls"]) for r in code.declarations(spark.createDataFrame([("a.ts", body)], "file_path string, content string")).collect()}
    assert out["one"] == ("function", 1, 3, ["two"])
    assert out["Three"][:3] == ("class", 4, 6)


def test_session_logs_of_every_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"toolName": "search", "input": "q", "output": "0 results", "recordedAt": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"logs": [{"tool_name": "review", "recorded_at": 2}]}))
    (tmp_path / "c.jsonl").write_text('{"tool": "x"}\n{"tool": "y"}\nnot json\n')
    out = session_logs.read(spark, str(tmp_path))
    assert sorted(r["tool_name"] for r in out.collect()) == ["review", "search", "x", "y"]


def test_refresh_sets(spark):
    manifest = spark.createDataFrame([("a", "1", "fresh", 1), ("b", "1", "fresh", 1), ("c", "1", "stale", 1), ("gone", "1", "fresh", 1)], "file_path string, content_hash string, state string, n_docs long")
    snapshot = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("new", "1")], "file_path string, content_hash string")
    out = {r["file_path"]: r["action"] for r in freshness.refresh_sets(manifest, snapshot).collect()}
    assert out == {"b": "refresh", "c": "refresh", "new": "refresh", "gone": "remove"}


def test_peers_are_the_first_of_a_key(spark):
    rows = spark.createDataFrame([(i, "k", i) for i in range(12)], "node long, key string, o long")
    out = joins.first_peers(rows, "key", "node", ["o"], 3).where("node = 1").orderBy("rank").collect()
    assert [r["peer"] for r in out] == [0, 2, 3]
