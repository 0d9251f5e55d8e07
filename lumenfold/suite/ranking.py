"""Ranking, vectors and fusion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_CODE, SQL_CODE_CALLS, SQL_MANIFEST, SQL_NODES, SQL_SYMBOLS, Tables
from lumenfold.functions import text as T
from lumenfold.functions import vectors as V
from lumenfold.operators import postings as P
from lumenfold.operators import vector_cells as C
from lumenfold.operators import ranking as R
from lumenfold.operators import search as X
from lumenfold.plans import query as Q
from lumenfold.registry import query
from lumenfold.sources import storage
from lumenfold.suite import sql as S

TARGET = [round(math.cos(i + 1), 6) for i in range(64)]
_TARGET = "[" + ", ".join(f"{x}::DOUBLE" for x in TARGET) + "]"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_TARGET})"
_TERMS = ["the", "and", "der", "que"]


@query(
    "bm25_topk",
    "R05",
    f"""WITH t AS (SELECT doc_id, {S.tokens("text")} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    d AS (SELECT x, count(*) FILTER (list_contains(w, x)) AS df FROM t, (SELECT unnest({S.in_list(_TERMS)}) AS x) GROUP BY x)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(w) / mean)), 6) AS score FROM t, s, d WHERE list_contains(w, x) GROUP BY doc_id, w, n, mean ORDER BY score DESC, doc_id LIMIT 20""",
)
def bm25_topk(t: Tables) -> DataFrame:
    scored = R.bm25(t.documents, _TERMS).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


def _postings(t: Tables) -> P.Postings:
    """The index of `documents`: built once, used again for as long as the files are the same."""
    from lumenfold.sources import storage

    docs = t.documents
    return P.Postings(t.spark, storage.reused("postings", [docs], ("text",), lambda path: P.build(docs, path)))


@query(
    "fts_topk",
    "J03 R05",
    """WITH t AS (SELECT doc_id, source, TOKENS AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    d AS (SELECT x, count(*) FILTER (list_contains(w, x)) AS df FROM t, (SELECT unnest(['small', 'value', 'under', 'que']) AS x) GROUP BY x)
    SELECT doc_id AS node_id, source AS file_path, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(w) / mean)), 6) AS score FROM t, s, d WHERE list_contains(w, x) GROUP BY doc_id, source, w, n, mean
    ORDER BY round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(w) / mean)), 9) DESC, doc_id LIMIT 20""".replace("TOKENS", S.tokens("text")),
)
def fts_topk(t: Tables) -> DataFrame:
    """Any-term hits of the stored index by rank, joined with their nodes."""
    hits = P.search(_postings(t), ["small", "value", "under", "que"], 20).found
    return t.nodes().join(F.broadcast(hits.withColumnRenamed("doc_id", "node_id")), "node_id").select("node_id", "file_path", F.round("score", 6).alias("score"))  # 20 rows


@query(
    "fts_many",
    "J03 R05 F11",
    """WITH t AS (SELECT doc_id, TOKENS AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), p AS (SELECT doc_id, len(w) AS length, unnest(w) AS x FROM t),
    d AS (SELECT x, count(*) AS df FROM p GROUP BY x), q AS (SELECT item_id, unnest(list_sort(TOKENS)[1:16]) AS x FROM benchmark)
    SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))), 9) DESC, doc_id) AS rank
    FROM q JOIN p USING (x) JOIN d USING (x), s GROUP BY item_id, doc_id QUALIFY rank <= 10""".replace("TOKENS", S.tokens("text")),
)
def fts_many(t: Tables) -> DataFrame:
    """The ten best documents for the first sixteen terms of every benchmark item, from the stored index."""
    asked = t.benchmark.select("item_id", F.slice(F.array_sort(T.tokens(F.col("text"))), 1, 16).alias("terms"))
    return P.search_many(_postings(t), asked, 10, "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


#: A query's tokens with stems and synonyms.
_EXPANDED = Q.tokens("ordering the sources of results and testing")


@query("token_cosine", "R06", f"WITH a AS (SELECT doc_id, {S.tokens('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, {S.in_list(_EXPANDED)})) / sqrt({len(_EXPANDED)}.0 * len(w)) END, 6)::DOUBLE AS score FROM a")
def token_cosine(t: Tables) -> DataFrame:
    asked = F.array(*map(F.lit, _EXPANDED))
    return t.documents.select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", F.round(V.token_cosine(asked, F.col("w")), 6).alias("score"))


@query("dense_cosine_topk", "R07 R11", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def dense_cosine_topk(t: Tables) -> DataFrame:
    return R.nearest(t.embeddings, TARGET, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_filtered", "R11 R12 P04", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 5")
def knn_filtered(t: Tables) -> DataFrame:
    return R.nearest(t.embeddings.where("label = 3"), TARGET, 5).select("vec_id", F.round("score", 6).alias("score"))


def _sparse(table: str, key: str) -> str:
    return f"(SELECT {key}, idx, count(*)::DOUBLE AS v FROM (SELECT {key}, CAST(('0x' || left(sha256(t), 8))::UBIGINT % 1000003 AS BIGINT) AS idx FROM (SELECT {key}, unnest({S.tokens('text')}) AS t FROM {table})) GROUP BY ALL)"


@query("sparse_ip", "R09", f"SELECT a.item_id, b.doc_id, sum(a.v * b.v) AS score FROM {_sparse('benchmark', 'item_id')} a JOIN {_sparse('documents', 'doc_id')} b USING (idx) GROUP BY a.item_id, b.doc_id QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY sum(a.v * b.v) DESC, b.doc_id) <= 10")
def sparse_ip(t: Tables) -> DataFrame:
    """The ten documents of largest inner product for each benchmark item."""
    return R.sparse_matches(R.sparse_postings(t.benchmark, "item_id", "text"), t.documents, "item_id", "doc_id", "text", most=10)


@query("sparse_cosine", "R08", f"WITH s AS (SELECT * FROM {_sparse('documents', 'doc_id')}), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1), f AS (SELECT * FROM {_sparse('benchmark', 'item_id')} WHERE item_id = 0) SELECT s.doc_id, round(sum(s.v * f.v) / (any_value(n.norm) * (SELECT sqrt(sum(v * v)) FROM f)), 6) AS score FROM s JOIN f USING (idx) JOIN n ON n.doc_id = s.doc_id GROUP BY s.doc_id")
def sparse_cosine(t: Tables) -> DataFrame:
    """All documents by cosine with the first benchmark item, those that share nothing with it aside."""
    asked = R.sparse_postings(t.benchmark.where("item_id = 0"), "item_id", "text")
    found = R.sparse_matches(asked, t.documents, "item_id", "doc_id", "text", cosine=True)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("local_embedding", "R10", f"WITH b AS (SELECT p_partkey, CAST(('0x' || left(sha256('dense:' || t), 8))::UBIGINT % 64 AS BIGINT) AS bucket FROM (SELECT p_partkey, unnest({S.tokens('p_name')}) AS t FROM part)), c AS (SELECT p_partkey, bucket, count(*) AS n FROM b GROUP BY ALL) SELECT p_partkey, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 6) AS weight FROM c")
def local_embedding(t: Tables) -> DataFrame:
    return R.local_embedding(t.part, "p_partkey", "p_name").withColumn("weight", F.round("weight", 6))


@query("knn_quantised", "R11", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def knn_quantised(t: Tables) -> DataFrame:
    """Approximate neighbours: a byte a component is scanned, the best are scored exactly. SQL scans all vectors exactly."""
    return R.nearest_quantised(R.quantised(t.embeddings), t.embeddings, TARGET, 10).select("vec_id", F.round("score", 6).alias("score"))


def _cells(t: Tables) -> C.Cells:
    """The index of `embeddings`: built once, used again for as long as the files are the same."""
    from lumenfold.sources import storage

    vectors = t.embeddings
    return C.Cells(t.spark, storage.reused("vector-cells", [vectors], (), lambda path: C.build(vectors, path)))


@query("vector_cells_knn", "R11 R07", f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def vector_cells_knn(t: Tables) -> DataFrame:
    """The ten nearest of all vectors, from the cells that can hold them."""
    return C.nearest(_cells(t), TARGET, 10).select("vec_id", "label", F.round("score", 6).alias("score"))


_PAIR_COS = "CASE WHEN len(q.embedding) = len(e.embedding) AND list_dot_product(q.embedding, q.embedding) > 0 AND list_dot_product(e.embedding, e.embedding) > 0 THEN list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) ELSE 0 END"


@query("vector_cells_batch", "R11 R07", f"SELECT q.vec_id AS query_id, e.vec_id, round({_PAIR_COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_PAIR_COS}, 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10")
def vector_cells_batch(t: Tables) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id 20 divides, exactly."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return C.nearest_of_all(_cells(t), asked, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("vector_cells_approximate", "R11")
def vector_cells_approximate(t: Tables) -> DataFrame:
    """The same from as few cells as find 95 % of the neighbours of other vectors (a test holds its recall)."""
    index, known = _cells(t), t.embeddings
    visit = C.visits_for(index, known.where("vec_id % 50 = 7").orderBy(F.xxhash64("vec_id")).limit(200).select(F.col("vec_id").alias("query_id"), "embedding"), 10, 0.95)
    asked = known.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return C.nearest_of_all(index, asked, 10, visit).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_ALL_KNOWN = S.normalized("concat_ws(' ', name, qualified_name, file_path, signature, docstring, content)")


@query(
    "graph_score",
    "R03",
    f"""WITH n AS (SELECT *, {S.normalized("name")} AS flat, {S.normalized("qualified_name")} AS whole, {S.normalized("regexp_extract(qualified_name, '([^:.#]*)$', 1)")} AS tail FROM {SQL_CODE})
    SELECT node_id, round(len(list_filter(['cold', 'ring', 'small', 'the', 'widget'], lambda t: contains({_ALL_KNOWN}, t))) / 5.0 + CASE WHEN contains(lower(name), 'gear') THEN 0.4 ELSE 0 END
      + CASE WHEN flat = 'small ring' THEN 50 WHEN whole = 'small ring' OR tail = 'small ring' THEN 35 WHEN contains(whole, '::small ring') OR suffix(whole, 'small ring') THEN 20 ELSE 0 END + CASE WHEN flat = 'small ring' AND kind IN ('class', 'interface') THEN 12 ELSE 0 END, 6)::DOUBLE AS score FROM n""",
)
def graph_score(t: Tables) -> DataFrame:
    """Terms in all that is known of a symbol, a name filter, and the bonuses of a query with one exact symbol."""
    asked = Q.parse("the cold widget SmallRing name:gear")
    known = {c: F.col(c) for c in ("signature", "docstring", "content", "kind")}
    return t.code().select("node_id", F.round(R.graph_score(F.col("name"), F.col("qualified_name"), F.col("file_path"), asked, **known), 6).alias("score"))


_LQ = Q.parse("the small and old")


@query("lexical_score", "R04", "SELECT doc_id, round((" + " + ".join(f"CASE WHEN contains(lower(text), '{x}') THEN 1 ELSE 0 END" for x in _LQ.terms) + f") / {len(_LQ.terms)}.0, 6)::DOUBLE AS score FROM documents")
def lexical_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(R.lexical_score(F.col("text"), _LQ), 6).alias("score"))


@query("route_weighted", "R14", "SELECT node_id, source, round(score * CASE source WHEN 'vector' THEN 1.35 ELSE 1.0 END, 6)::DOUBLE AS score FROM (SELECT p_partkey AS node_id, CASE p_partkey % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'vector' ELSE 'fts' END AS source, p_size / 50.0::DOUBLE AS score FROM part)")
def route_weighted(t: Tables) -> DataFrame:
    source = F.when(F.col("p_partkey") % 3 == 0, "graph").when(F.col("p_partkey") % 3 == 1, "vector").otherwise("fts")
    weight = F.coalesce(*(F.when(F.col("source") == k, F.lit(v)) for k, v in Q.ROUTE_WEIGHTS["vector-first"].items()))
    return t.part.select(F.col("p_partkey").alias("node_id"), source.alias("source"), (F.col("p_size") / 50.0).alias("s")).select("node_id", "source", F.round(F.col("s") * weight, 6).alias("score"))


_BQ = Q.parse("cold widget economy how")
_HAS = lambda x: f"len(list_intersect({S.in_list(_BQ.terms)}, {S.tokens(x)}))"


@query(
    "merge_scored",
    "R17 A06",
    f"""WITH d AS (SELECT node_id, 'graph' AS source, 0.5::DOUBLE AS s FROM {SQL_CODE} WHERE contains(lower(name), 'cold') UNION ALL SELECT node_id, 'fts', 0.25 FROM {SQL_CODE} WHERE contains(signature, 'Widget') UNION ALL SELECT node_id, 'vector', 0.125 FROM {SQL_CODE} WHERE docstring IS NULL), m AS (SELECT node_id, sum(s) + 0.25 * (count(*) - 1) AS score FROM d GROUP BY 1)
    SELECT node_id, round(score + least(1.2, {_HAS("concat_ws(' ', file_path, qualified_name, content)")} / {len(_BQ.terms)} * 0.35 + {_HAS("concat_ws(' ', file_path, qualified_name)")} / {len(_BQ.terms)} * 0.5), 6)::DOUBLE AS score FROM m JOIN {SQL_CODE} USING (node_id)""",
)
def merge_scored(t: Tables) -> DataFrame:
    """Candidates of three branches by node, with what a broad query adds."""
    from lumenfold.operators import aggregates

    assert _BQ.route == "hybrid"
    code = t.code()
    part = lambda cond, s, v: code.where(cond).select("node_id", F.lit(s).alias("source"), F.lit(v).alias("score"))
    drafts = part("contains(lower(name), 'cold')", "graph", 0.5).unionByName(part("contains(signature, 'Widget')", "fts", 0.25)).unionByName(part("docstring is null", "vector", 0.125))
    rows = aggregates.merged(drafts).join(code.select("node_id", "file_path", "qualified_name", "content"), "node_id")
    return rows.select("node_id", F.round(F.col("score") + R.broad_boost(_BQ, F.col("file_path"), F.col("qualified_name"), F.col("content")), 6).alias("score"))


_HQ = Q.parse("how does cold widget ranking relate")
_N = len(_HQ.terms)
_IN = lambda x: "(" + " + ".join(f"CASE WHEN contains({x}, '{t}') THEN 1 ELSE 0 END" for t in _HQ.terms) + ")"


@query(
    "hybrid_rerank",
    "R19 R20 R21 R22 A13",
    f"""WITH c AS (SELECT caller AS node_id, list_sort(list(DISTINCT call)) AS calls FROM {SQL_CODE_CALLS} GROUP BY 1), r AS (SELECT n.node_id, {_IN("lower(content)")} / {_N}.0 AS lexical, len(list_intersect({S.in_list(_HQ.terms)}, {S.tokens("content")})) / sqrt({_N}.0 * len({S.tokens("content")})) AS semantic, {_IN(S.normalized("concat_ws(' ', name, file_path)"))} / {_N}.0 AS graph,
      least(1.0, {_IN(S.normalized("concat_ws(' ', file_path, qualified_name)"))} / {_N}.0 * 0.55 + coalesce({_IN(S.normalized("array_to_string(calls, ' ')"))}, 0) / {_N}.0 * 0.2) AS structure, CASE n.node_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN 'pending' WHEN 2 THEN 'stale' WHEN 3 THEN 'failed' END AS state FROM {SQL_CODE} n LEFT JOIN c USING (node_id)),
    x AS (SELECT max(lexical) AS l, max(semantic) AS s, max(graph) AS g FROM r)
    SELECT node_id, round((lexical / l * {_HQ.features["lexical"]} + semantic / s * {_HQ.features["semantic"]} + least(1.0, structure * 0.5 + graph / g * 0.5) * {_HQ.features["structure"]} + CASE state WHEN 'fresh' THEN 1.0 WHEN 'pending' THEN 0.45 WHEN 'stale' THEN 0.15 WHEN 'failed' THEN 0.0 ELSE {Q.UNKNOWN_STATE} END * {_HQ.features["freshness"]}) * {1 - Q.PRIOR_WEIGHTS[_HQ.route]} + graph / g * {Q.PRIOR_WEIGHTS[_HQ.route]}, 6)::DOUBLE AS score FROM r, x""",
)
def hybrid_rerank(t: Tables) -> DataFrame:
    """All symbols by four features of a query: words, token cosine, structure with its graph score, freshness."""
    terms, n = list(_HQ.terms), F.col("node_id") % 5
    state = F.when(n == 0, "fresh").when(n == 1, "pending").when(n == 2, "stale").when(n == 3, "failed")
    # texts are looked at once: the tops of all symbols are read from what is written of each
    rows = t.code().join(t.said(), "node_id", "left").withColumn("tokens", T.tokens(F.col("content"))).select(
        "node_id",
        R.lexical_score(F.col("content"), _HQ).alias("lexical"),
        V.token_cosine(F.array(*map(F.lit, terms)), F.col("tokens")).alias("semantic"),
        (T.matched_terms(T.normalized(F.concat_ws(" ", "name", "file_path")), terms) / len(terms)).alias("merged"),
        R.structure_score(_HQ, F.col("file_path"), F.col("qualified_name"), F.coalesce("calls", F.array().cast("array<string>"))).alias("own"),
        state.alias("state"),
    )
    rows = storage.kept(t.spark, rows)
    top = rows.agg(F.max("merged").alias("__g"))  # one row
    rows = rows.join(F.broadcast(top)).withColumn("structure", F.least(F.lit(1.0), F.col("own") * 0.5 + F.coalesce(F.try_divide("merged", "__g"), F.lit(0.0)) * 0.5)).drop("__g", "own")
    return R.reranked(rows, _HQ).select("node_id", F.round("score", 6).alias("score"))


@query(
    "dense_dedup_check",
    "R28 R07 J05",
    f"""WITH v AS (SELECT vec_id AS node_id, label, CAST(embedding AS DOUBLE[]) AS e, {S.words("coalesce(source, '') || ' ' || coalesce(lang, '')")} AS meta, {S.words("text")} AS w FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
    n AS (SELECT q.node_id AS query_id, v.node_id, list_cosine_similarity(v.e, q.e) AS score, coalesce(q.w, []) AS asked, v.meta, v.w FROM v JOIN v q ON v.label = q.label AND q.node_id % 20 = 0 AND v.node_id <> q.node_id QUALIFY row_number() OVER (PARTITION BY q.node_id ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.node_id) <= 5),
    s AS (SELECT query_id, node_id, CASE WHEN w IS NOT NULL AND coalesce((coalesce(len(list_intersect(asked, meta)) / nullif(len(asked), 0), 0) + coalesce(len(list_intersect(asked, meta)) / nullif(len(meta), 0), 0)) / 2, 0) < 0.15 THEN least(score, coalesce(least(1, (coalesce(len(list_intersect(asked, w)) / nullif(len(asked), 0), 0) + coalesce(len(list_intersect(asked, w)) / nullif(len(w), 0), 0)) / 2), 0)) ELSE score END AS score FROM n WHERE score >= 0.15)
    SELECT query_id, node_id, round(score, 6) AS score FROM s WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) <= 3""",
)
def dense_dedup_check(t: Tables) -> DataFrame:
    """For every vector whose id 20 divides, the three of its label most like it, checked against texts."""
    docs = t.documents.select(F.col("doc_id").alias("node_id"), "source", "lang", "text")
    known = t.embeddings.select(F.col("vec_id").alias("node_id"), "label", "embedding").join(docs, "node_id", "left")
    meta = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    vectors = known.select("node_id", "label", "embedding", T.words(meta).alias("tokens"))
    asked = known.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "label", "embedding", F.coalesce(T.words(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    texts = docs.select("node_id", T.words(F.col("text")).alias("tokens"))
    return R.dense_duplicates(asked, vectors, texts, 0.15, 3).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query("coverage_diversify", "R23")
def coverage_diversify(t: Tables) -> DataFrame:
    """Ten of the best forty documents, new terms first; those of one source are anchors."""
    terms = F.array_intersect(T.words(F.col("text")), F.array(*map(F.lit, ["the", "and", "of", "der", "que", "la", "les"])))
    rows = t.documents.select(F.col("doc_id").alias("node_id"), "source", terms.alias("terms"))
    return R.diversified(rows.select("node_id", (F.size("terms") / 7.0).alias("score"), "terms", (F.col("source") == "src1").alias("is_anchor")), 40, 10)


@query(
    "dedup_check",
    "R28 R29",
    f"""WITH d AS (SELECT doc_id, {S.words("text")} AS w FROM documents), q AS (SELECT doc_id AS query_id, w AS bw FROM d WHERE doc_id % 20 = 0 AND len(w) > 0),
    p AS (SELECT query_id, doc_id, least(1.0, (len(list_intersect(bw, w)) / len(bw) + len(list_intersect(bw, w)) / len(w)) / 2) AS score FROM q, d WHERE len(w) > 0 AND doc_id <> query_id)
    SELECT query_id, doc_id, round(score, 6) AS score FROM p WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5""",
)
def dedup_check(t: Tables) -> DataFrame:
    """For every document whose id 20 divides, the five documents most like it, at 0.85 or more."""
    docs = t.documents.select("doc_id", T.words(F.col("text")).alias("tokens"))
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return R.resembling(asked, docs, 0.85, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("semantic_content", "R26", f"SELECT node_id, name || ' ' || array_to_string(list_sort(list_filter({S.tokens('qualified_name')}, lambda x: NOT contains(lower(name), x)))[1:8], ' ') AS content FROM {SQL_SYMBOLS}")
def semantic_content(t: Tables) -> DataFrame:
    extra = F.slice(F.filter(T.tokens(F.col("qualified_name")), lambda x: ~F.lower("name").contains(x)), 1, 8)
    return t.symbols().select("node_id", F.concat("name", F.lit(" "), F.array_join(extra, " ")).alias("content"))


@query("family_scores", "R32", f"SELECT file_path, CAST(sum(CASE WHEN contains(name, 'cold') THEN 2 WHEN contains(name, 'widget') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM {SQL_SYMBOLS} GROUP BY file_path")
def family_scores(t: Tables) -> DataFrame:
    value = F.when(F.col("name").contains("cold"), 2).when(F.col("name").contains("widget"), 1).otherwise(0)
    return t.symbols().groupBy("file_path").agg(F.sum(value).alias("score"))


@query(
    "annotate_rules",
    "R33",
    """WITH d AS (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' import { cloneDeep } from lodash' WHEN 1 THEN ' fs-extra: remove()' WHEN 2 THEN ' fs-extra only' ELSE '' END) AS t FROM documents)
    SELECT doc_id, 'stdlib-replacement' AS type, 'suggestion' AS severity FROM d WHERE contains(t, 'lodash') AND contains(t, 'clonedeep')
    UNION ALL SELECT doc_id, 'native-replacement', 'suggestion' FROM d WHERE contains(t, 'fs-extra') AND regexp_matches(t, '\\b(copy|remove|mkdir|readjson|writejson)\\b')
    UNION ALL SELECT doc_id, 'licence', 'notice' FROM d WHERE contains(t, 'license')""",
)
def annotate_rules(t: Tables) -> DataFrame:
    """What rules say of documents, each with a line of code of one kind or none after it: the given rules, and one of our own."""
    n = F.col("doc_id") % 4
    line = F.when(n == 0, " import { cloneDeep } from lodash").when(n == 1, " fs-extra: remove()").when(n == 2, " fs-extra only").otherwise("")
    rows = t.documents.select(F.col("doc_id").alias("node_id"), F.concat("text", line).alias("content"))
    found = R.annotated(rows, [*R.RULES, R.Rule("licence", "notice", "Names a licence.", ("license",))])
    return found.select(F.col("node_id").alias("doc_id"), "type", "severity")


#: Terms of the searched texts below, as their words say: no stem or synonym but `rank` and `doe` is added.
_ABOUT = ["and", "des", "function", "in", "of", "rank", "ranking", "similar", "src1", "the"]
_HOW = ["and", "der", "doe", "does", "function", "how", "relate", "src1", "the", "to"]


def _search_sql(terms: list[str], sparse: bool, vector_weight: float, features: tuple[float, float, float, float], prior: float, nodes: str) -> str:
    """A search for ten rows of 8000 tokens up to its order: r has node_id, file_path, content, score and cost."""
    listed = S.in_list(terms)
    share = lambda x: f"len(list_filter({listed}, lambda t: contains({x}, t))) / 10.0::DOUBLE"
    cut = lambda source, table, n, w: f"(SELECT node_id, '{source}' AS source, score * {w}::DOUBLE AS score FROM {table} WHERE score > 0 ORDER BY round({table}.score, 9) DESC, node_id LIMIT {n})"
    lines = "string_split_regex(content, '\\r?\\n')"
    head = f"CASE WHEN len({lines}) <= 22 THEN content ELSE array_to_string({lines}[1:22], chr(10)) || chr(10) || '... truncated ' || CAST(len({lines}) - 22 AS VARCHAR) || ' lines' END"
    part = lambda c: f"CASE WHEN max({c}) OVER () > 0 THEN greatest({c}, 0) / max({c}) OVER () ELSE 0 END"
    a, b, c, d = features
    sparse_list = f"UNION ALL {cut('vector', 'sparse', 20, 1)}" if sparse else ""
    return f"""WITH n AS (SELECT * FROM {nodes}), q AS (SELECT unnest({listed}) AS x),
    fts AS (SELECT node_id, {share(S.normalized("content"))} AS score FROM n), graph AS (SELECT node_id, {share(S.normalized("concat_ws(' ', name, qualified_name, file_path, signature, docstring, array_to_string(calls, ' '), content)"))} AS score FROM n),
    w AS (SELECT node_id, unnest({S.tokens("content")}) AS x FROM n),
    qd AS (SELECT bucket, k / sqrt(sum(k * k) OVER ()) AS weight FROM (SELECT ('0x' || left(sha256('dense:' || x), 8))::UBIGINT % 64 AS bucket, count(*) AS k FROM q GROUP BY 1)),
    e AS (SELECT node_id, bucket, k / sqrt(sum(k * k) OVER (PARTITION BY node_id)) AS weight FROM (SELECT node_id, ('0x' || left(sha256('dense:' || x), 8))::UBIGINT % 64 AS bucket, count(*) AS k FROM w GROUP BY ALL)),
    dense AS (SELECT node_id, sum(e.weight * qd.weight) AS score FROM e JOIN qd USING (bucket) GROUP BY node_id),
    sparse AS (SELECT node_id, sum(v * k)::DOUBLE AS score FROM (SELECT node_id, ('0x' || left(sha256(x), 8))::UBIGINT % 1000003 AS idx, count(*) AS v FROM w GROUP BY ALL) JOIN (SELECT ('0x' || left(sha256(x), 8))::UBIGINT % 1000003 AS idx, count(*) AS k FROM q GROUP BY 1) USING (idx) GROUP BY node_id),
    vector AS (SELECT node_id, max(score) AS score FROM ({cut("vector", "dense", 20, 1)} {sparse_list}) GROUP BY node_id),
    d AS ({cut("graph", "graph", 60, 1)} UNION ALL {cut("fts", "fts", 60, 1)} UNION ALL {cut("vector", "vector", 20, vector_weight)}),
    m AS (SELECT node_id, sum(score) + 0.25 * (count(*) - 1) AS merged, coalesce(max(score) FILTER (source = 'fts'), 0) AS fts, coalesce(max(score) FILTER (source = 'vector'), 0) AS vector, coalesce(max(score) FILTER (source = 'graph'), 0) AS graph FROM d GROUP BY node_id ORDER BY round(sum(score) + 0.25 * (count(*) - 1), 9) DESC, node_id LIMIT 80),
    h AS (SELECT n.*, m.* EXCLUDE (node_id), {S.tokens("concat_ws(' ', content, file_path, qualified_name, array_to_string(calls, ' '))")} AS said FROM m JOIN n USING (node_id)), s AS (SELECT count(*) AS n, avg(len(said)) AS mean FROM h), df AS (SELECT x, count(*) FILTER (list_contains(said, x)) AS df FROM h, q GROUP BY x),
    bm AS (SELECT node_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1)) * any_value(2.2 / (1 + 1.2 * (0.25 + 0.75 * len(said) / mean))) AS bm25 FROM h, s, df WHERE list_contains(said, x) GROUP BY node_id),
    f AS (SELECT h.*, greatest(coalesce(bm25, 0), fts) AS lexical, greatest(len(list_intersect(said, {listed})) / sqrt(10.0 * len(said)), vector) AS semantic,
      least(1.0, (least(1.0, {share(S.normalized("concat_ws(' ', file_path, qualified_name)"))} * 0.55 + {share(S.normalized("array_to_string(calls, ' ')"))} * 0.2)) * 0.5 + CASE WHEN max(graph) OVER () > 0 THEN graph / max(graph) OVER () ELSE 0 END * 0.5) AS structure FROM h LEFT JOIN bm USING (node_id)),
    r AS (SELECT f.node_id, f.file_path, content, {S.token_estimate(head)} AS cost, ({part("lexical")} * {a} + {part("semantic")} * {b} + structure * {c} + CASE state WHEN 'fresh' THEN 1.0 WHEN 'pending' THEN 0.45 WHEN 'stale' THEN 0.15 WHEN 'failed' THEN 0.0 ELSE 0.6 END * {d}) * {1 - prior} + {part("merged")} * {prior} AS score FROM f LEFT JOIN (SELECT doc_id AS node_id, state FROM {SQL_MANIFEST}) USING (node_id))"""


_BUDGETED = """, k AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {rows}), x AS (SELECT *, 8000 - coalesce(sum(cost + 5) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM k WHERE rank <= 10)
    SELECT node_id, file_path, round(score, 6)::DOUBLE AS score, rank, CAST(least(cost + 5, remaining) AS BIGINT) AS used FROM x WHERE remaining > 5"""
_RANKED = _BUDGETED.format(order="round(score, 9) DESC, file_path, node_id", rows="r")

#: Greedy coverage as a recursion over steps: each takes the row with most terms not yet covered, then the best score, then the smallest id.
_COVERED = """, c AS (SELECT *, list_filter({terms}, lambda t: contains(lower(content), t)) AS has FROM r ORDER BY score DESC, node_id LIMIT 20),
    g(step, taken, covered) AS (SELECT 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) UNION ALL
      SELECT step + 1, list_append(taken, pick.node_id), list_concat(covered, pick.has) FROM (SELECT g.*, (SELECT arg_max({{'node_id': node_id, 'has': has}}, (len(list_filter(has, lambda t: NOT list_contains(g.covered, t))), score, -node_id)) FROM c WHERE NOT list_contains(g.taken, c.node_id)) AS pick FROM g) WHERE step < 10 AND pick IS NOT NULL),
    o AS (SELECT unnest(taken) AS node_id, generate_subscripts(taken, 1) AS place FROM g QUALIFY step = max(step) OVER ()), y AS (SELECT c.*, place FROM c JOIN o USING (node_id))"""

_DOC_NODES = f"(SELECT node_id, kind, file_path, language, content, '' AS name, '' AS qualified_name, '' AS signature, '' AS docstring, CAST([] AS VARCHAR[]) AS calls FROM {SQL_NODES})"
_CODE_NODES = f"(SELECT n.* REPLACE (coalesce(docstring, '') AS docstring), coalesce(c.calls, CAST([] AS VARCHAR[])) AS calls FROM {SQL_CODE} n LEFT JOIN (SELECT caller AS node_id, list_sort(list(DISTINCT call)) AS calls FROM {SQL_CODE_CALLS} GROUP BY 1) c USING (node_id))"


def _states(t: Tables) -> DataFrame:
    return t.manifest().select(F.col("doc_id").alias("node_id"), "state")


def _code_nodes(t: Tables) -> DataFrame:
    said = t.code_calls().groupBy(F.col("caller").alias("node_id")).agg(F.array_sort(F.collect_set("call")).alias("calls"))
    return t.code().join(said, "node_id", "left")


@query("search_pipeline", "L02 L03 L04 R05 R13 R14 R19 R20 W09 U01 A06 P01", _search_sql(_ABOUT, True, 1.35, (0.18, 0.52, 0.22, 0.08), 0.1, _DOC_NODES) + _RANKED)
def search_pipeline(t: Tables) -> DataFrame:
    """The whole query over documents: parse, route, three branches (vectors dense and sparse, as the intent says), merge, rerank, budget."""
    return X.search(t.nodes(), _states(t), X.index(t.nodes()), "similar ranking of the function in src1 and des")


@query("search_hybrid", "R13 R23 R24 L04", _search_sql(_HOW, False, 1.0, (0.22, 0.18, 0.5, 0.1), 0.2, _DOC_NODES).replace("WITH n", "WITH RECURSIVE n", 1) + _COVERED.format(terms=S.in_list(_HOW)) + _BUDGETED.format(order="place", rows="y"))
def search_hybrid(t: Tables) -> DataFrame:
    """A query on the hybrid route, whose window is reordered so that new terms are covered first."""
    return X.search(t.nodes(), _states(t), X.index(t.nodes()), "how does the function relate to src1 and der")


@query("search_symbols", "R03 R13 R19 R20", _search_sql(["and", "cold", "gear", "rank", "ranking", "ring", "similar", "small", "src", "the"], True, 1.35, (0.18, 0.52, 0.22, 0.08), 0.1, _CODE_NODES) + _RANKED)
def search_symbols(t: Tables) -> DataFrame:
    """The same over source symbols, with their names, signatures, documentation and calls."""
    nodes = _code_nodes(t)
    return X.search(nodes, _states(t), X.index(nodes), "similar ranking the small cold gear and ring src")


def _vectors_sql(sparse: bool, dense: bool) -> str:
    lists = " UNION ALL ".join(f"(SELECT * FROM {x} ORDER BY round(score, 9) DESC, node_id LIMIT 15)" for x, use in (("dense", dense), ("sparse", sparse)) if use)
    return _search_sql(_HOW, True, 1.0, (0, 0, 0, 0), 0.0, _DOC_NODES).split(",\n    vector AS")[0] + f" SELECT node_id, round(max(score), 6) AS score FROM ({lists}) GROUP BY node_id ORDER BY round(max(score), 9) DESC, node_id LIMIT 15"


def _vector_query(t: Tables, mode: str) -> DataFrame:
    return X.vector_hits(X.index(t.nodes()), _HOW, 15, mode).select("node_id", F.round("score", 6).alias("score"))


@query("vector_hits_dense", "R11 R13", _vectors_sql(False, True))
def vector_hits_dense(t: Tables) -> DataFrame:
    return _vector_query(t, "dense")


@query("vector_hits_sparse", "R09 R11 R13", _vectors_sql(True, False))
def vector_hits_sparse(t: Tables) -> DataFrame:
    return _vector_query(t, "sparse")


@query("vector_hits_hybrid", "R11 R13 A14", _vectors_sql(True, True))
def vector_hits_hybrid(t: Tables) -> DataFrame:
    """Both lists, the better score of each node."""
    return _vector_query(t, "hybrid")
