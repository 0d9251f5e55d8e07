"""A query from text to ranked, budgeted rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions import vectors as V
from lumenfold.operators import aggregates, ranking, scans, windows
from lumenfold.plans import query as Q
from lumenfold.sources import storage

#: What a symbol may have besides node_id, kind, file_path, language and content.
_TEXTS = ("name", "qualified_name", "signature", "docstring")


def completed(nodes: DataFrame) -> DataFrame:
    """nodes with names, signatures, documentation (empty where they have none) and calls (an array)."""
    for c in _TEXTS:
        nodes = nodes.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in nodes.columns else F.lit(""))
    return nodes.withColumn("calls", F.coalesce(F.col("calls"), F.array().cast("array<string>")) if "calls" in nodes.columns else F.array().cast("array<string>"))


@dataclass
class VectorIndex:
    """Entries of dense vectors (node_id, bucket, weight) and sparse ones (node_id, idx, v)."""

    dense: DataFrame
    sparse: DataFrame


def _counted(entry: str, value: str, unit: bool):
    """A function for tasks: rows of an id and an array of numbers become a row an id and number with how often it
    stands there, divided by the length of all that an id has if `unit`."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for rows in batches:
            key, items = rows.columns
            sizes = rows[items].str.len().to_numpy(int)
            if not sizes.sum():
                continue
            flat = np.concatenate(rows[items].to_list()).astype(np.int64)
            pairs, n = np.unique((np.repeat(np.arange(len(rows)), sizes) << 32) | flat, return_counts=True)
            at, n = pairs >> 32, n.astype(float)
            if unit:
                n = n / np.sqrt(np.bincount(at, n * n, len(rows)))[at]
            yield pd.DataFrame({key: rows[key].to_numpy()[at], entry: pairs & 0xFFFFFFFF, value: n})

    return run


def index(nodes: DataFrame) -> VectorIndex:
    """What vector search needs of nodes (node_id, content): built once, used again until their files change."""
    spark = nodes.sparkSession

    def build(path: str) -> None:
        # each text is cut into tokens once; what is counted of it stays in its task
        told = nodes.where("content is not null").select("node_id", T.tokens(F.col("content")).alias("tokens"))
        bucket = lambda t: F.pmod(T.hash32(F.concat(F.lit("dense:"), t)), F.lit(ranking.DIMENSION)).cast("int")
        hashed = told.select("node_id", F.transform("tokens", bucket).alias("buckets"), F.transform("tokens", lambda t: F.pmod(T.hash32(t), F.lit(ranking.HASH_SPACE)).cast("int")).alias("idx"))
        hashed = storage.kept(spark, hashed)
        if not hashed.groupBy("node_id").count().where("count > 1").isEmpty():  # rows of one id count as one
            hashed = hashed.groupBy("node_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("buckets", "idx")))
        key = hashed.schema["node_id"].dataType.simpleString()
        dense = hashed.select("node_id", "buckets").mapInPandas(_counted("bucket", "weight", True), f"node_id {key}, bucket bigint, weight double")
        dense.sortWithinPartitions("bucket").write.parquet(f"{path}/dense")
        sparse = hashed.select("node_id", "idx").mapInPandas(_counted("idx", "v", False), f"node_id {key}, idx bigint, v double")
        sparse.sortWithinPartitions("idx").write.parquet(f"{path}/sparse")

    path = storage.reused("search-vectors", [nodes.select("node_id", "content")], (ranking.DIMENSION, ranking.HASH_SPACE), build)
    return VectorIndex(spark.read.parquet(f"{path}/dense"), spark.read.parquet(f"{path}/sparse"))


def _asked_sparse(terms: list[str]) -> dict[int, float]:
    """`ranking.sparse_postings` of a query's terms, on the driver."""
    out: dict[int, float] = {}
    for t in terms:
        idx = int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % ranking.HASH_SPACE
        out[idx] = out.get(idx, 0.0) + 1.0
    return out


def vector_hits(vectors: VectorIndex, terms: list[str], k: int, mode: str = "hybrid", only: DataFrame | None = None) -> DataFrame:
    """node_id and score of the k best: by cosine of dense vectors, by inner product of sparse ones, or from both lists, by
    the better score of each node. What is among the k best of the two is among the k best of one of them.

    only: node_id of what may be found, if not all."""
    best = lambda df: df.orderBy(F.desc(F.round("score", 9)), "node_id").limit(k)
    held = lambda df: df if only is None else df.join(only.select("node_id"), "node_id", "left_semi")
    lists = []
    if mode in ("sparse", "hybrid"):
        asked = _asked_sparse(terms)
        weight = F.create_map(*[F.lit(x) for kv in sorted(asked.items()) for x in kv])
        rows = vectors.sparse.where(F.col("idx").isin(sorted(asked)))
        lists.append(best(held(rows.groupBy("node_id").agg(F.sum(F.col("v") * F.element_at(weight, F.col("idx").cast("int"))).alias("score")))))
    if mode in ("dense", "hybrid"):
        lists.append(best(held(ranking.embedding_scores(vectors.dense, ranking.asked_embedding(terms), "node_id"))))
    if not lists:
        raise ValueError(f"no such mode: {mode}")
    return lists[0] if len(lists) == 1 else best(lists[0].unionByName(lists[1]).groupBy("node_id").agg(F.max("score").alias("score")))


def candidates(nodes: DataFrame, vectors: VectorIndex, query: Q.Query, topk: int) -> DataFrame:
    """node_id, source, score: the best of each branch, by its limit, weighed by the route. nodes: `completed`."""
    limits = {k: v * topk for k, v in Q.CANDIDATES.items()}
    cut = lambda df, source: df.where("score > 0").orderBy(F.desc(F.round("score", 9)), "node_id").limit(limits[source]).select("node_id", F.lit(source).alias("source"), (F.col("score") * query.weights[source]).alias("score"))
    column = {c: F.col(c) for c in ("signature", "docstring", "calls", "kind")}
    graph = ranking.graph_score(F.col("name"), F.col("qualified_name"), F.col("file_path"), query, flat_content=F.col("__flat"), **column)
    # texts are read and normalised once for both branches
    told = nodes.withColumn("__flat", T.normalized(F.col("content"))).select("node_id", graph.alias("graph"), ranking.lexical_score(F.col("__flat"), query).alias("fts"))
    told = storage.kept(nodes.sparkSession, told)
    out = cut(told.select("node_id", F.col("graph").alias("score")), "graph")
    if query.anchors_only:
        return out
    out = out.unionByName(cut(told.select("node_id", F.col("fts").alias("score")), "fts"))
    if query.terms:
        hits = vector_hits(vectors, list(query.terms), limits["vector"], query.vector_mode, nodes if query.filters else None)
        out = out.unionByName(cut(hits, "vector"))
    return out


def window_features(rows: DataFrame, query: Q.Query) -> DataFrame:
    """rows (a search's window, `completed`, with source_scores) with lexical, semantic and structure.

    Words: BM25 of the query's own tokens among the window's rows, or what the text branch said, if more. Meaning: cosine
    of expanded and held tokens, or what the vector branch said. Structure: half its own, half the graph branch's share of the largest."""
    said = lambda s: F.coalesce(F.try_element_at("source_scores", F.lit(s)), F.lit(0.0))
    rows = rows.withColumn("__said", F.concat_ws(" ", "content", "file_path", "qualified_name", F.array_join("calls", " ")))
    own = Q.tokens(query.text, synonyms=False)
    words = ranking.bm25(rows, own, "__said", "node_id").withColumnRenamed("score", "__bm25") if own else None
    rows = rows.join(words, "node_id", "left") if words is not None else rows.withColumn("__bm25", F.lit(0.0))
    asked = F.array(*map(F.lit, query.terms)) if query.terms else F.array().cast("array<string>")
    top = rows.agg(F.max(said("graph")).alias("__graph"))  # one row
    structure = ranking.structure_score(query, F.col("file_path"), F.col("qualified_name"), F.col("calls")) * 0.5 + F.coalesce(F.try_divide(said("graph"), F.col("__graph")), F.lit(0.0)) * 0.5
    out = rows.join(F.broadcast(top)).withColumn("lexical", F.greatest(F.coalesce("__bm25", F.lit(0.0)), said("fts")))
    out = out.withColumn("semantic", F.greatest(V.token_cosine(asked, T.tokens(F.col("__said"))), said("vector")))
    return out.withColumn("structure", F.least(F.lit(1.0), structure)).drop("__said", "__bm25", "__graph")


def search(nodes: DataFrame, states: DataFrame, vectors: VectorIndex, text: str, topk: int = 10, budget: int = 8000, mode: str = "hybrid", lexical: float | None = None, semantic: float | None = None) -> DataFrame:
    """node_id, file_path, score, rank, used: parse and route on the driver, three branches, merge, rerank, budget.

    nodes: node_id, kind, file_path, language, content, and what else is known of symbols (`completed`); states: node_id, state;
    vectors: what `index` made of nodes. mode, lexical, semantic: see Query.feature_weights. The hybrid route with
    three terms or more orders its window so that new terms are covered first. Only the window's rows are read whole."""
    query = Q.parse(text)
    topk = Q.result_limit(query, topk)
    whole = completed(nodes)
    held = scans.filtered(whole, {k: v for k, v in query.filters.items() if k != "name"})
    merged = aggregates.merged(candidates(held, vectors, query, topk)).orderBy(F.desc(F.round("score", 9)), "node_id").limit(Q.CANDIDATES["merged"] * topk)
    window = storage.kept(nodes.sparkSession, merged.select("node_id", F.col("score").alias("merged"), "source_scores"))  # a few rows
    rows = whole.join(F.broadcast(window), "node_id").join(states, "node_id", "left")
    rows = storage.kept(nodes.sparkSession, window_features(rows, query))
    ranked = ranking.reranked(rows, query, query.feature_weights(mode, lexical, semantic)).withColumn("cost", T.token_estimate(T.first_lines(F.col("content"), 22)))
    order = [F.desc(F.round("score", 9)), F.asc("file_path"), F.asc("node_id")]
    if query.route == "hybrid" and len(query.terms) >= 3:
        ranked = storage.kept(nodes.sparkSession, ranked.withColumn("terms", F.filter(F.array(*map(F.lit, query.terms)), lambda x: F.lower("content").contains(x))))
        places = ranking.diversified(ranked, 2 * topk, topk)
        ranked, order = ranked.join(F.broadcast(places), "node_id"), [F.asc("place")]  # topk rows
    return windows.budgeted(ranked, order, F.col("cost"), budget, 5, topk).select("node_id", "file_path", F.round("score", 6).alias("score"), "rank", "used")
