"""An inverted index with what each block of postings can contribute at most.

Documents stand in the order of their lengths, cut into blocks. A posting row is a term and a block: the ids of the
block's documents that hold the term, what each contributes to a score before the term's rarity is known, and
the largest of these. A search sums, block by block, the largest contributions of its terms: a bound on any
document of the block. The blocks of largest bounds are scored first; then those alone whose bound
reaches the k-th score found. Ids and contributions of other blocks are not used.

Scores are those of `ranking.bm25`: a document's tokens are a set, so a term's contribution depends on the document's
length alone, and short documents stand in the first blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators.ranking import K1, B
from lumenfold.sources import storage

#: Documents of a block.
BLOCK = 2048
#: Blocks that are scored before the k-th score is known, beside those that hold k documents.
FIRST = 2


@dataclass
class Postings:
    spark: SparkSession
    path: str

    @cached_property
    def corpus(self) -> tuple[int, float]:
        """Documents and their mean length."""
        row = self.spark.read.parquet(f"{self.path}/corpus").first()
        return row["n"], row["mean"] or 0.0

    @property
    def rows(self) -> DataFrame:
        """term, block, n, top, ids, parts (contributions)."""
        return self.spark.read.parquet(f"{self.path}/postings")


def _posted():
    """A function for tasks: rows (id, block, part, tokens), the rows of a block one after another, become postings."""
    import numpy as np
    import pyarrow as pa

    def posts(held, block):
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows["tokens"].chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(lists)), sizes)
        by_id = rows["id"].combine_chunks() if hasattr(rows["id"], "combine_chunks") else rows["id"]
        ids, part = by_id.to_numpy(zero_copy_only=False)[at], rows["part"].to_numpy()[at]
        order = np.lexsort((part, ids, code))
        n = np.bincount(code, minlength=len(coded.dictionary))
        starts = np.concatenate([[0], np.cumsum(n)])
        lists_of = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values[order]))
        top = np.maximum.reduceat(part[order], starts[:-1])
        columns = {"term": coded.dictionary, "block": pa.array(np.full(len(n), block)), "n": pa.array(n), "top": pa.array(top), "ids": lists_of(ids), "parts": lists_of(part)}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        held, at = [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                if j > i:
                    if held and blocks[i] != at:
                        yield from made(held, at)
                        held = []
                    held, at = [*held, batch.slice(i, j - i)], blocks[i]
        if held:
            yield from made(held, at)

    def made(held, at):
        if sum(len(b.column("tokens").flatten()) for b in held):
            yield posts(held, at)

    return run


def build(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", k1: float = K1, b: float = B, block: int = BLOCK) -> Postings:
    """Write the index of `docs` (key, text) to `path`. A null text counts as an empty one."""
    spark = docs.sparkSession
    rows = storage.kept(spark, docs.select(F.col(key).alias("id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).withColumn("length", F.size("tokens")))
    rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.parquet(f"{path}/corpus")
    mean = spark.read.parquet(f"{path}/corpus").first()["mean"] or 1.0
    part = (k1 + 1) / (1 + k1 * (1 - b + b * F.col("length") / mean))
    # a block is a run of rows of a range of lengths; equal lengths don't all meet in one range
    ranged = rows.repartitionByRange(F.col("length"), F.xxhash64("id")).sortWithinPartitions("length", F.xxhash64("id"))
    place = F.monotonically_increasing_id()  # the range above 33 bits, the row in it below
    blocks = ranged.withColumn("block", F.shiftright(place, 33) * (1 << 24) + F.floor(place.bitwiseAND((1 << 33) - 1) / block))
    # a block stands in one task, which makes its postings; terms are sorted within files
    kind = rows.schema["id"].dataType.simpleString()
    out = blocks.select("id", "block", part.alias("part"), "tokens").mapInArrow(_posted(), f"term string, block bigint, n bigint, top double, ids array<{kind}>, parts array<double>")
    out.sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    return Postings(spark, path)


def _idf(index: Postings, asked: DataFrame) -> DataFrame:
    """term, idf of the terms asked for."""
    n = index.corpus[0]
    df = asked.groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


@dataclass
class Search:
    #: doc_id and score, the best first
    found: DataFrame
    blocks: int
    scored: int


def search(index: Postings, terms: list[str], k: int, first: int = FIRST) -> Search:
    """The k documents of largest score (ties: smaller id) that hold a term, and how many blocks hold one and were scored."""
    spark, n = index.spark, index.corpus[0]
    mine = index.rows.where(F.col("term").isin(sorted(set(terms))))
    # a row a term and block, without the postings themselves
    heads = storage.kept(spark, mine.select("term", "block", "n", "top"))
    rarity = {r["term"]: math.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1) for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term
    if not rarity:
        return Search(spark.createDataFrame([], "doc_id bigint, score double"), 0, 0)
    idf = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(rarity.items()) for x in kv)), F.col("term"))
    # a little more, as sums of the same numbers in another order may differ in their last bits
    bounds = storage.kept(spark, heads.groupBy("block").agg((F.sum(idf * F.col("top")) * (1 + 1e-12)).alias("bound"), F.max("n").alias("n")))

    def scored(blocks: DataFrame) -> DataFrame:
        rows = mine.join(blocks.select("block"), "block", "left_semi").select("term", F.explode(F.arrays_zip("ids", "parts")).alias("p"))
        return rows.groupBy(F.col("p.ids").alias("doc_id")).agg((F.sum(idf * F.col("p.parts"))).alias("score"))

    best = lambda df: df.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)
    ahead = F.coalesce(F.sum("n").over(W.orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the first blocks by bound, k of them at most beside FIRST, in one small sorted list
    few = bounds.orderBy(F.desc("bound"), "block").limit(k + first)
    seeds = storage.kept(spark, few.withColumn("ahead", ahead).withColumn("at", F.row_number().over(W.orderBy(F.desc("bound"), "block"))).where((F.col("ahead") < k) | (F.col("at") <= first)))
    top = storage.kept(spark, best(scored(seeds)))  # k rows
    state = top.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = state["least"] if state["n"] == k else 0.0
    rest = bounds.where(F.col("bound") >= least - 1e-9).join(seeds.select("block"), "block", "left_anti")
    found = storage.kept(spark, best(top.unionByName(scored(rest))))
    return Search(found.orderBy(F.desc(F.round("score", 9)), "doc_id"), bounds.count(), seeds.count() + rest.count())


def search_many(index: Postings, queries: DataFrame, k: int, query: str = "query_id", terms: str = "terms") -> DataFrame:
    """query, doc_id, score, rank for many queries at once (terms: an array a query): for each the k best documents.

    A query's blocks are ranked by their bounds; those first in rank that hold k documents give its k-th
    score, and only blocks whose bound reaches that are scored further. All queries share the joins."""
    spark = index.spark
    asked = storage.kept(spark, queries.select(F.col(query).alias("__q"), F.explode(F.array_distinct(terms)).alias("term")))
    heads = index.rows.select("term", "block", "n", "top")
    rarity = storage.kept(spark, _idf(index, heads.join(asked.select("term").distinct(), "term", "left_semi")))
    weighed = asked.join(rarity, "term")
    bounds = storage.kept(spark, weighed.join(heads, "term").groupBy("__q", "block").agg((F.sum(F.col("idf") * F.col("top")) * (1 + 1e-12)).alias("bound"), F.max("n").alias("n")))

    def scored(blocks: DataFrame) -> DataFrame:
        met = weighed.join(blocks.select("__q", "block"), "__q").join(index.rows.select("term", "block", "ids", "parts"), ["term", "block"])
        rows = met.select("__q", "idf", F.explode(F.arrays_zip("ids", "parts")).alias("p"))
        sums = rows.groupBy("__q", F.col("p.ids").alias("doc_id")).agg(F.sum(F.col("idf") * F.col("p.parts")).alias("score"))
        return best(sums)

    def best(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("__q").orderBy(F.desc(F.round("score", 9)), "doc_id"))
        return rows.withColumn("rank", place).where(F.col("rank") <= k)

    order = W.partitionBy("__q").orderBy(F.desc("bound"), "block")
    at = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + FIRST)
    ahead = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seeds = storage.kept(spark, at.withColumn("ahead", ahead).where((F.col("ahead") < k) | (F.col("at") <= FIRST)).select("__q", "block"))
    top = storage.kept(spark, scored(seeds))
    least = top.groupBy("__q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least"))
    rest = bounds.join(least, "__q").where(F.col("bound") >= F.col("least") - 1e-9).join(seeds, ["__q", "block"], "left_anti")
    found = best(top.drop("rank").unionByName(scored(rest).drop("rank")))
    return found.select(F.col("__q").alias(query), "doc_id", "score", "rank")
