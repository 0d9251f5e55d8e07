"""Navigation of call and dependency graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.sources import storage


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and the least number of steps from a seed against the edges (caller, callee), seeds at 0.

    One join a step with the frontier alone; nodes reached before leave by an anti join. Each frontier is a
    written table, so a step's work isn't done again by those after it; an empty one ends the search."""
    spark = edges.sparkSession
    kept = lambda df: storage.kept(spark, df)
    edges = kept(edges.select("caller", "callee").distinct())
    frontier = kept(seeds.select(F.col("node").cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("steps")).distinct())
    reached = frontier
    for step in range(1, depth + 1):
        met = edges.join(frontier.select(F.col("node").alias("callee")), "callee").select(F.col("caller").alias("node")).distinct()
        frontier = kept(met.join(reached.select("node"), "node", "left_anti").withColumn("steps", F.lit(step).cast("bigint")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def reverse_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, caller, each pair once: callers (caller, call) under up to three keys: the call as it is written, the
    name of the symbol it is the name, the qualified name or the tail of, and its own tail.

    A row a pair, not a list a key: a name that everybody calls is no row of its own."""
    tail = lambda c: F.element_at(F.split(c, "::"), -1)
    named = symbols.select("node_id", "name", F.explode(F.array_distinct(F.array("name", "qualified_name", tail(F.col("qualified_name"))))).alias("call"))
    named = named.groupBy("call").agg(F.max_by("name", "node_id").alias("own"))
    keys = F.explode(F.array_distinct(F.array("call", F.coalesce("own", "call"), tail(F.col("call"))))).alias("key")
    return calls.select("caller", "call").distinct().join(named, "call", "left").select(keys, "caller").distinct()


def edges_among(edges: DataFrame, results: DataFrame) -> DataFrame:
    """Edges (caller, callee) of which both ends are results (node_id)."""
    out = edges.select("caller", "callee").distinct()
    for end in ("caller", "callee"):
        out = out.join(results.select(F.col("node_id").alias(end)), end, "left_semi")
    return out.select("caller", "callee")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).where("a <> b").distinct()



def transitions(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """source, target: consecutive different values within a key."""
    from pyspark.sql import Window

    after = F.lead(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.select(F.col(value).alias("source"), after.alias("target")).where("target is not null and source <> target").distinct()


def simple_cycles(edges: DataFrame, most_steps: int | None = None) -> DataFrame:
    """path and length of every simple cycle of most_steps edges or fewer, once each, from its smallest vertex.

    A recursive query that carries the path; the bound is the number of vertices unless given, which cuts no
    simple cycle, though their number can be exponential."""
    if most_steps is None:
        most_steps = edges.select(F.explode(F.array("source", "target")).alias("v")).agg(F.countDistinct("v")).first()[0]
    name = f"edges_{uuid.uuid4().hex}"  # no two uses in a session share it
    edges.createOrReplaceTempView(name)
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE walk(start, at, path, closed) MAX RECURSION LEVEL {max(100, most_steps + 2)} AS (
          SELECT source, target, array(source, target), false FROM {name} WHERE source < target
          UNION ALL
          SELECT w.start, e.target, CASE WHEN e.target = w.start THEN w.path ELSE array_append(w.path, e.target) END, e.target = w.start
          FROM walk w JOIN {name} e ON e.source = w.at
          WHERE NOT w.closed AND size(w.path) <= {most_steps} AND e.target >= w.start AND (e.target = w.start OR NOT array_contains(w.path, e.target)))
        SELECT array_join(path, '>') AS path, cast(size(path) AS bigint) AS length FROM walk WHERE closed"""
    )
