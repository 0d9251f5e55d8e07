"""Aggregates over candidates, feedback, manifest entries and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feedback_marginals(feedback: DataFrame) -> DataFrame:
    """dimension, category, compressed, retrieved: three one-dimensional counts in one pass of grouping sets."""
    counts = [F.count_if(F.col("stream") == "compression").alias("compressed"), F.count_if(F.col("stream") == "retrieval").alias("retrieved")]
    keys = ("source", "content_type", "kind")
    which = F.when(F.grouping("source") == 0, "source").when(F.grouping("content_type") == 0, "content_type").otherwise("kind")
    rows = feedback.groupingSets([[F.col(k)] for k in keys], *map(F.col, keys)).agg(which.alias("dimension"), *counts)
    return rows.select("dimension", F.coalesce(*keys).alias("category"), "compressed", "retrieved")


def state_counts(manifest: DataFrame) -> DataFrame:
    """One row: entries by state, their total, whether all are fresh, and warnings in fixed order."""
    states = ("fresh", "pending", "stale", "failed")
    rows = manifest.agg(*(F.count_if(F.col("state") == s).alias(s) for s in states), F.count("*").alias("total"))
    said = F.array_compact(F.array(*(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in ("stale", "pending", "failed"))))
    return rows.withColumn("is_fresh", F.col("fresh") == F.col("total")).withColumn("warnings", said)


def merged(drafts: DataFrame, extra_source: float = 0.25) -> DataFrame:
    """Drafts (node_id, source, score) by node: summed scores with a bonus for each further source, best score per source."""
    per_source = drafts.groupBy("node_id", "source").agg(F.sum("score").alias("total"), F.max("score").alias("best"))
    rows = per_source.groupBy("node_id").agg(F.sum("total").alias("sum"), F.array_sort(F.collect_list("source")).alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "best"))).alias("source_scores"))
    return rows.select("node_id", (F.col("sum") + extra_source * (F.size("sources") - 1)).alias("score"), "sources", "source_scores")


def max_normalised(rows: DataFrame, column: str) -> DataFrame:
    """A column clamped at 0 and divided by its maximum, which is one aggregated row; 0 where no value is positive."""
    top = rows.agg(F.max(F.greatest(F.col(column), F.lit(0.0))).alias("__top"))
    value = F.when(F.col("__top") > 0, F.greatest(F.col(column), F.lit(0.0)) / F.col("__top")).otherwise(0.0)
    return rows.join(F.broadcast(top)).withColumn(column, value).drop("__top")


def tiered_mean(scores: DataFrame, tier: Column, weights: dict[str, float]) -> DataFrame:
    """Mean by repo, then by tier, then over tiers by weight; weights of missing tiers are left out."""
    by_repo = scores.groupBy("repo").agg(F.avg("score").alias("score"))
    by_tier = by_repo.groupBy(tier.alias("tier")).agg(F.avg("score").alias("score"))
    weight = F.coalesce(*(F.when(F.col("tier") == k, F.lit(w)) for k, w in weights.items()))
    return by_tier.agg(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 6).alias("score"))


def expired(rows: DataFrame, ts: str, ttl: str) -> DataFrame:
    """Rows older than the ttl at the time of the newest; the newest time is one aggregated row."""
    now = rows.agg(F.max(ts).alias("__now"))
    return rows.join(F.broadcast(now), F.col(ts) + F.expr(ttl) < F.col("__now")).drop("__now")


def members(rows: DataFrame, group: Column, member: str) -> DataFrame:
    """group, member and n, the group's number of members. Counts combine before the shuffle and join back,
    so that a group of any size is spread over tasks."""
    pairs = rows.select(group, member)
    name = pairs.columns[0]
    return pairs.join(pairs.groupBy(name).agg(F.count("*").alias("n")), name)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)
