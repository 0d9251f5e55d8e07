"""Scores of retrieval runs against golden answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Weights of a case's dimensions, of a task's scores, and of quality alone.
CASE_WEIGHTS = {"retrieval": 30, "relations": 20, "multi": 15, "freshness": 20, "impact": 15}
TASK_WEIGHTS = {"retrieval": 30, "density": 20, "runtime": 15, "depth": 15, "freshness": 10, "capability": 10}
QUALITY = ["retrieval", "depth", "freshness", "capability"]
#: What a false positive costs, and the share of it that all of them may cost.
PENALTY = 0.25


def _share(found: Column, of: Column) -> Column:
    """How much of a list another one has; 0 of none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(of, found)), F.size(F.array_distinct(of))), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def retrieval(golden_files: Column, golden_symbols: Column, files: Column, symbols: Column, top_files: Column, top_symbols: Column, n_top: Column, false_positives: Column) -> Column:
    """Recall of files and symbols and precision of what is on top, less a penalty for each different false positive."""
    golden, shown = F.concat(golden_files, golden_symbols), F.concat(top_files, top_symbols)
    precision = F.size(F.array_intersect(golden, shown)) / F.greatest(F.lit(1), n_top)
    both = 0.5 * _share(files, golden_files) + 0.3 * _share(symbols, golden_symbols) + 0.2 * precision
    base = F.when(F.size(golden_symbols) > 0, both).otherwise(0.7 * _share(files, golden_files) + 0.3 * precision)
    return clamp(base - F.least(F.lit(1.0), PENALTY * F.size(F.array_distinct(false_positives))))


def multi(has_valid: Column, has_invalid: Column, has_alternate: Column) -> Column:
    """1 for a valid implementation or an alternate one, a half if an invalid one stands beside a valid one."""
    return F.when(has_valid & has_invalid, 0.5).when(has_valid | has_alternate, 1.0).otherwise(0.0)


def freshness(new: Column, stale: Column, shown: Column) -> Column:
    """Mean of how much of the new targets is shown, and of whether no stale one is."""
    hidden = F.when(F.size(F.array_intersect(stale, shown)) == 0, 1.0).otherwise(0.0)
    return clamp((_share(shown, new) + hidden) / 2)


def impact(tests: Column, artifacts: Column, terms: Column, hits: Column) -> Column:
    """Shares of tests, runtime artifacts and consequences that are named: 0.4, 0.3 and 0.3."""
    return clamp(0.4 * _share(hits, tests) + 0.3 * _share(hits, artifacts) + 0.3 * _share(hits, terms))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of scores by weight over those that apply (are not null)."""
    total = sum((F.when(s.isNotNull(), weights[k]).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(s, F.lit(0.0)) * weights[k] for k, s in scores.items()), F.lit(0.0)), total)


def task_scores(runs: DataFrame) -> DataFrame:
    """task, arm and six scores of each run.

    runs: task, arm, ok, latency, bytes, golden_files, file_hits, golden_symbols, symbol_hits, terms, term_hits, top_hit,
    structural, fresh_hits, fresh_expected, capable, capable_expected. Density and runtime are relative to the
    task's best among runs that succeeded, one row a task; a run that failed scores nothing."""
    at_least = lambda c: F.greatest(F.lit(1), F.col(c))
    raw = runs.withColumn("raw", (F.col("file_hits") + F.col("symbol_hits") + F.col("term_hits")) / F.greatest(F.col("bytes") / 1024, F.lit(0.5)))
    best = raw.where("ok").groupBy("task").agg(F.max("raw").alias("best_raw"), F.min(F.when(F.col("latency") > 0, F.col("latency"))).alias("best_latency"))
    rows = raw.join(best, "task", "left")
    symbols = F.when(F.col("golden_symbols") > 0, F.col("symbol_hits") / at_least("golden_symbols")).otherwise(0.0)
    scores = {
        "retrieval": clamp((F.col("file_hits") / at_least("golden_files") + F.greatest(symbols, F.col("term_hits") / at_least("terms")) + F.col("top_hit")) / 3),
        "density": F.when(F.col("best_raw") > 0, clamp(F.col("raw") / F.col("best_raw"))).otherwise(0.0),
        "runtime": F.when((F.col("best_latency") > 0) & (F.col("latency") > 0), clamp(F.col("best_latency") / F.col("latency"))).otherwise(0.0),
        "depth": clamp(F.col("file_hits") / at_least("golden_files") * 0.5 + F.least(F.col("structural"), F.lit(6)) / 6 * 0.5),
        "freshness": clamp(F.col("fresh_hits") / F.greatest(F.lit(1), F.least(F.lit(4), F.col("fresh_expected")))),
        "capability": clamp(F.col("capable") / at_least("capable_expected")),
    }
    return rows.select("task", "arm", *(F.when(F.col("ok"), v).otherwise(0.0).alias(k) for k, v in scores.items()))


def arm_summary(scores: DataFrame) -> DataFrame:
    """arm, the mean of each score, total (weighted, all), quality (weighted, quality alone) and which arms are best by either."""
    means = scores.groupBy("arm").agg(*(F.round(F.avg(k), 4).alias(k) for k in TASK_WEIGHTS))
    total = sum((F.col(k) * w for k, w in TASK_WEIGHTS.items()), F.lit(0.0))
    own = sum(TASK_WEIGHTS[k] for k in QUALITY)
    quality = sum((F.col(k) * TASK_WEIGHTS[k] for k in QUALITY), F.lit(0.0)) / own * 100
    rows = means.withColumn("total", F.round(total, 2)).withColumn("quality", F.round(quality, 2))
    top = rows.agg(F.max_by("arm", F.struct("quality", F.col("arm"))).alias("__winner"), F.max_by("arm", F.struct("total", F.col("arm"))).alias("__total"))  # one row
    return rows.join(F.broadcast(top)).withColumn("is_winner", F.col("arm") == F.col("__winner")).withColumn("is_best_total", F.col("arm") == F.col("__total")).drop("__winner", "__total")


def hits(text: Column, terms: list[str]) -> list[Column]:
    """hits: terms contained in any case; early: the first of them stands in the first quarter."""
    lower = F.lower(text)
    count = sum((F.when(lower.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    quarter = F.lower(F.substring(text, F.lit(1), F.greatest(F.lit(1), F.expr("length(text) div 4").cast("int"))))
    return [count.alias("hits"), quarter.contains(terms[0]).alias("early")]


def gated(measures: DataFrame, gates: DataFrame) -> DataFrame:
    """name, value, passes and near: each gate (name, is_floor, bound) against its measure (name, value).

    near: it passes by less than a tenth of the bound. A gate without a measure fails."""
    ahead = F.when(F.col("is_floor"), F.col("value") - F.col("bound")).otherwise(F.col("bound") - F.col("value"))
    rows = gates.join(measures, "name", "left").withColumn("ahead", ahead)
    passes = F.coalesce(F.col("ahead") >= 0, F.lit(False))
    return rows.select("name", "value", passes.alias("passes"), (passes & (F.col("ahead") <= F.abs("bound") / 10)).alias("near"))


def latest_accepted(runs: DataFrame, version: int, tiers: list[str], key: str) -> DataFrame:
    """key and run of the latest accepted run (accepted, version, tiers, ts, run) that compares with this one: same version, same tiers."""
    like = runs.where(F.col("accepted") & (F.col("version") == version) & (F.array_sort("tiers") == F.array(*map(F.lit, sorted(tiers)))))
    return like.groupBy(key).agg(F.max_by("run", F.struct("ts", "run")).alias("run"))


def fixture_problems(cases: DataFrame, repos: DataFrame) -> DataFrame:
    """case_id and problem, a row each: what is wrong with cases (case_id, repo, dimensions, golden_files, golden_symbols) of repos (repo, enabled)."""
    known = repos.select("repo", "enabled").distinct()
    twice = cases.groupBy("case_id").agg(F.count("*").alias("__n"))
    rows = cases.join(known, "repo", "left").join(twice, "case_id")
    unknown = F.size(F.array_except("dimensions", F.array(*map(F.lit, CASE_WEIGHTS)))) > 0
    problems = F.array_compact(
        F.array(
            F.when(F.col("enabled").isNull(), "unknown repository"),
            F.when(~F.col("enabled"), "repository is not enabled"),
            F.when(F.col("__n") > 1, "case id is not unique"),
            F.when(F.size("golden_files") + F.size("golden_symbols") == 0, "nothing golden"),
            F.when(unknown, "unknown dimension"),
        )
    )
    return rows.select("case_id", F.explode(problems).alias("problem")).distinct()
