"""Evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import Tables
from lumenfold.operators import evaluation as E
from lumenfold.registry import query


#: A user's events as a case: files are keys of events, symbols their types; the first ten by time are returned, three of them on top.
_CASES = """(SELECT user_id AS case_id, list(DISTINCT k) FILTER (value > 60) AS golden_files, coalesce(list(DISTINCT event_type) FILTER (value > 95), []) AS golden_symbols, list(DISTINCT k) FILTER (n <= 10) AS files, list(DISTINCT event_type) FILTER (n <= 10) AS symbols,
    list(DISTINCT k) FILTER (n <= 3) AS top_files, list(DISTINCT event_type) FILTER (n <= 3) AS top_symbols, coalesce(list(DISTINCT k) FILTER (n <= 3 AND event_type = 'error' AND value < 5), []) AS wrong, coalesce(list(DISTINCT k) FILTER (value < 5), []) AS stale, bool_or(n <= 3 AND value > 60) AS has_valid, bool_or(n <= 3 AND value < 5) AS has_invalid, bool_or(n <= 10 AND value > 90) AS has_alternate
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id)"""


def _cases(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.events.withColumn("k", F.get_json_object("props", "$.k")).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    some = lambda c, cond, to: F.collect_set(F.when(F.expr(cond), F.col(c))).alias(to)
    return rows.groupBy(F.col("user_id").alias("case_id")).agg(
        some("k", "value > 60", "golden_files"), some("event_type", "value > 95", "golden_symbols"), some("k", "n <= 10", "files"), some("event_type", "n <= 10", "symbols"), some("k", "n <= 3", "top_files"), some("event_type", "n <= 3", "top_symbols"),
        some("k", "n <= 3 and event_type = 'error' and value < 5", "wrong"), some("k", "value < 5", "stale"), F.some(F.expr("n <= 3 and value > 60")).alias("has_valid"), F.some(F.expr("n <= 3 and value < 5")).alias("has_invalid"), F.some(F.expr("n <= 10 and value > 90")).alias("has_alternate"),
    )


def _sql_share(found: str, of: str) -> str:
    return f"CASE WHEN len(coalesce({of}, [])) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({of}), {found})) / len(list_distinct({of})) END"


_SCORED = f"""(WITH c AS (SELECT * REPLACE (coalesce(golden_files, []) AS golden_files) FROM {_CASES}), p AS (SELECT *, len(list_intersect(list_concat(golden_files, golden_symbols), list_concat(top_files, top_symbols))) / 3.0 AS precise, least(1.0, 0.25 * len(wrong)) AS penalty, {_sql_share("files", "golden_files")} AS by_file, {_sql_share("symbols", "golden_symbols")} AS by_symbol FROM c)
    SELECT case_id, least(1.0, greatest(0.0, CASE WHEN len(golden_symbols) > 0 THEN 0.5 * by_file + 0.3 * by_symbol + 0.2 * precise ELSE 0.7 * by_file + 0.3 * precise END - penalty))::DOUBLE AS retrieval, (CASE WHEN has_valid AND has_invalid THEN 0.5 WHEN has_valid OR has_alternate THEN 1.0 ELSE 0.0 END)::DOUBLE AS multi,
    (({_sql_share("top_files", "golden_files")} + CASE WHEN len(list_intersect(stale, top_files)) = 0 THEN 1 ELSE 0 END) / 2)::DOUBLE AS freshness, (0.4 * {_sql_share("files", "golden_files")} + 0.3 * {_sql_share("files", "stale")} + 0.3 * {_sql_share("files", "wrong")})::DOUBLE AS impact FROM p)"""


@query("case_scores", "E01 E02", f"SELECT case_id, round(retrieval, 6) AS retrieval, round(multi, 6) AS multi, round(freshness, 6) AS freshness, round(impact, 6) AS impact FROM {_SCORED}")
def case_scores(t: Tables) -> DataFrame:
    return _scores(t).select("case_id", *(F.round(k, 6).alias(k) for k in ("retrieval", "multi", "freshness", "impact")))


def _scores(t: Tables) -> DataFrame:
    c = F.col
    return _cases(t).select(
        "case_id",
        E.retrieval(c("golden_files"), c("golden_symbols"), c("files"), c("symbols"), c("top_files"), c("top_symbols"), F.lit(3), c("wrong")).alias("retrieval"),
        E.multi(c("has_valid"), c("has_invalid"), c("has_alternate")).alias("multi"),
        E.freshness(c("golden_files"), c("stale"), c("top_files")).alias("freshness"),
        E.impact(c("golden_files"), c("stale"), c("wrong"), c("files")).alias("impact"),
    )


@query("case_totals", "E03", f"SELECT case_id, round(100 * (30 * retrieval + 15 * multi + CASE WHEN case_id % 2 = 0 THEN 20 * freshness ELSE 0 END + CASE WHEN case_id % 3 = 0 THEN 15 * impact ELSE 0 END) / (45 + CASE WHEN case_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN case_id % 3 = 0 THEN 15 ELSE 0 END), 4) AS score FROM {_SCORED}")
def case_totals(t: Tables) -> DataFrame:
    """Each case's score over the dimensions that apply to it: freshness to every second one, impact to every third."""
    apply = {"retrieval": F.col("retrieval"), "multi": F.col("multi"), "freshness": F.when(F.col("case_id") % 2 == 0, F.col("freshness")), "impact": F.when(F.col("case_id") % 3 == 0, F.col("impact"))}
    return _scores(t).select("case_id", F.round(100 * E.weighted(apply, E.CASE_WEIGHTS), 4).alias("score"))


#: Events of a user and type as a run: task, arm, whether it succeeded, and what it found.
_RUNS = "(SELECT user_id AS task, event_type AS arm, max(value) > 20 AS ok, median(value) AS latency, sum(length(props)) * 40 AS bytes, 5 AS golden_files, least(5, count(*)) AS file_hits, user_id % 3 AS golden_symbols, count(*) FILTER (value > 80) AS symbol_hits, 4 AS terms, least(4, count(*) FILTER (value > 50)) AS term_hits, CASE WHEN min(value) < 1 THEN 1 ELSE 0 END AS top_hit, count(DISTINCT json_extract(props, '$.k')) AS structural, count(*) FILTER (value > 70) AS fresh_hits, 6 AS fresh_expected, count(*) FILTER (value > 60) AS capable, 3 AS capable_expected FROM events GROUP BY ALL)"


def _runs(t: Tables) -> DataFrame:
    n = lambda cond: F.count_if(F.expr(cond))
    return t.events.groupBy(F.col("user_id").alias("task"), F.col("event_type").alias("arm")).agg(
        (F.max("value") > 20).alias("ok"), F.median("value").alias("latency"), (F.sum(F.length("props")) * 40).alias("bytes"), F.lit(5).alias("golden_files"), F.least(F.lit(5), F.count("*")).alias("file_hits"), F.first(F.col("user_id") % 3).alias("golden_symbols"), n("value > 80").alias("symbol_hits"),
        F.lit(4).alias("terms"), F.least(F.lit(4), n("value > 50")).alias("term_hits"), F.when(F.min("value") < 1, 1).otherwise(0).alias("top_hit"), F.countDistinct(F.get_json_object("props", "$.k")).alias("structural"), n("value > 70").alias("fresh_hits"), F.lit(6).alias("fresh_expected"), n("value > 60").alias("capable"), F.lit(3).alias("capable_expected"),
    )


_TASKS = f"""(WITH r AS (SELECT *, (file_hits + symbol_hits + term_hits) / greatest(bytes / 1024.0, 0.5) AS raw FROM {_RUNS}), b AS (SELECT task, max(raw) FILTER (ok) AS best_raw, min(latency) FILTER (ok AND latency > 0) AS best_latency FROM r GROUP BY task)
    SELECT task, arm, CASE WHEN ok THEN least(1, greatest(0, (file_hits / greatest(1, golden_files) + greatest(CASE WHEN golden_symbols > 0 THEN symbol_hits / golden_symbols ELSE 0 END, term_hits / greatest(1, terms)) + top_hit) / 3)) ELSE 0 END::DOUBLE AS retrieval, CASE WHEN ok AND best_raw > 0 THEN least(1, raw / best_raw) ELSE 0 END::DOUBLE AS density,
    CASE WHEN ok AND best_latency > 0 AND latency > 0 THEN least(1, best_latency / latency) ELSE 0 END::DOUBLE AS runtime, CASE WHEN ok THEN least(1, file_hits / greatest(1, golden_files) * 0.5 + least(structural, 6) / 6 * 0.5) ELSE 0 END::DOUBLE AS depth, CASE WHEN ok THEN least(1, fresh_hits / greatest(1, least(4, fresh_expected))) ELSE 0 END::DOUBLE AS freshness,
    CASE WHEN ok THEN least(1, capable / greatest(1, capable_expected)) ELSE 0 END::DOUBLE AS capability FROM r LEFT JOIN b USING (task))"""


@query("task_scores", "E04 E05", f"SELECT task, arm, {', '.join(f'round({k}, 6) AS {k}' for k in E.TASK_WEIGHTS)} FROM {_TASKS}")
def task_scores(t: Tables) -> DataFrame:
    return E.task_scores(_runs(t)).select("task", "arm", *(F.round(k, 6).alias(k) for k in E.TASK_WEIGHTS))


@query(
    "arm_summary",
    "A19",
    f"""WITH m AS (SELECT arm, {", ".join(f"round(avg({k}), 4) AS {k}" for k in E.TASK_WEIGHTS)} FROM {_TASKS} GROUP BY arm), s AS (SELECT *, round({" + ".join(f"{k} * {w}" for k, w in E.TASK_WEIGHTS.items())}, 2) AS total, round(({" + ".join(f"{k} * {E.TASK_WEIGHTS[k]}" for k in E.QUALITY)}) / {sum(E.TASK_WEIGHTS[k] for k in E.QUALITY)} * 100, 2) AS quality FROM m)
    SELECT *, arm = (SELECT arg_max(arm, (quality, arm)) FROM s) AS is_winner, arm = (SELECT arg_max(arm, (total, arm)) FROM s) AS is_best_total FROM s""",
)
def arm_summary(t: Tables) -> DataFrame:
    return E.arm_summary(E.task_scores(_runs(t)))


@query("hit_counts", "E06", "SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END AS hits, contains(lower(left(text, greatest(1, length(text) // 4))), 'the') AS early FROM documents")
def hit_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *E.hits(F.col("text"), ["the", "und"]))


_GATES = [("view", True, 50.0), ("click", True, 48.0), ("purchase", False, 51.0), ("error", False, 20.0), ("missing", True, 1.0)]


@query("goal_gate", "E07", f"SELECT g.name, round(m.value, 6) AS value, coalesce(CASE WHEN g.is_floor THEN m.value >= g.bound ELSE m.value <= g.bound END, false) AS passes, coalesce(CASE WHEN g.is_floor THEN m.value - g.bound ELSE g.bound - m.value END BETWEEN 0 AND g.bound / 10, false) AS near FROM (VALUES {', '.join(f'({n!r}, {f}, {b}::DOUBLE)' for n, f, b in _GATES)}) g(name, is_floor, bound) LEFT JOIN (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1) m USING (name)")
def goal_gate(t: Tables) -> DataFrame:
    gates = t.spark.createDataFrame(_GATES, "name string, is_floor boolean, bound double")
    measures = t.events.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return E.gated(measures, gates).withColumn("value", F.round("value", 6))


@query("hard_gates", "E08", "SELECT user_id % 5 AS tier, bool_and(value > 0) AS all_positive, count(*) FILTER (value < 10) AS below_floor FROM events GROUP BY 1")
def hard_gates(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 5).alias("tier")).agg(F.every(F.col("value") > 0).alias("all_positive"), F.count_if(F.col("value") < 10).alias("below_floor"))


@query("accepted_baseline", "E09", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS run FROM events WHERE event_type = 'purchase' AND event_id % 2 = 1 AND value > 30 GROUP BY user_id")
def accepted_baseline(t: Tables) -> DataFrame:
    """The latest accepted run of each user with the same version and tiers."""
    tiers = F.when(F.col("value") > 30, F.array(F.lit("extended"), F.lit("core"))).otherwise(F.array(F.lit("core")))
    runs = t.events.select("user_id", F.col("event_id").alias("run"), "ts", (F.col("event_type") == "purchase").alias("accepted"), (F.col("event_id") % 2).alias("version"), tiers.alias("tiers"))
    return E.latest_accepted(runs, 1, ["core", "extended"], "user_id")


@query("fixture_problems", "E10", "WITH c AS (SELECT event_id // 2 AS case_id, user_id % 4 AS repo, event_id % 9 = 0 AS is_odd, event_id % 5 = 0 AS is_empty FROM events WHERE event_id % 8 < 3), n AS (SELECT case_id, count(*) AS n FROM c GROUP BY 1), r AS (SELECT * FROM c JOIN n USING (case_id)) SELECT case_id, 'unknown repository' AS problem FROM r WHERE repo = 3 UNION SELECT case_id, 'repository is not enabled' FROM r WHERE repo = 2 UNION SELECT case_id, 'case id is not unique' FROM r WHERE n > 1 UNION SELECT case_id, 'nothing golden' FROM r WHERE is_empty UNION SELECT case_id, 'unknown dimension' FROM r WHERE is_odd")
def fixture_problems(t: Tables) -> DataFrame:
    """What is wrong with a set of cases."""
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    cases = t.events.where("event_id % 8 < 3").select(F.expr("event_id div 2").alias("case_id"), (F.col("user_id") % 4).alias("repo"), F.when(F.col("event_id") % 9 == 0, strings("retrieval", "taste")).otherwise(strings("retrieval")).alias("dimensions"), F.when(F.col("event_id") % 5 == 0, strings()).otherwise(strings("a.ts")).alias("golden_files"), strings().alias("golden_symbols"))
    repos = t.spark.createDataFrame([(0, True), (1, True), (2, False)], "repo bigint, enabled boolean")
    return E.fixture_problems(cases, repos)
