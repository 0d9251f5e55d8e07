"""Aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_FEEDBACK, SQL_MANIFEST, SQL_NODES, Tables
from lumenfold.functions import text as T
from lumenfold.operators import aggregates as A
from lumenfold.registry import query
from lumenfold.suite import sql as S


@query("feedback_group_count", "A01", f"SELECT stream, source, content_type, kind, count(*) AS n FROM {SQL_FEEDBACK} GROUP BY ALL")
def feedback_group_count(t: Tables) -> DataFrame:
    return t.feedback().groupBy("stream", "source", "content_type", "kind").agg(F.count("*").alias("n"))


@query("feedback_grouping_sets", "A02", f"SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(content_type) = 0 THEN 'content_type' ELSE 'kind' END AS dimension, coalesce(source, content_type, kind) AS category, count(*) FILTER (stream = 'compression') AS compressed, count(*) FILTER (stream = 'retrieval') AS retrieved FROM {SQL_FEEDBACK} GROUP BY GROUPING SETS ((source), (content_type), (kind))")
def feedback_grouping_sets(t: Tables) -> DataFrame:
    return A.feedback_marginals(t.feedback())


@query("feedback_rates", "A03 K01", f"SELECT kind, count(*) FILTER (stream = 'compression') AS compressed, count(*) FILTER (stream = 'retrieval') AS retrieved, CASE WHEN count(*) FILTER (stream = 'compression') = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER (stream = 'retrieval') / count(*) FILTER (stream = 'compression'), 6) END AS rate FROM {SQL_FEEDBACK} GROUP BY kind")
def feedback_rates(t: Tables) -> DataFrame:
    rows = t.feedback().groupBy("kind").agg(F.count_if(F.col("stream") == "compression").alias("compressed"), F.count_if(F.col("stream") == "retrieval").alias("retrieved"))
    return rows.withColumn("rate", F.round(F.coalesce(F.try_divide("retrieved", "compressed"), F.lit(0.0)), 6))


@query("manifest_state_pivot", "A04 T07", f"SELECT count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'failed') AS failed, count(*) AS total, count(*) = count(*) FILTER (state = 'fresh') AS is_fresh FROM {SQL_MANIFEST}")
def manifest_state_pivot(t: Tables) -> DataFrame:
    return A.state_counts(t.manifest()).drop("warnings")


@query("ccr_stats", "A05", "SELECT count(*) AS entries, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents")
def ccr_stats(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))


_DRAFTS = f"(SELECT node_id, 'graph' AS source, (node_id % 7) / 7.0::DOUBLE AS score FROM {SQL_NODES} WHERE node_id % 2 = 0 UNION ALL SELECT node_id, 'vector', (node_id % 5) / 5.0::DOUBLE FROM {SQL_NODES} WHERE node_id % 3 = 0 UNION ALL SELECT node_id, 'fts', (node_id % 11) / 11.0::DOUBLE FROM {SQL_NODES} WHERE node_id % 5 = 0)"


def drafts(t: Tables) -> DataFrame:
    part = lambda s, k, m: t.nodes().where(F.col("node_id") % k == 0).select("node_id", F.lit(s).alias("source"), ((F.col("node_id") % m) / float(m)).alias("score"))
    return part("graph", 2, 7).unionByName(part("vector", 3, 5)).unionByName(part("fts", 5, 11))


@query("merge_candidates", "A06 U01 R17", f"SELECT node_id, round(sum(score) + 0.25 * (count(DISTINCT source) - 1), 6) AS score, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM {_DRAFTS} GROUP BY node_id")
def merge_candidates(t: Tables) -> DataFrame:
    return A.merged(drafts(t)).select("node_id", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


@query("incoming_counts", "A07", "SELECT lower(p_name) AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def incoming_counts(t: Tables) -> DataFrame:
    # counted by key before names are joined: one row a part crosses
    by_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return by_part.join(t.part, "p_partkey").groupBy(F.lower("p_name").alias("name")).agg(F.sum("n").alias("n"))


@query("term_df", "A08", f"SELECT term, count(*) AS df FROM (SELECT unnest({S.words('text')}) AS term FROM documents) GROUP BY term")
def term_df(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(T.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("corpus_stats", "A08", f"SELECT count(*) AS n_docs, round(avg(len({S.words('text')})), 6) AS mean_length FROM documents")
def corpus_stats(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size(T.words(F.col("text")))), 6).alias("mean_length"))


@query("docs_per_file", "A09", "SELECT source AS file_path, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents")
def docs_per_file(t: Tables) -> DataFrame:
    """A row a file and document, with how many the file has: no file's documents meet in one row."""
    return A.members(t.documents, F.col("source").alias("file_path"), "doc_id")


@query("group_findings", "A10", "SELECT event_type AS type, user_id AS file, count(*) AS match_count, array_to_string(list_sort(list(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)))[1:5], ',') AS first_five, bool_and(value > 1) AS all_discussed FROM events GROUP BY ALL")
def group_findings(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.groupBy(F.col("event_type").alias("type"), F.col("user_id").alias("file")).agg(F.count("*").alias("match_count"), F.array_join(F.slice(F.array_sort(F.collect_set(k)), 1, 5), ",").alias("first_five"), F.every(F.col("value") > 1).alias("all_discussed"))


@query("max_normalise", "A13", "SELECT vec_id, round(CASE WHEN m <= 0 THEN 0 ELSE greatest(x, 0) / m END, 6) AS score FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, max(greatest(CAST(embedding[1] AS DOUBLE), 0)) OVER () AS m FROM embeddings)")
def max_normalise(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return A.max_normalised(rows, "x").select("vec_id", F.round("x", 6).alias("score"))


@query("dedupe_max_score", "A14", "SELECT user_id, max(value) AS score, arg_max(event_type, (value, event_id)) AS event_type FROM events GROUP BY user_id")
def dedupe_max_score(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("value").alias("score"), F.max_by("event_type", F.struct("value", "event_id")).alias("event_type"))


@query("session_stats", "A15", "SELECT user_id, count(*) AS runs, round(sum(value), 4) AS total, round(avg(value), 6) AS mean_ratio FROM events GROUP BY user_id")
def session_stats(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("runs"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean_ratio"))


@query("median_by_group", "A16", "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def median_by_group(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@query("weighted_tier_mean", "A17", "WITH r AS (SELECT doc_id % 6 AS repo, avg(quality) AS s FROM labels GROUP BY 1), x AS (SELECT CASE WHEN repo < 3 THEN 'core' WHEN repo < 5 THEN 'extended' ELSE 'stress' END AS tier, avg(s) AS s FROM r GROUP BY 1) SELECT round(sum(s * w) / sum(w), 6) AS score FROM (SELECT s, CASE tier WHEN 'core' THEN 0.6 WHEN 'extended' THEN 0.3 ELSE 0.1 END::DOUBLE AS w FROM x)")
def weighted_tier_mean(t: Tables) -> DataFrame:
    tier = F.when(F.col("repo") < 3, "core").when(F.col("repo") < 5, "extended").otherwise("stress")
    return A.tiered_mean(t.labels.select((F.col("doc_id") % 6).alias("repo"), F.col("quality").alias("score")), tier, {"core": 0.6, "extended": 0.3, "stress": 0.1})


@query("category_summary", "A18", "SELECT event_type AS category, count(DISTINCT user_id) AS tasks, count(*) AS runs, count(*) FILTER (value > 50) AS passed FROM events GROUP BY event_type")
def category_summary(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("category")).agg(F.countDistinct("user_id").alias("tasks"), F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("passed"))


@query("yagni_verdict", "A20 V06", "SELECT l_partkey, count(*) AS callers, CAST(sum(coalesce(l_linenumber, 3)) AS BIGINT) AS lines, CASE WHEN count(*) <= 1 THEN 'inline' WHEN bool_and(l_quantity < 25) AND sum(coalesce(l_linenumber, 3)) <= 10 THEN 'simplify' ELSE 'keep' END AS verdict FROM lineitem GROUP BY l_partkey")
def yagni_verdict(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("callers"), F.sum(F.coalesce("l_linenumber", F.lit(3))).alias("lines"), F.every(F.col("l_quantity") < 25).alias("simple"))
    return rows.select("l_partkey", "callers", "lines", F.when(F.col("callers") <= 1, "inline").when(F.col("simple") & (F.col("lines") <= 10), "simplify").otherwise("keep").alias("verdict"))


@query("ordered_distinct", "U02", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def ordered_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("user_id", "event_id", "event_type")


@query("expected_matches", "U03", f"SELECT item_id, array_to_string(list_filter(['the', 'of', 'and', 'to', 'in'], lambda x: list_contains({S.words('text')}, x)), ',') AS hits FROM benchmark")
def expected_matches(t: Tables) -> DataFrame:
    """Which of the expected words each text has, in the order in which they are expected."""
    expected = F.array(*map(F.lit, ["the", "of", "and", "to", "in"]))
    return t.benchmark.select("item_id", F.array_join(F.array_intersect(expected, T.words(F.col("text"))), ",").alias("hits"))


@query("ttl_expired", "U04 T12", "SELECT event_id FROM events WHERE ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)")
def ttl_expired(t: Tables) -> DataFrame:
    return A.expired(t.events, "ts", "INTERVAL 1 HOUR").select("event_id")


@query("lru_evict", "U04", "SELECT event_id FROM events ORDER BY value, ts, event_id LIMIT 100")
def lru_evict(t: Tables) -> DataFrame:
    return t.events.orderBy("value", "ts", "event_id").limit(100).select("event_id")


@query("merge_replace_changed", "U06", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE doc_id % 4 = 0")
def merge_replace_changed(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", "n_chars")
    new = old.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    return A.replaced(old, new, "doc_id")


@query("snapshot_diff", "U07", "SELECT 'removed' AS side, source FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT source FROM documents WHERE doc_id % 3 = 0 AND doc_id > 50) UNION ALL SELECT 'added', source FROM (SELECT source FROM documents WHERE doc_id % 3 = 0 AND doc_id > 50 EXCEPT SELECT source FROM documents WHERE doc_id % 2 = 0)")
def snapshot_diff(t: Tables) -> DataFrame:
    a, b = t.documents.where("doc_id % 2 = 0").select("source"), t.documents.where("doc_id % 3 = 0 and doc_id > 50").select("source")
    return a.subtract(b).select(F.lit("removed").alias("side"), "source").unionByName(b.subtract(a).select(F.lit("added").alias("side"), "source"))


@query("uncovered_terms", "U08", f"SELECT doc_id, len(list_filter(list_intersect({S.words('text')}, ['the', 'of', 'and', 'to', 'in']), lambda x: NOT list_contains(['the', 'to'], x))) AS uncovered FROM documents")
def uncovered_terms(t: Tables) -> DataFrame:
    lit = lambda *xs: F.array(*map(F.lit, xs))
    return t.documents.select("doc_id", F.size(F.array_except(F.array_intersect(T.words(F.col("text")), lit("the", "of", "and", "to", "in")), lit("the", "to"))).cast("bigint").alias("uncovered"))
