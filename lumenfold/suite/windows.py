"""Windows, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_NODES, SQL_SYMBOLS, Tables
from lumenfold.functions import text as T
from lumenfold.operators import windows as W
from lumenfold.registry import query
from lumenfold.suite import sql as S


@query("tool_rank", "W03", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS tool_rank FROM conversations")
def tool_rank(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("bigint").alias("tool_rank"))


@query("rank_normalised_score", "W04", "SELECT conv_id, turn, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0.35, 1 - 0.6 * (i - 1) / n) END, 6)::DOUBLE AS score FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def rank_normalised_score(t: Tables) -> DataFrame:
    whole = Window.partitionBy("conv_id")
    i, n = F.row_number().over(whole.orderBy("turn")), F.count("*").over(whole)
    score = F.when(n <= 1, 1.0).otherwise(F.greatest(F.lit(0.35), 1 - 0.6 * (i - 1) / n))
    return t.conversations.select("conv_id", "turn", F.round(score, 6).alias("score"))


@query("per_file_round_robin", "W05 W08 R31", "SELECT doc_id, source, depth FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS depth FROM documents) WHERE depth <= 4 ORDER BY depth, n_chars DESC, doc_id LIMIT 60")
def per_file_round_robin(t: Tables) -> DataFrame:
    return W.round_robin(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 4, 60).select("doc_id", "source", "depth")


@query("best_per_symbol", "W06", "SELECT p_name, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1")
def best_per_symbol(t: Tables) -> DataFrame:
    best = F.min_by(F.struct("p_partkey", "p_retailprice"), F.struct(-F.col("p_retailprice"), "p_partkey")).alias("b")
    return t.part.groupBy("p_name").agg(best).select("p_name", "b.*")


@query("cap_per_anchor", "W07", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3")
def cap_per_anchor(t: Tables) -> DataFrame:
    return W.first_per(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey")


@query(
    "token_budget",
    "W09 F14 L05",
    f"""WITH c AS (SELECT doc_id, {S.token_estimate("text")} AS cost, CASE WHEN doc_id % 3 = 0 THEN 3000 + CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN doc_id % 5 <> 0 THEN 10 ELSE 0 END WHEN doc_id % 2 = 0 THEN 2000 + CASE WHEN doc_id % 5 <> 0 THEN 10 ELSE 0 END ELSE 1000 END AS tier, doc_id % 89 AS score FROM documents),
    r AS (SELECT *, row_number() OVER (ORDER BY tier DESC, score DESC, doc_id) AS rank FROM c), x AS (SELECT *, 8000 - coalesce(sum(cost + 5) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM r WHERE rank <= 2000)
    SELECT doc_id, rank, CAST(least(cost + 5, remaining) AS BIGINT) AS used FROM x WHERE remaining > 5""",
)
def token_budget(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    tier = W.source_priority(d % 3 == 0, d % 2 == 0, d % 5 != 0)
    rows = t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("cost"), tier.alias("tier"), (d % 89).alias("score"))
    return W.budgeted(rows, [F.desc("tier"), F.desc("score"), F.asc("doc_id")], F.col("cost"), 8000, 5, 2000).select("doc_id", "rank", "used")


@query("median_run", "W11", "WITH r AS (SELECT event_type, user_id % 10 AS run, round(value) AS latency, length(props) AS bytes FROM events), m AS (SELECT event_type, median(latency) AS m FROM r GROUP BY 1) SELECT DISTINCT event_type, run, latency, bytes FROM r JOIN m USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(latency - m), run, bytes, latency) = 1")
def median_run(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 10).alias("run"), F.round("value").alias("latency"), F.length("props").alias("bytes"))
    return W.median_run(rows, "event_type", "latency", "run", "bytes")


@query("position_weight", "W12", "SELECT conv_id, turn, round(CASE WHEN n = 1 THEN 1 ELSE 1 + ((n - i) / (n - 1)) * 0.75 END, 6)::DOUBLE AS weight FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def position_weight(t: Tables) -> DataFrame:
    whole = Window.partitionBy("conv_id")
    i, n = F.row_number().over(whole.orderBy("turn")), F.count("*").over(whole)
    return t.conversations.select("conv_id", "turn", F.round(F.when(n == 1, 1.0).otherwise(1 + F.try_divide(n - i, n - 1) * 0.75), 6).alias("weight"))


@query("topk_tiebreak", "L01 L02", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_brand, p_partkey, p_name LIMIT 60")
def topk_tiebreak(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc("p_retailprice"), "p_brand", "p_partkey", "p_name").limit(60).select("p_partkey", "p_retailprice")


@query("rerank_window", "L03", f"SELECT node_id FROM (SELECT * FROM {SQL_SYMBOLS} ORDER BY name, node_id LIMIT 20) ORDER BY qualified_name, node_id LIMIT 10")
def rerank_window(t: Tables) -> DataFrame:
    return t.symbols().orderBy("name", "node_id").limit(20).orderBy("qualified_name", "node_id").limit(10).select("node_id")


@query("evidence_order_nulls_last", "L07", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality ASC NULLS LAST, length(d.source), d.source, d.doc_id LIMIT 450")
def evidence_order_nulls_last(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.asc_nulls_last("quality"), F.length("source"), "source", "doc_id").limit(450).select("doc_id", "quality")


@query("tail_evict", "L08", f"SELECT node_id, rank AS place FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) AS rank FROM {SQL_NODES} WHERE kind = 'class') WHERE rank < 25 UNION ALL SELECT node_id, 25 FROM (SELECT node_id FROM {SQL_NODES} WHERE kind = 'method' ORDER BY node_id LIMIT 7) QUALIFY row_number() OVER (ORDER BY node_id DESC) = 1")
def tail_evict(t: Tables) -> DataFrame:
    """Seven extras at the end of a full list of 25: each takes the last place."""
    listed = lambda kind, n: W.top(t.nodes().where(F.col("kind") == kind).select("node_id"), ["node_id"], n).withColumnRenamed("rank", "place")
    return W.tail_inserted(listed("class", 25), listed("method", 7), "node_id", 25)
