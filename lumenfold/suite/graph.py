"""Graph navigation, review and deduplication of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_CALLS, SQL_CODE, SQL_CODE_CALLS, SQL_FLOWS, SQL_SYMBOLS, Tables
from lumenfold.functions import text as T
from lumenfold.operators import graph as G
from lumenfold.operators import review as V
from lumenfold.registry import query
from lumenfold.suite import sql as S

@query(
    "impact_depth_k",
    "G02",
    f"""WITH RECURSIVE e AS (SELECT * FROM {SQL_FLOWS}), r(node, steps) AS (SELECT 5::BIGINT, 0::BIGINT UNION SELECT e.caller, r.steps + 1 FROM r JOIN e ON e.callee = r.node WHERE r.steps < 3)
    SELECT node, min(steps) AS steps FROM r GROUP BY node""",
)
def impact_depth_k(t: Tables) -> DataFrame:
    return G.impact(t.flows(), t.spark.createDataFrame([(5,)], "node bigint"), 3)


@query("result_edges", "G04", f"WITH r AS (SELECT node_id FROM {SQL_SYMBOLS} WHERE name = 'cold widget') SELECT caller, callee FROM {SQL_FLOWS} WHERE caller IN (SELECT node_id FROM r) AND callee IN (SELECT node_id FROM r)")
def result_edges(t: Tables) -> DataFrame:
    """Edges of which both ends are results; the results here are the symbols of a name."""
    return G.edges_among(t.flows(), t.symbols().where("name = 'cold widget'").select("node_id"))


@query("file_dependency_edges", "G05", f"SELECT DISTINCT a.file_path AS source, b.file_path AS target FROM {SQL_CALLS} c JOIN {SQL_SYMBOLS} b ON c.callee = b.node_id JOIN {SQL_SYMBOLS} a ON a.node_id = c.caller WHERE a.file_path <> b.file_path")
def file_dependency_edges(t: Tables) -> DataFrame:
    files = t.symbols().select("node_id", "file_path")
    a, b = (files.select(F.col("node_id").alias(k), F.col("file_path").alias(to)) for k, to in (("caller", "source"), ("callee", "target")))
    return t.calls().join(b, "callee").join(a, "caller").where("source <> target").select("source", "target").distinct()


@query(
    "simple_cycles",
    "G06 V03",
    """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL AND source <> target),
    w(first, here, path, closed) AS (SELECT source, target, [source, target], false FROM e WHERE source < target UNION ALL
      SELECT w.first, e.target, CASE WHEN e.target = w.first THEN w.path ELSE list_append(w.path, e.target) END, e.target = w.first FROM w JOIN e ON e.source = w.here WHERE NOT w.closed AND e.target >= w.first AND (e.target = w.first OR NOT list_contains(w.path, e.target)))
    SELECT array_to_string(path, '>') AS path, len(path) AS length FROM w WHERE closed""",
)
def simple_cycles(t: Tables) -> DataFrame:
    return G.simple_cycles(G.transitions(t.events, "user_id", ["ts", "event_id"], "event_type"))


@query(
    "reverse_call_map",
    "G07",
    f"""WITH s AS (SELECT * FROM {SQL_SYMBOLS}), c AS (SELECT DISTINCT f.caller, CASE WHEN f.caller % 2 = 0 THEN b.name ELSE b.qualified_name END AS call FROM {SQL_FLOWS} f JOIN s b ON f.callee = b.node_id),
    n AS (SELECT call, arg_max(name, node_id) AS own FROM (SELECT node_id, name, unnest([name, qualified_name, split_part(qualified_name, '::', -1)]) AS call FROM s) GROUP BY call)
    SELECT DISTINCT caller, unnest([call, coalesce(own, call), split_part(call, '::', -1)]) AS key FROM c LEFT JOIN n USING (call)""",
)
def reverse_call_map(t: Tables) -> DataFrame:
    s = t.symbols()
    named = s.select(F.col("node_id").alias("callee"), "name", "qualified_name")
    calls = t.flows().join(named, "callee").select("caller", F.when(F.col("caller") % 2 == 0, F.col("name")).otherwise(F.col("qualified_name")).alias("call"))
    return G.reverse_calls(calls, s)


@query("undirected_relations", "G08", f"SELECT DISTINCT least(caller, callee) AS a, greatest(caller, callee) AS b FROM {SQL_CALLS} WHERE caller <> callee")
def undirected_relations(t: Tables) -> DataFrame:
    return G.undirected(t.calls())


@query("review_findings", "V01 V04 V03 J14 J15", f"SELECT 'same-signature' AS type, p_partkey AS subject FROM part WHERE p_partkey > (SELECT min(p_partkey) FROM part q WHERE lower(q.p_name) = lower(part.p_name)) UNION ALL SELECT 'dead-code', node_id FROM {SQL_SYMBOLS} s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = s.node_id)")
def review_findings(t: Tables) -> DataFrame:
    called = t.lineitem.select(F.col("l_partkey").alias("node_id")).distinct()
    return V.findings(t.symbols(), called)


@query("yagni_evidence", "V02", "SELECT p_partkey, coalesce(n, 0) AS callers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE coalesce(n, 0) <= 25")
def yagni_evidence(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.select("p_partkey").join(counts, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("callers")).where("callers <= 25")


@query("finding_signatures", "V05", "SELECT event_id, event_type || ':' || coalesce(json_extract_string(props, '$.file'), json_extract_string(props, '$.k'), 'none') AS signature FROM events")
def finding_signatures(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.signature(F.col("event_type"), F.col("props"), ("file", "k")).alias("signature"))


@query("already_discussed", "T11 C09", "SELECT event_id, n > 1 AS discussed FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY ts, event_id) AS n FROM events)")
def already_discussed(t: Tables) -> DataFrame:
    return V.discussed(t.events.withColumn("k", F.get_json_object("props", "$.k")), ["event_type", "k"], ["ts", "event_id"]).select("event_id", "discussed")


@query("remembered_findings", "T11", "SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id % 3 = a.user_id % 3 AND b.event_type = a.event_type AND json_extract_string(b.props, '$.k') = json_extract_string(a.props, '$.k')) AS discussed FROM events a WHERE event_id % 2 = 1")
def remembered_findings(t: Tables) -> DataFrame:
    """Findings of one turn against those that a turn before left in the store, scope by scope."""
    from lumenfold.sources import storage

    path = storage.scratch(t.spark)
    said = t.events.select("event_id", (F.col("user_id") % 3).cast("string").alias("scope"), V.signature(F.col("event_type"), F.col("props"), ("k",)).alias("signature"))
    V.remember(said.where("event_id % 2 = 0"), path)
    return V.remembered(said.where("event_id % 2 = 1"), path).select("event_id", "discussed")


@query(
    "review_composed",
    "V01 V04 J15 J16 J17",
    f"""WITH c AS (SELECT *, lower(signature) AS s, nullif(lower(regexp_extract(signature, '(?i)extends\\s+([A-Za-z0-9_.:<>]+)', 1)), '') AS base FROM {SQL_CODE}), a AS (SELECT * FROM c WHERE node_id % 10 = 0), e AS (SELECT * FROM c WHERE node_id % 10 <> 0), n AS (SELECT call, count(*) AS n FROM {SQL_CODE_CALLS} WHERE caller % 50 = 0 GROUP BY 1)
    SELECT 'same-signature' AS type, name AS subject, file_path FROM a WHERE regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\s*:\\s*', ':', 'g'), '\\s*,\\s*', ',', 'g'), '\\s*\\(\\s*', '(', 'g'), '\\s*\\)\\s*', ')', 'g') IN (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\s*:\\s*', ':', 'g'), '\\s*,\\s*', ',', 'g'), '\\s*\\(\\s*', '(', 'g'), '\\s*\\)\\s*', ')', 'g') FROM e)
    UNION SELECT 'similar-class', name, file_path FROM a WHERE kind = 'class' AND EXISTS (SELECT 1 FROM e WHERE e.kind = 'class' AND e.base = a.base AND e.name <> a.name)
    UNION SELECT 'redundant-import', './' || lower(name), file_path FROM a WHERE file_path IN (SELECT file_path FROM e WHERE lower(e.name) = lower(a.name))
    UNION SELECT 'unneeded', name, file_path FROM a JOIN n ON n.call = name WHERE kind IN ('class', 'function') AND n <= 13""",
)
def review_composed(t: Tables) -> DataFrame:
    """Four finders over every tenth symbol as an addition to the others. Evidence of callers is something a review is
    given; here it is what every fiftieth symbol calls."""
    code = t.code()
    imports = code.select("file_path", F.concat(F.lit("./"), F.lower("name")).alias("specifier"), (F.col("node_id") % 10 == 0).alias("is_added"))
    return V.review(code.where("node_id % 10 = 0"), code.where("node_id % 10 <> 0"), imports, t.code_calls().where("caller % 50 = 0"), 13)
