"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_CALLS, SQL_FEEDBACK, SQL_FLOWS, SQL_MANIFEST, SQL_SYMBOLS, Tables
from lumenfold.functions import text as T
from lumenfold.operators import joins as J
from lumenfold.registry import query
from lumenfold.suite import sql as S

_KEY = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("edges_target_names", "J01", f"SELECT DISTINCT c.caller, p.p_name AS name FROM {SQL_CALLS} c JOIN part p ON c.callee = p.p_partkey")
def edges_target_names(t: Tables) -> DataFrame:
    return J.target_names(t.calls(), t.symbols())


@query("edges_for_ids", "J02", f"SELECT caller, callee FROM {SQL_CALLS} WHERE caller IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def edges_for_ids(t: Tables) -> DataFrame:
    ids = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("caller"))
    return t.calls().join(ids, "caller", "left_semi").select("caller", "callee")


@query(
    "name_resolution_fallback",
    "J04",
    f"""WITH calls AS (SELECT p_partkey AS caller, CASE WHEN p_partkey % 3 = 0 THEN 'un ' || p_name ELSE p_name END AS call FROM part),
    sym AS (SELECT * FROM {SQL_SYMBOLS}), keyed AS (SELECT *, {_KEY.format(x="call")} AS key FROM calls),
    names AS (SELECT node_id, unnest(list_distinct([{_KEY.format(x="name")}, {_KEY.format(x="qualified_name")}])) AS key FROM sym),
    toks AS (SELECT node_id, unnest(list_distinct(list_filter(string_split({_KEY.format(x="name")}, ' '), lambda w: length(w) >= 3))) AS token FROM sym),
    by_name AS (SELECT key, list(node_id) AS ids FROM (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY key ORDER BY node_id) <= 8) GROUP BY key),
    by_token AS (SELECT token, list(node_id) AS ids FROM (SELECT * FROM toks QUALIFY row_number() OVER (PARTITION BY token ORDER BY node_id) <= 8) GROUP BY token),
    rest AS (SELECT caller, call, unnest(list_distinct(list_filter(string_split(key, ' '), lambda w: length(w) >= 3))) AS token FROM keyed WHERE key NOT IN (SELECT key FROM names)),
    met AS (SELECT caller, call, 'exact' AS how, ids FROM keyed JOIN by_name USING (key) UNION ALL SELECT caller, call, 'token', ids FROM rest JOIN by_token USING (token))
    SELECT caller, call, how, array_to_string(list_sort(list_distinct(flatten(list(ids))))[1:8], ',') AS targets FROM met GROUP BY caller, call, how""",
)
def name_resolution_fallback(t: Tables) -> DataFrame:
    calls = t.part.select(F.col("p_partkey").alias("caller"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("un "), "p_name")).otherwise(F.col("p_name")).alias("call"))
    return J.resolved_calls(calls, t.symbols()).withColumn("targets", F.array_join("targets", ","))


@query("hydrate_documents", "J05", "SELECT b.vec_id, b.label, d.lang, d.n_chars FROM embeddings b LEFT JOIN documents d ON b.vec_id = d.doc_id")
def hydrate_documents(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    return t.embeddings.select("vec_id", "label").join(docs, "vec_id", "left")


@query("attach_freshness", "J06", f"SELECT d.doc_id, coalesce(m.state, 'unknown') AS state FROM documents d LEFT JOIN {SQL_MANIFEST} m USING (doc_id)")
def attach_freshness(t: Tables) -> DataFrame:
    states = t.manifest().select("doc_id", "state")
    return t.documents.select("doc_id").join(states, "doc_id", "left").select("doc_id", F.coalesce("state", F.lit("unknown")).alias("state"))


@query("attach_hash", "J07", "SELECT v.vec_id, coalesce(sha256(d.text), '') AS content_hash FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id AND d.lang = 'en'")
def attach_hash(t: Tables) -> DataFrame:
    hashes = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), F.sha2("text", 256).alias("content_hash"))
    return t.embeddings.select("vec_id").join(hashes, "vec_id", "left").select("vec_id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))


@query("callers", "J08 G01", f"SELECT DISTINCT c.caller FROM {SQL_CALLS} c JOIN part p ON c.callee = p.p_partkey WHERE p.p_name = 'cold widget' ORDER BY caller LIMIT 20")
def callers(t: Tables) -> DataFrame:
    wanted = t.symbols().where("name = 'cold widget'").select(F.col("node_id").alias("callee"))
    return t.calls().join(wanted, "callee", "left_semi").select("caller").distinct().orderBy("caller").limit(20)


@query("callees", "J08 G01", f"SELECT DISTINCT c.caller, p.p_name AS name FROM {SQL_CALLS} c JOIN part p ON c.callee = p.p_partkey")
def callees(t: Tables) -> DataFrame:
    names = t.symbols().select(F.col("node_id").alias("callee"), "name")
    return t.calls().join(names, "callee").select("caller", "name").distinct()


@query("same_file_peers_top8", "J09 W02", f"SELECT a.node_id, b.node_id AS peer, row_number() OVER (PARTITION BY a.node_id ORDER BY b.qualified_name, b.node_id) AS rank FROM {SQL_SYMBOLS} a JOIN {SQL_SYMBOLS} b ON a.file_path = b.file_path AND a.node_id <> b.node_id QUALIFY rank <= 8")
def same_file_peers_top8(t: Tables) -> DataFrame:
    return J.first_peers(t.symbols(), "file_path", "node_id", ["qualified_name"], 8)


@query(
    "rare_token_pairs",
    "J10 U05",
    f"""WITH toks AS (SELECT node_id, unnest({S.words("x")}) AS token FROM (SELECT p_partkey AS node_id, concat_ws(' ', p_name, p_brand, 'size' || CAST(p_size AS VARCHAR)) AS x FROM part)), n AS (SELECT count(*) AS n FROM part),
    rare AS (SELECT token FROM toks GROUP BY token HAVING count(*) BETWEEN 2 AND (SELECT greatest(2, ceil(0.35 * n)) FROM n))
    SELECT x.node_id, y.node_id AS peer, count(*) AS shared, row_number() OVER (PARTITION BY x.node_id ORDER BY count(*) DESC, y.node_id) AS rank FROM toks x JOIN toks y USING (token) JOIN rare USING (token) WHERE x.node_id <> y.node_id GROUP BY x.node_id, y.node_id QUALIFY rank <= 8""",
)
def rare_token_pairs(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("node_id"), F.explode(T.words(F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string"))))).alias("token"))
    return J.rare_token_neighbours(rows, t.part)


@query("references_contains", "J11", "SELECT p.p_partkey, s.needle FROM part p JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS needle FROM part) s ON contains(p.p_name, s.needle)")
def references_contains(t: Tables) -> DataFrame:
    seeds = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("needle"))
    return J.containing(seeds, t.part.select("p_partkey", "p_name"), "needle", "p_name").select("p_partkey", "needle")


@query("call_proximity", "J12", f"WITH c AS (SELECT DISTINCT a.p_name AS name, b.p_name AS call FROM {SQL_FLOWS} f JOIN part a ON f.caller = a.p_partkey JOIN part b ON f.callee = b.p_partkey), n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS tail FROM part), m AS (SELECT DISTINCT c.name AS a, n.name AS b FROM c JOIN n ON contains(c.call, n.name) OR contains(c.call, n.tail)) SELECT a AS seed, b AS node FROM m WHERE a <> b UNION SELECT b, a FROM m WHERE a <> b")
def call_proximity(t: Tables) -> DataFrame:
    """Names of which one calls (in the same order's next line) something that contains the other or its tail, both ways."""
    name = lambda k: t.symbols().select(F.col("node_id").alias(k), F.col("name").alias(f"{k}_name"))
    calls = t.flows().join(name("caller"), "caller").join(name("callee"), "callee").select("caller_name", F.col("callee_name").alias("call")).distinct()
    wanted = t.symbols().select("name", F.explode(F.array("name", F.split_part("name", F.lit(" "), F.lit(2)))).alias("needle")).distinct()
    near = J.containing(wanted, calls, "needle", "call").join(wanted, "needle").select(F.col("caller_name").alias("seed"), F.col("name").alias("node")).where("seed <> node")
    return near.union(near.select("node", "seed")).distinct()


@query("removed_files_anti", "J13", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT 'src' || CAST(label AS VARCHAR) FROM embeddings)")
def removed_files_anti(t: Tables) -> DataFrame:
    now = t.embeddings.select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("source")).distinct()
    return t.documents.select("source").distinct().join(now, "source", "left_anti")


@query("dead_nodes_anti", "J14", f"SELECT node_id, name FROM {SQL_SYMBOLS} s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = s.node_id AND l_quantity > 49) AND kind <> 'PROMO'")
def dead_nodes_anti(t: Tables) -> DataFrame:
    called = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("node_id"))
    return t.symbols().where("kind <> 'PROMO'").join(called, "node_id", "left_anti").select("node_id", "name")


@query("same_signature_first", "J15", "SELECT a.p_partkey AS added, min(b.p_partkey) AS existing FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND b.p_partkey < a.p_partkey GROUP BY 1")
def same_signature_first(t: Tables) -> DataFrame:
    # the first of a signature answers for all later ones
    keyed = t.part.select("p_partkey", T.signature_key(F.col("p_name")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("p_partkey").alias("existing"))
    return keyed.join(first, "key").where("p_partkey > existing").select(F.col("p_partkey").alias("added"), "existing")


@query("redundant_import_nulls", "J16", "SELECT p.page_id, min(l.label) AS module FROM (SELECT page_id, nullif(page_id % 4, 0) AS wanted FROM pages) p JOIN (SELECT DISTINCT label FROM embeddings) l ON p.wanted IS NULL OR p.wanted = l.label GROUP BY p.page_id")
def redundant_import_nulls(t: Tables) -> DataFrame:
    known = t.embeddings.select("label").distinct()
    wanted = t.pages.select("page_id", F.nullif(F.col("page_id") % 4, F.lit(0)).alias("wanted"))
    # what names nothing matches all, so the first of all; the rest meets by name
    some = wanted.where("wanted is not null").join(known, F.col("wanted") == F.col("label")).groupBy("page_id").agg(F.min("label").alias("module"))
    first = known.agg(F.min("label").alias("module")).where("module is not null")  # one row
    return wanted.where("wanted is null").select("page_id").join(F.broadcast(first)).unionByName(some)


@query(
    "similar_class_subset",
    "J17",
    """WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS flags FROM lineitem GROUP BY 1),
    k AS (SELECT flags, min(id) AS one, (list_sort(list(id)))[2] AS two FROM s GROUP BY flags),
    h AS (SELECT a.flags, list_sort(list_filter(flatten(list([b.one, b.two])), lambda x: x IS NOT NULL))[1:2] AS ids FROM k a JOIN k b ON len(list_filter(a.flags, lambda f: NOT list_contains(b.flags, f))) = 0 GROUP BY a.flags)
    SELECT s.id AS added, CASE WHEN ids[1] <> s.id THEN ids[1] ELSE ids[2] END AS existing FROM s JOIN h USING (flags) WHERE ids[1] <> s.id OR ids[2] IS NOT NULL""",
)
def similar_class_subset(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("flags"))
    rows = sets.join(J.subsets(sets, "id", "flags"), "flags")
    return rows.select(F.col("id").alias("added"), F.when(F.get("ids", F.lit(0)) != F.col("id"), F.get("ids", F.lit(0))).otherwise(F.get("ids", F.lit(1))).alias("existing")).where("existing is not null")


@query("annotation_fallback_join", "J18", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), e.note, 'none') AS note FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, min(lang) AS note FROM documents GROUP BY source) e USING (source)")
def annotation_fallback_join(t: Tables) -> DataFrame:
    by_id = t.labels.select("doc_id", F.col("quality").cast("string").alias("own"))
    by_name = t.documents.groupBy("source").agg(F.min("lang").alias("note"))
    return t.documents.select("doc_id", "source").join(by_id, "doc_id", "left").join(by_name, "source", "left").select("doc_id", F.coalesce("own", "note", F.lit("none")).alias("note"))


@query("latest_event_by_hash", "J19", f"WITH f AS (SELECT * FROM {SQL_FEEDBACK}), c AS (SELECT hash, arg_max({{'s': source, 'c': content_type, 'k': kind}}, (ts, event_id)) AS v FROM f WHERE stream = 'compression' GROUP BY hash) SELECT r.event_id, r.hash, coalesce(c.v.s, 'graph') AS source, coalesce(c.v.c, 'text') AS content_type, coalesce(c.v.k, 'unknown') AS kind FROM f r LEFT JOIN c USING (hash) WHERE r.stream = 'retrieval'")
def latest_event_by_hash(t: Tables) -> DataFrame:
    return J.latest_compression(t.feedback())


@query("case_compare_full_outer", "J21 E08", "WITH a AS (SELECT doc_id // 2 AS id, quality FROM labels WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS id, quality FROM labels WHERE doc_id % 2 = 1) SELECT coalesce(a.id, b.id) AS id, coalesce(b.quality, 0) - coalesce(a.quality, 0) AS delta, CASE WHEN coalesce(b.quality, 0) > coalesce(a.quality, 0) THEN 'target' WHEN coalesce(b.quality, 0) < coalesce(a.quality, 0) THEN 'baseline' ELSE 'tie' END AS winner FROM a FULL JOIN b ON a.id = b.id")
def case_compare_full_outer(t: Tables) -> DataFrame:
    half = lambda k, to: t.labels.where(F.col("doc_id") % 2 == k).select(F.expr("doc_id div 2").alias("id"), F.col("quality").alias(to))
    both = half(0, "x").join(half(1, "y"), "id", "full_outer").na.fill(0, ["x", "y"])
    return both.select("id", (F.col("y") - F.col("x")).alias("delta"), F.when(F.col("y") > F.col("x"), "target").when(F.col("y") < F.col("x"), "baseline").otherwise("tie").alias("winner"))


@query("fingerprint_full_outer", "J23 U07", "WITH a AS (SELECT doc_id AS path, n_chars AS print FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS print FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.print IS DISTINCT FROM b.print")
def fingerprint_full_outer(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("path"), "n_chars")
    a = d.where("path % 3 <> 0").select("path", F.col("n_chars").alias("x"))
    b = d.where("path % 4 <> 0").select("path", F.when(F.col("path") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("y"))
    both = a.join(b, "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


@query("merge_two_lists", "J24", "WITH a AS (SELECT doc_id AS node_id, (doc_id % 97) / 97.0::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS node_id, (doc_id % 89) / 89.0::DOUBLE AS score FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(a.node_id, b.node_id) AS node_id, round(least(1.0, greatest(coalesce(a.score, 0), coalesce(b.score, 0)) + 0.15::DOUBLE * coalesce(b.score, 0)), 6) AS score FROM a FULL JOIN b ON a.node_id = b.node_id")
def merge_two_lists(t: Tables) -> DataFrame:
    listed = lambda k, m: t.documents.where(F.col("doc_id") % k == 0).select(F.col("doc_id").alias("node_id"), ((F.col("doc_id") % m) / float(m)).alias("score"))
    return J.merged_lists(listed(2, 97), listed(3, 89)).select("node_id", F.round("score", 6).alias("score"))


@query("any_term_match", "J03 F11", f"SELECT doc_id, len(list_intersect({S.words('text')}, ['the', 'and', 'der', 'que'])) AS hits FROM documents WHERE list_has_any({S.words('text')}, ['the', 'and', 'der', 'que'])")
def any_term_match(t: Tables) -> DataFrame:
    asked = F.array(*map(F.lit, ["the", "and", "der", "que"]))
    rows = t.documents.select("doc_id", T.words(F.col("text")).alias("w")).where(F.arrays_overlap("w", asked))
    return rows.select("doc_id", F.size(F.array_intersect("w", asked)).cast("bigint").alias("hits"))
