"""Symbols of source files: names, imports, relations, focus, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_CODE, SQL_CODE_CALLS, Tables
from lumenfold.functions import text as T
from lumenfold.operators import code as K
from lumenfold.operators import fast as P
from lumenfold.operators import joins as J
from lumenfold.operators import ranking as R
from lumenfold.operators import windows as W
from lumenfold.plans import query as Q
from lumenfold.registry import query
from lumenfold.sources import storage
from lumenfold.suite import sql as S


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _targets_sql(imports: str, files: str) -> str:
    """file_path, specifier, target by trying every file with every path an import may mean."""
    endings = S.in_list(K.EXTENSIONS)
    return f"""(WITH i AS (SELECT DISTINCT file_path, specifier, regexp_replace(trim(specifier), '^[''"]|[''"]$', '', 'g') AS p, regexp_replace(file_path, '/?[^/]*$', '') AS folder FROM {imports}),
    b AS (SELECT *, list_distinct(list_filter([p, replace(p, '::', '/'), replace(p, '.', '/'), replace(replace(p, '::', '/'), '.', '/'), CASE WHEN starts_with(p, './') OR starts_with(p, '../') THEN
      array_to_string(list_reduce(list_transform(string_split(folder || '/' || p, '/'), lambda x: [x]), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/') END], lambda x: x IS NOT NULL)) AS c FROM i),
    e AS (SELECT DISTINCT file_path, specifier, regexp_replace(replace(unnest(flatten(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '\\.[A-Za-z0-9]+$') THEN [x] ELSE list_transform({endings}, lambda y: x || y) END))), '\\', '/'), '^\\./+', '') AS ending FROM b)
    SELECT DISTINCT e.file_path, e.specifier, f.target FROM e JOIN (SELECT DISTINCT file_path AS target FROM {files}) f ON e.ending <> '' AND suffix(f.target, e.ending))"""


_IMPORTING = "(SELECT file_path, CASE node_id % 4 WHEN 0 THEN './' || split_part(file_path, '/', 3) WHEN 1 THEN '../small/' || lower(substr(name, 1, 4)) WHEN 2 THEN 'economy.' || split_part(split_part(file_path, '/', 3), '.', 1) ELSE 'promo::' || split_part(split_part(file_path, '/', 3), '.', 1) END AS specifier FROM " + SQL_CODE + ")"


@query("import_targets_endswith", "J22", f"SELECT * FROM {_targets_sql(_IMPORTING, SQL_CODE)}")
def import_targets_endswith(t: Tables) -> DataFrame:
    base = F.split_part("file_path", F.lit("/"), F.lit(3))
    stem = F.split_part(base, F.lit("."), F.lit(1))
    made = F.when(F.col("node_id") % 4 == 0, F.concat(F.lit("./"), base)).when(F.col("node_id") % 4 == 1, F.concat(F.lit("../small/"), F.lower(F.substring("name", 1, 4)))).when(F.col("node_id") % 4 == 2, F.concat(F.lit("economy."), stem)).otherwise(F.concat(F.lit("promo::"), stem))
    code = t.code()
    return K.import_targets(code.select("file_path", made.alias("specifier")), code.select("file_path"))


_SAID = "list_concat(" + ", ".join(f"regexp_extract_all(content, {_quoted(p)}, 1)" for p in K.IMPORTS) + ")"
_RELATIONS = f"""(WITH n AS (SELECT * FROM {SQL_CODE}), i AS (SELECT DISTINCT file_path, trim(regexp_replace(x, '(?i)\\s+as\\s+.*$', '')) AS specifier FROM (SELECT file_path, unnest({_SAID}) AS x FROM n)),
    h AS (SELECT qualified_name, nullif(regexp_extract(signature, {_quoted(K.EXTENDS)}, 1), '') AS base, nullif(regexp_extract(signature, {_quoted(K.IMPLEMENTS)}, 1), '') AS parts, nullif(regexp_extract(signature, {_quoted(K.RETURNED)}, 1), '') AS returned FROM n)
    SELECT 'contains' AS kind, file_path AS source, qualified_name AS target FROM n UNION SELECT 'contains', file_path, name FROM n UNION SELECT 'imports', file_path, specifier FROM i UNION SELECT 'imports', file_path, regexp_replace(specifier, '^.*/', '') FROM i
    UNION SELECT 'imports', file_path, target FROM {_targets_sql("i", "n")} UNION SELECT 'inherits', qualified_name, base FROM h WHERE base IS NOT NULL UNION SELECT 'inherits', qualified_name, trim(unnest(string_split(parts, ','))) FROM h WHERE parts IS NOT NULL UNION SELECT 'returns', qualified_name, returned FROM h WHERE returned IS NOT NULL)"""


@query("relation_extract", "G09", f"SELECT * FROM {_RELATIONS}")
def relation_extract(t: Tables) -> DataFrame:
    return K.relations(t.code())


@query("relation_matches", "J20", f"WITH g AS (SELECT DISTINCT 'inherits' AS kind, qualified_name AS source, 'EconomyBase' AS target FROM {SQL_CODE} UNION SELECT 'returns', qualified_name, 'Widget' FROM {SQL_CODE}) SELECT kind, count(*) AS expected, count(r.target) AS matched, round(count(r.target) / count(*), 6) AS recall FROM g LEFT JOIN {_RELATIONS} r USING (kind, source, target) GROUP BY kind")
def relation_matches(t: Tables) -> DataFrame:
    """How many of the relations that a case expects are derived."""
    code = t.code()
    golden = code.select(F.lit("inherits").alias("kind"), F.col("qualified_name").alias("source"), F.lit("EconomyBase").alias("target")).unionByName(code.select(F.lit("returns").alias("kind"), F.col("qualified_name").alias("source"), F.lit("Widget").alias("target")))
    return K.relation_matches(golden, K.relations(code)).withColumn("recall", F.round("recall", 6))


@query("test_path_kinds", "P10", f"SELECT node_id, regexp_matches(lower(p), {_quoted(T._TEST_FILE)}) AS is_file, regexp_matches(p, {_quoted(T._TEST_PART)}) AS is_part, regexp_matches(p, {_quoted(T._TEST_LIKE)}) AS is_like FROM (SELECT node_id, CASE node_id % 4 WHEN 0 THEN 'unit_tests/' ELSE '' END || file_path AS p FROM {SQL_CODE})")
def test_path_kinds(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("node_id") % 4 == 0, "unit_tests/").otherwise(""), "file_path")
    return t.code().select("node_id", path.alias("p")).select("node_id", T.is_test_file(F.col("p")).alias("is_file"), T.is_test_part(F.col("p")).alias("is_part"), T.is_test_like(F.col("p")).alias("is_like"))


_SPLIT = "list_filter(regexp_split_to_array(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9_]+|_+'), lambda w: w <> '')"
_TELLING = "list_filter(list_transform({x}, lambda w: lower(w)), lambda w: length(w) >= 3 AND NOT list_contains(" + S.in_list(T.STOP_WORDS) + ", w) AND NOT regexp_full_match(w, '\\d+'))"


def _ordered(x: str) -> str:
    """The distinct items of a list in their order."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


@query(
    "identifier_words",
    "F07",
    f"""SELECT node_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({S.normalized('q')}, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\\d+')))), ',') AS words, array_to_string(list_filter(list_transform(regexp_split_to_array(q, '[^A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: w <> ''), ',') AS exact,
    array_to_string({_SPLIT.format(x="q")}, ',') AS parts, array_to_string({_ordered(_TELLING.format(x=_SPLIT.format(x="regexp_replace(regexp_replace(file_path, '^.*/', ''), '[.][A-Za-z0-9]{1,8}$', '')")))}, ',') AS stems FROM (SELECT node_id, qualified_name || '_v2 ' || signature AS q, file_path FROM {SQL_CODE})""",
)
def identifier_words(t: Tables) -> DataFrame:
    rows = t.code().select("node_id", F.concat("qualified_name", F.lit("_v2 "), "signature").alias("q"), "file_path")
    q, said = F.col("q"), lambda x: F.array_join(x, ",")
    return rows.select("node_id", said(F.array_sort(T.identifier_words(q))).alias("words"), said(T.exact_tokens(q)).alias("exact"), said(T.split_identifiers(q)).alias("parts"), said(T.path_stem_tokens(F.col("file_path"))).alias("stems"))


_ASKED = "(SELECT node_id, 'find \"' || name || '\", in path:' || file_path || ' kind:' || kind || ' the loadTests of ' || qualified_name || ';' AS q FROM " + SQL_CODE + ")"
_CLEAN = "list_transform(" + S.word_list("q") + ", lambda p: regexp_replace(trim(p), '^[`''\"]+|[`''\",;]+$', '', 'g'))"
_PLAIN = f"list_transform(list_filter({_CLEAN}, lambda p: p <> '' AND NOT contains(p, '/')), lambda p: regexp_replace(p, '(?i)^(?:name|symbol|kind):', ''))"
_BOTH = f"flatten(list_transform({_PLAIN}, lambda p: [p, coalesce(list_filter(regexp_split_to_array(p, '::|[.#]'), lambda x: x <> '')[-1], '')]))"
_SYMBOLS = f"list_filter({_BOTH}, lambda p: regexp_full_match(p, '[A-Za-z_$][\\w$.:#-]*') AND length(p) >= 2)"
_PATHS = f"list_filter(list_transform(list_filter({_CLEAN}, lambda p: contains(p, '/')), lambda p: regexp_replace(regexp_replace(p, '(?i)^file:', ''), '(?i)^path:', '')), lambda p: length(p) > 1)"
_FTS = _TELLING.format(x="flatten(list_transform(regexp_split_to_array(q, '[^A-Za-z0-9_]+'), lambda w: " + _SPLIT.format(x="w") + "))")


@query(
    "query_extractors",
    "F10 F11",
    f"""WITH a AS (SELECT node_id, {_PATHS} AS paths, {_SYMBOLS} AS symbols, {_FTS} AS terms FROM {_ASKED}), b AS (SELECT node_id, {_ordered("paths")} AS paths, {_ordered("symbols")} AS symbols, {_ordered("terms")} AS terms FROM a)
    SELECT node_id, array_to_string(paths, ',') AS paths, array_to_string(symbols, ',') AS symbols, array_to_string(list_transform(terms[1:16], lambda w: '"' || w || '"'), ' OR ') AS fts, array_to_string(list_filter(terms, lambda w: length(w) >= 4 AND NOT list_contains({S.in_list([*T.BROAD_NAMES, *T.STOP_WORDS])}, w))[1:4], ',') AS families FROM b""",
)
def query_extractors(t: Tables) -> DataFrame:
    asked = F.concat(F.lit('find "'), "name", F.lit('", in path:'), "file_path", F.lit(" kind:"), "kind", F.lit(" the loadTests of "), "qualified_name", F.lit(";"))
    rows = t.code().select("node_id", asked.alias("q"))
    q, said = F.col("q"), lambda x: F.array_join(x, ",")
    return rows.select("node_id", said(T.query_paths(q)).alias("paths"), said(T.query_symbols(q)).alias("symbols"), T.fts_query(T.fts_terms(q)).alias("fts"), said(T.family_terms(T.fts_terms(q))).alias("families"))


_TOKENS = lambda c: f"array_to_string({S.tokens(c)}, ' ')"


_BODY = f"""(WITH c AS (SELECT caller AS node_id, list_sort(list(DISTINCT call)) AS calls FROM {SQL_CODE_CALLS} GROUP BY 1) SELECT node_id, file_path, concat_ws(chr(10), 'path ' || file_path, 'normalized path ' || nullif({_TOKENS("file_path")}, ''), 'kind ' || kind, 'language ' || language, 'qualified ' || qualified_name, 'normalized qualified ' || nullif({_TOKENS("qualified_name")}, ''), 'normalized name ' || nullif({_TOKENS("name")}, ''),
    signature, docstring, 'source' || chr(10) || content, 'calls ' || array_to_string(calls, ' ')) AS body FROM {SQL_CODE} LEFT JOIN c USING (node_id))"""


def _bodies(t: Tables) -> DataFrame:
    said = t.code_calls().groupBy(F.col("caller").alias("node_id")).agg(F.array_sort(F.collect_set("call")).alias("calls"))
    return t.code().join(said, "node_id", "left").select("node_id", "file_path", K.node_text(F.col("calls")).alias("body"))


@query("node_text", "F17", f"SELECT node_id, body FROM {_BODY}")
def node_text(t: Tables) -> DataFrame:
    return _bodies(t).select("node_id", "body")


@query(
    "build_documents",
    "R27 R10 F18",
    f"""WITH d AS (SELECT node_id, body FROM {_BODY} WHERE file_path IN (SELECT file_path FROM {SQL_CODE} WHERE node_id % 9 = 0)), b AS (SELECT node_id, CAST(('0x' || left(sha256('dense:' || x), 8))::UBIGINT % 64 AS BIGINT) AS bucket, count(*) AS k FROM (SELECT node_id, unnest({S.tokens("body")}) AS x FROM d) GROUP BY ALL)
    SELECT 'vd_' || left(sha256(CAST(d.node_id AS VARCHAR) || chr(0) || 'local' || chr(0) || 'v1'), 32) AS id, left(sha256(body), 16) AS content_hash, bucket, round(k / sqrt(sum(k * k) OVER (PARTITION BY d.node_id)), 6) AS weight FROM d JOIN b USING (node_id)""",
)
def build_documents(t: Tables) -> DataFrame:
    """Vector documents of the symbols in changed files: id, hash of the text, embedding."""
    from lumenfold.sources import collections

    changed = t.code().where("node_id % 9 = 0").select("file_path").distinct()
    docs = _bodies(t).join(changed, "file_path", "left_semi")
    ids = docs.select("node_id", collections.document_id(F.col("node_id").cast("string"), F.lit("local"), F.lit("v1")).alias("id"), T.short_hash(F.col("body")).alias("content_hash"))
    return R.local_embedding(docs, "node_id", "body").join(ids, "node_id").select("id", "content_hash", "bucket", F.round("weight", 6).alias("weight"))


_SHARED = "len(list_intersect(a.{c}, b.{c}))::DOUBLE / greatest({least}, least(len(a.{c}), len(b.{c})))"


@query(
    "semantic_neighbours",
    "W01 R25",
    f"""WITH c AS (SELECT caller, list_sort(list(DISTINCT call)) AS said, list(DISTINCT {S.reference_key("call")}) AS call_keys FROM {SQL_CODE_CALLS} GROUP BY 1),
    n AS (SELECT node_id, file_path, {S.tokens("concat_ws(' ', file_path, kind, qualified_name, signature, docstring)")} AS tokens, {S.tokens("file_path")} AS paths, list_distinct([{S.reference_key("name")}, {S.reference_key("qualified_name")}]) AS keys,
      coalesce({S.tokens("array_to_string(said, ' ')")}, []) AS calls, coalesce(call_keys, []) AS call_keys FROM {SQL_CODE} LEFT JOIN c ON caller = node_id),
    rare AS (SELECT list(x) AS rare FROM (SELECT x FROM (SELECT unnest(tokens) AS x FROM n) WHERE length(x) >= 3 GROUP BY x HAVING count(*) BETWEEN 2 AND (SELECT greatest(2, ceil(0.35 * count(*))) FROM n))),
    m AS MATERIALIZED (SELECT n.*, list_intersect(tokens, rare) AS few FROM n, rare),
    o AS (SELECT k, min(node_id) AS low, max(node_id) AS high FROM (SELECT node_id, unnest(keys) AS k FROM n) GROUP BY k), w AS (SELECT k, min(node_id) AS low, max(node_id) AS high FROM (SELECT node_id, unnest(call_keys) AS k FROM n) GROUP BY k),
    tied AS (SELECT DISTINCT node_id FROM (SELECT node_id FROM (SELECT node_id, unnest(call_keys) AS k FROM n) JOIN o USING (k) WHERE low <> node_id OR high <> node_id UNION ALL SELECT node_id FROM (SELECT node_id, unnest(keys) AS k FROM n) JOIN w USING (k) WHERE low <> node_id OR high <> node_id)),
    p AS (SELECT a.node_id, b.node_id AS peer, a.file_path = b.file_path AS same, list_has_any(a.call_keys, b.keys) OR list_has_any(a.keys, b.call_keys) AS tie, list_has_any(a.few, b.few) AS near,
      {_SHARED.format(c="tokens", least=2)} AS t, {_SHARED.format(c="paths", least=1)} AS p, {_SHARED.format(c="calls", least=1)} AS k FROM m a, m b WHERE a.node_id <> b.node_id),
    s AS (SELECT node_id, peer, same, CASE WHEN same THEN 0.45 + CASE WHEN node_id IN (SELECT node_id FROM tied) THEN 0 ELSE 0.2 END ELSE 0 END::DOUBLE + CASE WHEN tie THEN 0.3 ELSE 0 END + t + p * 0.25 + k * 0.2 AS raw FROM p WHERE same OR tie OR near)
    SELECT node_id, peer, CASE WHEN same THEN 'same-file' ELSE 'semantic-overlap' END AS relationship, round(raw, 3) AS score, row_number() OVER (PARTITION BY node_id ORDER BY round(raw, 3) DESC, peer) AS rank FROM s WHERE same OR raw >= 0.18 QUALIFY rank <= 4""",
)
def semantic_neighbours(t: Tables) -> DataFrame:
    """Each symbol's four nearest, by file, calls and rare tokens."""
    return _nearest_symbols(t).select("node_id", "peer", "relationship", "score", F.col("rank").cast("bigint").alias("rank"))


def _nearest_symbols(t: Tables) -> DataFrame:
    code, told = t.code(), storage.kept(t.spark, t.said())
    key = lambda c: T.reference_key(F.col(c))
    nodes = code.select("node_id", "file_path", T.tokens(F.concat_ws(" ", "file_path", "kind", "qualified_name", "signature", "docstring")).alias("tokens"), T.tokens(F.col("file_path")).alias("path_tokens"), F.array_distinct(F.array(key("name"), key("qualified_name"))).alias("keys"))
    said = told.select("node_id", T.tokens(F.array_join("calls", " ")).alias("call_tokens"), F.array_distinct(F.transform("calls", T.reference_key)).alias("call_keys"))
    loose = J.loosely_resolved(told.select(F.col("node_id").alias("caller"), F.explode("calls").alias("call")), code).select(F.col("caller").alias("node_id"), F.col("callee").alias("peer"))
    return K.neighbours(nodes, said, loose.unionByName(loose.select(F.col("peer").alias("node_id"), F.col("node_id").alias("peer"))))


@query("neighbour_aliases", "R25")
def neighbour_aliases(t: Tables) -> DataFrame:
    """Up to twelve names of each symbol's neighbours that its own text lacks."""
    code = t.code()
    texts = code.select("node_id", F.concat_ws("\n", "file_path", "kind", "qualified_name", "signature", "docstring").alias("text"))
    return K.aliases(_nearest_symbols(t), code, texts).select("node_id", F.array_join("aliases", ",").alias("aliases"))


_FLAT = {c: S.normalized(c) for c in ("name", "qualified_name", "file_path", "tail", "call")}


@query(
    "focus_boost",
    "R15 R16",
    f"""WITH n AS (SELECT node_id, kind, {S.normalized("scope")} AS within, {_FLAT["name"]} AS a, {_FLAT["qualified_name"]} AS b, {_FLAT["tail"]} AS c, {_FLAT["file_path"]} AS p FROM (SELECT *, regexp_split_to_array(qualified_name, '::|[:.#]')[-1] AS tail, regexp_split_to_array(qualified_name, '::|[:.#]')[-2] AS scope FROM {SQL_CODE})),
    f AS (SELECT *, contains(p, 'src small') OR contains(b, 'src small') AS is_path, contains(a, 'cold widget') OR contains(b, 'cold widget') OR contains(c, 'cold widget') AS is_symbol FROM n),
    c AS (SELECT DISTINCT caller, {_FLAT["call"]} AS call FROM {SQL_CODE_CALLS}), k AS (SELECT DISTINCT call FROM c), g AS (SELECT DISTINCT a, b, c FROM n), m AS (SELECT k.call, g.a, g.b, g.c FROM k JOIN g ON contains(k.call, g.a) OR contains(k.call, g.b) OR contains(k.call, g.c)),
    u AS (SELECT c.caller AS node_id, f.node_id AS anchor, f.is_path, f.is_symbol FROM c JOIN m USING (call) JOIN f ON f.a = m.a AND f.b = m.b AND f.c = m.c AND (f.is_path OR f.is_symbol) UNION ALL SELECT f.node_id, x.node_id, x.is_path, x.is_symbol FROM c JOIN f x ON x.node_id = c.caller AND (x.is_path OR x.is_symbol) JOIN m USING (call) JOIN f ON f.a = m.a AND f.b = m.b AND f.c = m.c),
    near AS (SELECT node_id, max({{'p': is_path, 's': is_symbol}}) AS v FROM u WHERE node_id <> anchor GROUP BY node_id),
    y AS (SELECT node_id AS anchor, a AS type_name FROM f WHERE (is_path OR is_symbol) AND kind = 'class'), z AS (SELECT DISTINCT within, anchor FROM (SELECT DISTINCT within FROM f) JOIN y ON contains(type_name, within) OR contains(within, type_name)),
    q AS (SELECT DISTINCT f.node_id FROM f JOIN z ON z.within = f.within AND z.anchor <> f.node_id WHERE f.within NOT IN (SELECT within FROM z WHERE anchor = (SELECT min(anchor) FROM y))),
    w AS (SELECT node_id, node_id IN (SELECT node_id FROM q) AS is_member, CASE WHEN is_path AND is_symbol THEN 3.6 WHEN is_path THEN 2.0 WHEN is_symbol THEN 1.8 ELSE 1.0 END AS own, CASE WHEN v IS NULL THEN 1.0 WHEN is_path OR is_symbol THEN sqrt(1.8) WHEN v.p THEN 1.8 WHEN v.s THEN 1.4 ELSE 1.0 END AS close FROM f LEFT JOIN near USING (node_id))
    SELECT node_id, round(0.5 * own * close * CASE WHEN own * close > 1 THEN 1.4 * CASE WHEN is_member THEN 13 ELSE 1 END ELSE 1 END, 6)::DOUBLE AS score FROM w""",
)
def focus_boost(t: Tables) -> DataFrame:
    """Scores boosted for what a query's path and symbol name, and for what calls it or is called by it."""
    found = K.focus(t.code(), t.code_calls(), ["src/small"], ["ColdWidget"])
    boosted = R.focus_boost(F.lit(0.5), F.col("is_path"), F.col("is_symbol"), F.col("near_path"), F.col("near_symbol"), F.col("depth"), F.col("is_member"))
    return found.select("node_id", F.round(boosted, 6).alias("score"))


_CHANGED = "src/economy/cold_widget.ts"
_TESTS = f"""WITH n AS (SELECT * FROM {SQL_CODE}), t AS (SELECT DISTINCT x FROM (SELECT unnest(list_concat({S.tokens("'src/economy/cold_widget'")}, flatten((SELECT list({S.tokens("concat_ws(' ', name, qualified_name, file_path)")}) FROM n WHERE file_path = '{_CHANGED}')))) AS x) WHERE length(x) > 2),
    c AS (SELECT caller AS node_id, array_to_string(list_sort(list(DISTINCT call)), ' ') AS said FROM {SQL_CODE_CALLS} GROUP BY 1),
    h AS (SELECT node_id, file_path, qualified_name, {S.normalized("concat_ws(' ', file_path, name, qualified_name, signature, docstring, content, said)")} AS text FROM n LEFT JOIN c USING (node_id) WHERE regexp_matches(lower(file_path), {_quoted(T._TEST_FILE)}))"""


@query("affected_scores", "G03", _TESTS + " SELECT node_id, file_path, count(*) AS score, row_number() OVER (ORDER BY count(*) DESC, file_path, qualified_name, node_id) AS rank FROM h JOIN t ON contains(h.text, t.x) GROUP BY node_id, file_path, qualified_name ORDER BY rank LIMIT 10")
def affected_scores(t: Tables) -> DataFrame:
    """The ten tests that hold most tokens of a changed file."""
    changed = t.spark.createDataFrame([(_CHANGED,)], "file_path string")
    calls = t.said().select(F.col("node_id").alias("caller"), F.explode("calls").alias("call"))  # gathered by caller already
    return K.affected_tests(t.code(), calls, changed, 10)


@query(
    "impact_one_hop",
    "G02 J08 G01",
    f"""WITH n AS (SELECT node_id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(qualified_name), '[^a-z0-9]+', ' ', 'g')) AS b, concat_ws(' ', signature, docstring) AS text FROM {SQL_CODE}), s AS (SELECT * FROM n WHERE name = 'ColdWidget'), c AS (SELECT DISTINCT caller, trim(regexp_replace(lower(call), '[^a-z0-9]+', ' ', 'g')) AS k FROM {SQL_CODE_CALLS}),
    r AS (SELECT 'caller' AS relation, caller AS node_id FROM c WHERE k IN (SELECT a FROM s UNION SELECT b FROM s) UNION SELECT 'callee', n.node_id FROM n JOIN (SELECT DISTINCT k FROM c WHERE caller IN (SELECT node_id FROM s)) d ON d.k = n.a OR d.k = n.b UNION SELECT 'reference', node_id FROM n WHERE contains(text, 'ColdWidget') AND name <> 'ColdWidget')
    SELECT relation, node_id FROM r WHERE node_id NOT IN (SELECT node_id FROM s)""",
)
def impact_one_hop(t: Tables) -> DataFrame:
    """What a change of a name reaches in one step."""
    code = t.code()
    return K.impact(code.where("name = 'ColdWidget'").select("node_id"), code, t.code_calls())


@query("best_test_per_file", "P09 W06", f"SELECT file_path, min(node_id) AS node_id FROM {SQL_CODE} WHERE regexp_matches(lower(file_path), {_quoted(T._TEST_FILE)}) GROUP BY file_path")
def best_test_per_file(t: Tables) -> DataFrame:
    """The first test symbol of each file of tests."""
    return W.first_per(t.code().where(T.is_test_file(F.col("file_path"))).select("file_path", "node_id"), ["file_path"], ["node_id"], 1).drop("rank")


_INDEX = f"(SELECT 'src/' || folder || '/index.ts' AS file_path, 'export {{ ' || string_agg(DISTINCT name, ', ' ORDER BY name) || ' as Alias }} from \"./all\";' || chr(10) || 'export const SIZE = 1;' || chr(10) || 'export default class Main {{}}' AS content, list_sort(list(DISTINCT name)) AS names FROM (SELECT split_part(qualified_name, '::', 1) AS folder, name FROM {SQL_CODE}) GROUP BY folder)"


@query("exports_scan", "S22", f"WITH i AS (SELECT file_path AS barrel, unnest(list_concat(names[1:len(names) - 1], ['Alias', 'SIZE', 'Main'])) AS exported FROM {_INDEX}) SELECT DISTINCT n.file_path, barrel, exported FROM {SQL_CODE} n JOIN i ON barrel = 'src/' || split_part(n.qualified_name, '::', 1) || '/index.ts' WHERE n.node_id % 25 = 0")
def exports_scan(t: Tables) -> DataFrame:
    """What index files in the folders above a result export."""
    code = t.code()
    names = code.select(F.split_part("qualified_name", F.lit("::"), F.lit(1)).alias("folder"), "name").distinct().groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    files = names.select(F.concat(F.lit("src/"), "folder", F.lit("/index.ts")).alias("file_path"), F.concat(F.lit("export { "), "names", F.lit(' as Alias } from "./all";\nexport const SIZE = 1;\nexport default class Main {}')).alias("content"))
    return K.barrels(code.where("node_id % 25 = 0").select("file_path"), files)


@query("many_key_sort", "L06", f"SELECT node_id FROM {SQL_CODE} ORDER BY CASE WHEN lower(name) = 'coldwidget' THEN 0 ELSE 1 END, CASE WHEN contains(lower(file_path), 'small') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(lower(file_path), {_quoted(T._TEST_FILE)}) THEN 1 ELSE 0 END, CASE WHEN kind = 'class' THEN 0 ELSE 1 END, CASE WHEN starts_with(lower(name), 'cold') THEN 0 ELSE 1 END, CASE WHEN docstring IS NULL THEN 1 ELSE 0 END, length(signature), length(file_path), file_path, qualified_name, node_id LIMIT 100")
def many_key_sort(t: Tables) -> DataFrame:
    """Candidates of a query that names a symbol and a path, by eleven keys."""
    return K.anchored(t.code(), "coldwidget", "small", "cold").limit(100).select("node_id")


_PLAIN_QUERY = Q.parse("cold widget")
_HELD = lambda x: S.normalized(f"concat_ws(' ', {x})")
_FAST = f"""(WITH c AS (SELECT caller AS node_id, array_to_string(list_sort(list(DISTINCT call)), ' ') AS said FROM {SQL_CODE_CALLS} GROUP BY 1), r AS (SELECT n.*, {_HELD("name, qualified_name, file_path, signature, docstring, said")} AS meta, {S.normalized("content")} AS body FROM {SQL_CODE} n LEFT JOIN c USING (node_id))
    SELECT node_id, file_path, CASE WHEN lower(name) = 'coldwidget' THEN 25 ELSE 0 END + {" + ".join(f"CASE WHEN contains(meta, '{t}') THEN 3 WHEN contains(body, '{t}') THEN 1 ELSE 0 END" for t in _PLAIN_QUERY.terms)} - CASE WHEN regexp_matches(lower(file_path), {_quoted(T._TEST_FILE)}) THEN 2 ELSE 0 END + CASE WHEN kind = 'class' THEN 2 ELSE 0 END AS score FROM r)"""


def _fast(t: Tables, asked: Q.Query) -> DataFrame:
    said = t.said().select("node_id", F.array_join("calls", " ").alias("said"))
    return P.scored(t.code().join(said, "node_id", "left"), asked).select("node_id", "name", "qualified_name", "file_path", "score")


@query("fast_score", "R30", f"SELECT node_id, round(score, 6)::DOUBLE AS score FROM {_FAST}")
def fast_score(t: Tables) -> DataFrame:
    """All symbols by the fast path's expression, for a query that anchors nothing; tests hold anchored ones against a plain reading."""
    return _fast(t, _PLAIN_QUERY).select("node_id", F.round("score", 6).alias("score"))


@query("fast_select", "R31 W05 W08", f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, node_id) AS depth FROM {_FAST} WHERE score > 0), w AS (SELECT * FROM d WHERE depth <= 4 ORDER BY depth, score DESC, node_id LIMIT 20) SELECT node_id, file_path, score::DOUBLE AS score, 'ranked' AS why, row_number() OVER (ORDER BY depth, score DESC, node_id) AS rank FROM w ORDER BY rank LIMIT 10")
def fast_select(t: Tables) -> DataFrame:
    """The ten symbols that a result shows, files in turn."""
    return P.selected(_fast(t, _PLAIN_QUERY), _PLAIN_QUERY, 10)


@query("fast_select_anchored", "R30 R31 W06 W07")
def fast_select_anchored(t: Tables) -> DataFrame:
    """The same for a query that names a symbol and a file."""
    asked = Q.parse("fix ColdWidget in src/small/red_bolt.ts")
    return P.selected(_fast(t, asked), asked, 10)
