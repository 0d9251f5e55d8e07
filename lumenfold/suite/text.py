"""Scalar functions on text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_SYMBOLS, Tables
from lumenfold.functions import text as T
from lumenfold.registry import query
from lumenfold.sources import diffs
from lumenfold.suite import sql as S


def _list(c) -> F.Column:
    return F.array_join(c, ",")


@query("tokenize", "F01", f"SELECT page_id, {S.joined(S.words('html'))} AS tokens FROM pages")
def tokenize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", _list(T.words(F.col("html"))).alias("tokens"))


@query("stems", "F02", f"SELECT item_id, {S.joined(S.tokens('text'))} AS tokens FROM benchmark")
def stems(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", _list(T.tokens(F.col("text"))).alias("tokens"))


_SYN = "MAP {" + ", ".join(f"'{k}': {S.in_list(v)}" for k, v in T.SYNONYMS.items()) + "}"
_QUERIES = "['priority of mixed sources', 'rank search results', 'decide routing', 'callers of parse', 'ordering']"


@query(
    "synonym_expand",
    "F03",
    f"""WITH q AS (SELECT item_id, text || ' ' || ({_QUERIES})[item_id % 5 + 1] AS q FROM benchmark), b AS (SELECT item_id, q, {S.tokens("q")} AS base, {S.words("q")} AS w FROM q),
    x AS (SELECT item_id, list_distinct(list_concat(base, flatten(list_transform(w, lambda t: coalesce({_SYN}[t], []))))) AS toks FROM b)
    SELECT item_id, {S.joined("list_sort(list_distinct(CASE WHEN list_has_any(toks, " + S.in_list(T.ROUTING_ANCHORS) + ") AND list_has_any(toks, " + S.in_list(T.ROUTING_TRIGGERS) + ") THEN list_concat(toks, " + S.in_list(T.ROUTING_HINTS) + ") ELSE toks END))")} AS tokens FROM x""",
)
def synonym_expand(t: Tables) -> DataFrame:
    """Tokens, stems, synonyms and routing hints of every benchmark text with one of five questions after it."""
    asked = F.array(*map(F.lit, ["priority of mixed sources", "rank search results", "decide routing", "callers of parse", "ordering"]))
    said = F.concat("text", F.lit(" "), F.element_at(asked, (F.col("item_id") % 5 + 1).cast("int")))
    return t.benchmark.select("item_id", _list(T.tokens(said, synonyms=True)).alias("tokens"))


@query("normalize_text", "F04", f"SELECT p_partkey, {S.normalized('p_name')} AS n FROM part")
def normalize_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.normalized(F.col("p_name")).alias("n"))


@query("canonical", "F05", "SELECT p_partkey, lower(regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9_$]', '', 'g')) AS c FROM part")
def canonical(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.canonical(F.concat_ws(" ", "p_brand", "p_name")).alias("c"))


@query("reference_key", "F06", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || '::' || p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part")
def reference_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.reference_key(F.concat_ws("::", "p_brand", "p_name")).alias("k"))


@query("symbol_like", "F08", f"SELECT item_id, {S.is_symbol('w')} AS is_symbol FROM (SELECT item_id, split_part(text, ' ', 1) AS w FROM benchmark)")
def symbol_like(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.is_symbol(F.split_part("text", F.lit(" "), F.lit(1))).alias("is_symbol"))


@query("path_like", "F09", f"SELECT page_id, {S.is_path('url')} AS is_path FROM pages")
def path_like(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.is_path(F.col("url")).alias("is_path"))


@query("normalise_signature", "F12", "SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace('export async fn ( ' || p_name || ' : string , n )', '\\s+', ' ', 'g')), '^(export )?(default )?(async )?', ''), '\\s*:\\s*', ':', 'g'), '\\s*,\\s*', ',', 'g'), '\\s*\\(\\s*', '(', 'g'), '\\s*\\)\\s*', ')', 'g')) AS k FROM part")
def normalise_signature(t: Tables) -> DataFrame:
    made = F.concat(F.lit("export async fn ( "), "p_name", F.lit(" : string , n )"))
    return t.part.select("p_partkey", T.signature_key(made).alias("k"))


@query("name_depth_tail", "F13", f"SELECT node_id, len(regexp_split_to_array(qualified_name, '::|[:.#]')) - 1 AS depth, regexp_split_to_array(qualified_name, '::|[:.#]')[-1] AS tail FROM {SQL_SYMBOLS}")
def name_depth_tail(t: Tables) -> DataFrame:
    return t.symbols().select("node_id", T.name_depth(F.col("qualified_name")).alias("depth"), T.name_tail(F.col("qualified_name")).alias("tail"))


@query("token_estimates", "F14", f"SELECT doc_id, {S.token_estimate('text')} AS tokens, greatest(1, ceil(length(text) / 4))::BIGINT AS by_chars FROM documents")
def token_estimates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.char_estimate(F.col("text")).alias("by_chars"))


@query("truncate_content", "F15", "SELECT doc_id, CASE WHEN len(l) <= 22 THEN text ELSE array_to_string(l[1:22], chr(10)) || chr(10) || '... truncated ' || (len(l) - 22) || ' lines' END AS content FROM (SELECT doc_id, text, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)")
def truncate_content(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.first_lines(F.col("text"), 22).alias("content"))


@query("content_type", "F16", "SELECT doc_id, CASE WHEN regexp_matches(h, '^[{\\[]') AND json_valid(text) THEN 'json' WHEN regexp_matches(h, '\\b(function|class|const|import|export|interface|return)\\b.*[({;=]') THEN 'code' ELSE 'text' END AS content_type FROM (SELECT doc_id, text, ltrim(left(text, 300)) AS h FROM documents)")
def content_type(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.content_type(F.col("text")).alias("content_type"))


@query("hash_ids", "F18", "SELECT doc_id, left(sha256(source || chr(0) || lang), 16) AS scope, CAST(('0x' || left(sha256(text), 8))::UBIGINT AS BIGINT) AS h FROM documents")
def hash_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.short_hash(F.col("source"), F.col("lang")).alias("scope"), T.hash32(F.col("text")).alias("h"))


_DIFF = [
    "+++ b/src/page{}.ts",
    "+import {{ a as b, c }} from 'x';",
    "+import * as all from \"y\";",
    "+import main, {{ d }} from 'z';",
    "+import 'w';",
    "+// function hidden() {{",
    "+export async function run(a: string,  b: number): Promise<void> {{",
    "-function old() {{",
    "+const one = x => x;",
    "+  class P extends Q.R implements S, T {{",
    " function same() {{",
]
_DECLARED = [("import", "x", "a", "b"), ("import", "x", "c", "c"), ("import", "y", "*", "all"), ("import", "z", "default", "main"), ("import", "w", None, None), ("function", "run", "function run(a: string, b: number): Promise<void>", None), ("function", "one", "function one(x)", None), ("class", "P", "class P extends Q.R implements S, T", None)]


def _literal(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


@query("diff_like_parse", "F20 S19", "SELECT p.page_id AS diff_id, 'src/page' || p.page_id || '.ts' AS file_path, v.* FROM pages p, (VALUES " + ", ".join("(" + ", ".join(map(_literal, x)) + ")" for x in _DECLARED) + ") v(type, name, detail, local)")
def diff_like_parse(t: Tables) -> DataFrame:
    """A diff of ten lines a page; SQL says what each of them declares."""
    body = F.concat(F.lit(_DIFF[0].split("{}")[0]), F.col("page_id"), F.lit(".ts\n" + "\n".join(x.format() for x in _DIFF[1:])))
    return diffs.additions(t.pages.select(F.col("page_id").alias("diff_id"), body.alias("content")))


@query("redact_secrets", "F21", "SELECT doc_id, CASE WHEN length(r) <= 8192 THEN r ELSE left(r, 8192) || '...' || (length(r) - 8192) END AS clean FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(Bearer\\s+)[A-Za-z0-9._-]+', '\\1[REDACTED]', 'g'), '(?i)(api[_-]?key|access[_-]?token|secret|password|passwd|authorization|token|credential)\\s*[:=]\\s*[^\\s,;`\"''()\\[\\]{}]{4,}', '\\1=[REDACTED]', 'g') AS r FROM documents)")
def redact_secrets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.redacted(F.col("text")).alias("clean"))


@query("mask_dynamic", "F22", "SELECT event_id, regexp_replace(regexp_replace('at /home/u' || user_id || '/x v1.2.' || event_id || ' end', '(?i)/home/\\w+', '[DYNAMIC]'), '\\b\\d+\\.\\d+\\.\\d+\\b', '[DYNAMIC]') AS masked FROM events")
def mask_dynamic(t: Tables) -> DataFrame:
    made = F.concat(F.lit("at /home/u"), F.col("user_id"), F.lit("/x v1.2."), F.col("event_id"), F.lit(" end"))
    return t.events.select("event_id", T.masked(made).alias("masked"))


@query(
    "cache_alignment",
    "F22 C11",
    """WITH t AS (SELECT p_partkey, 'Reads /home/u' || p_size || ' at 1.2.' || p_partkey AS a, CASE p_partkey % 3 WHEN 0 THEN 'cwd' WHEN 1 THEN 'name' ELSE 'Version' END AS label, 'session: s' || p_size AS d FROM part),
    f AS (SELECT p_partkey, 'Reads [DYNAMIC] at [DYNAMIC]' AS description, label, '[DYNAMIC]' AS property, 3 + CASE WHEN lower(label) IN ('cwd', 'version') THEN 1 ELSE 0 END AS n FROM t)
    SELECT p_partkey, description, property, n AS dynamic_fields, CAST(floor((length(description) + length(property)) * 0.25) AS BIGINT) AS prefix_tokens, round(greatest(0.0, least(0.95, 1 - n / 3.0)), 6)::DOUBLE AS hit_rate FROM f""",
)
def cache_alignment(t: Tables) -> DataFrame:
    """Descriptions with what changes masked, how many fields change, and how much of a prompt's prefix can be cached."""
    label = F.when(F.col("p_partkey") % 3 == 0, "cwd").when(F.col("p_partkey") % 3 == 1, "name").otherwise("Version")
    tools = t.part.select("p_partkey", F.concat(F.lit("Reads /home/u"), "p_size", F.lit(" at 1.2."), "p_partkey").alias("description"), label.alias("label"), F.concat(F.lit("session: s"), "p_size").alias("property"))
    rows = tools.select("p_partkey", T.masked(F.col("description")).alias("description"), T.masked(F.col("property")).alias("property"), (T.dynamic_patterns(F.col("description")) + T.dynamic_patterns(F.col("property")) + T.is_dynamic_label(F.col("label")).cast("int")).alias("dynamic_fields"))
    return rows.select("p_partkey", "description", "property", F.col("dynamic_fields").cast("bigint"), F.floor((F.length("description") + F.length("property")) * 0.25).alias("prefix_tokens"), F.round(T.cache_hit_rate(F.col("dynamic_fields"), F.lit(1)), 6).alias("hit_rate"))


_MENTIONS = "url || ' changed lib/' || page_id || '.rs, (src/a_' || page_id % 7 || '.tsx) and \"x.yaml\": no/y.exe z.tsx.bak w.py.\n' || page_id % 3 || '/end.hpp'"


@query("extract_paths", "F23", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '(?:^|[\\s\"''`(])([\\w./-]+\\.(?:ts|tsx|js|jsx|mjs|cjs|json|md|py|rs|go|java|kt|c|cc|cpp|h|hpp|cs|rb|php|swift|scala|sh|yaml|yml|toml))(?:$|[\\s\"''`):,])', 1))), ',') AS files FROM (SELECT page_id, " + _MENTIONS.replace("\n", "' || chr(10) || '") + " || ' ' || html AS x FROM pages)")
def extract_paths(t: Tables) -> DataFrame:
    """Files that each page and a line of a log about it mention."""
    n = lambda k: (F.col("page_id") % k).cast("string") if k else F.col("page_id").cast("string")
    said = F.concat("url", F.lit(" changed lib/"), n(0), F.lit(".rs, (src/a_"), n(7), F.lit('.tsx) and "x.yaml": no/y.exe z.tsx.bak w.py.\n'), n(3), F.lit("/end.hpp "), "html")
    return t.pages.select("page_id", _list(T.mentioned_files(said)).alias("files"))


@query("language_of_path", "F25", "SELECT page_id, CASE WHEN regexp_matches(p, '\\.[cm]?tsx?$') THEN 'typescript' WHEN regexp_matches(p, '\\.[cm]?jsx?$') THEN 'javascript' ELSE 'text' END AS language FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.mjs' ELSE '' END AS p FROM pages)")
def language_of_path(t: Tables) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, ".ts").when(F.col("page_id") % 3 == 1, ".mjs").otherwise("")
    return t.pages.select("page_id", T.language_of(F.concat("url", ending)).alias("language"))
