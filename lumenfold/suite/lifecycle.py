"""Compression, feedback, freshness and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.catalog import SQL_CODE, SQL_FEEDBACK, SQL_MANIFEST, Tables
from lumenfold.functions import text as T
from lumenfold.operators import aggregates as A
from lumenfold.operators import compression as C
from lumenfold.registry import query
from lumenfold.streaming import freshness as Fr
from lumenfold.suite import sql as S

_CUT = "CASE WHEN len({w}) <= {n} THEN text ELSE array_to_string({w}[1:{n}], ' ') || ' ... [compressed]' END"


@query("strategy_by_type", "C01", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'smart-crusher' WHEN 1 THEN 'code-compressor' ELSE 'intelligent-context' END AS strategy FROM events")
def strategy_by_type(t: Tables) -> DataFrame:
    return t.feedback().select("event_id", C.strategy(F.col("content_type")).alias("strategy"))


@query("effective_budget", "C02", "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN greatest(1, floor(n_chars * 0.25)) WHEN 1 THEN ceil(n_chars * 1.75) ELSE n_chars END AS BIGINT) AS budget FROM documents")
def effective_budget(t: Tables) -> DataFrame:
    level = F.when(F.col("doc_id") % 3 == 0, "aggressive").when(F.col("doc_id") % 3 == 1, "conservative").otherwise("auto")
    return t.documents.select("doc_id", C.effective_budget(level, F.col("n_chars")).alias("budget"))


@query("strategy_from_levels", "C10", f"SELECT hash, CASE max(CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END) WHEN 0 THEN 'auto' WHEN 1 THEN 'aggressive' WHEN 2 THEN 'conservative' ELSE 'off' END AS level FROM {SQL_FEEDBACK} GROUP BY hash")
def strategy_from_levels(t: Tables) -> DataFrame:
    level = F.when(F.col("kind") == "view", "auto").when(F.col("kind") == "click", "aggressive").when(F.col("kind") == "purchase", "conservative").otherwise("off")
    return C.level_of(t.feedback().select("hash", level.alias("level")), ["hash"])


@query("compress_words", "C06", f"SELECT doc_id, {_CUT.format(w=S.word_list('text'), n=40)} AS content FROM documents")
def compress_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.first_words(F.col("text"), 40).alias("content"))


@query("compress_local", "C08", f"SELECT event_id, CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 4 = 1 THEN left(c, CAST(floor(length(c) * (6.0::DOUBLE / 11)) AS BIGINT)) || '... [compressed]' ELSE '{{\"k\":' || json_extract_string(props, '$.k') || '}}' END ELSE {_CUT.format(w=S.word_list('text'), n=6)} END AS content FROM (SELECT event_id, props, repeat('word ' || user_id || ' ', 5) AS text, '[' || repeat('\"one two three\",', 5) || '\"four\"]' AS c FROM events)")
def compress_local(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 1, "json").otherwise("text")
    long_ = F.lit("[" + '"one two three", ' * 5 + '"four"]')
    text = F.when(F.col("event_id") % 4 == 1, long_).when(F.col("event_id") % 2 == 1, F.col("props")).otherwise(F.repeat(F.concat(F.lit("word "), F.col("user_id").cast("string"), F.lit(" ")), F.lit(5)))
    return t.events.select("event_id", C.local(text, kind, 6).alias("content"))


@query("compress_lines_scored", "C05 W10")
def compress_lines_scored(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.important_lines(F.col("text"), 120).alias("content"))


@query("compress_code", "C04")
def compress_code(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.code(F.col("text"), 80).alias("content"))


_ITEMS = "'[' || array_to_string(list_transform(range(1, user_id % 9 + 1), lambda i: '{{\"i\":' || i || ',\"t\":\"a b' || i || ' c\"}}'), '{comma}') || ']'"
_MIXED = f"(SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'plain words ' || repeat('and more ', 6) WHEN 1 THEN '{{\"a\": \"one two three four five six seven eight\"}}' ELSE {_ITEMS.format(comma=', ')} END AS text, event_id % 4 AS kind, {_ITEMS.format(comma=',')} AS compact FROM events)"


@query(
    "compress_json_array",
    "C03",
    f"""WITH m AS (SELECT *, user_id % 9 AS n, CASE WHEN user_id % 9 = 0 THEN 1 ELSE 2 * (user_id % 9) + 1 END AS words FROM {_MIXED})
    SELECT event_id, CASE kind WHEN 0 THEN 'plain words and more and more ... [compressed]' WHEN 1 THEN '{{"a":"one two three four five six ... [compressed]' ELSE CASE WHEN words <= 6 THEN compact
      ELSE '{{"__compressed":true,"totalItems":' || n || ',"shownItems":' || greatest(1, CAST(floor(n * 6 / words) AS BIGINT)) || ',"items":[' || array_to_string(list_transform(range(1, greatest(1, CAST(floor(n * 6 / words) AS BIGINT)) + 1), lambda i: '{{"i":' || i || ',"t":"a b' || i || ' c"}}'), ',') || ']}}' END END AS content FROM m""",
)
def compress_json_array(t: Tables) -> DataFrame:
    items = F.array_join(F.transform(F.when(F.col("user_id") % 9 > 0, F.sequence(F.lit(1).cast("bigint"), F.col("user_id") % 9)).otherwise(F.array().cast("array<bigint>")), lambda i: F.concat(F.lit('{"i":'), i.cast("string"), F.lit(',"t":"a b'), i.cast("string"), F.lit(' c"}'))), ", ")
    text = F.when(F.col("event_id") % 4 == 0, F.lit("plain words " + "and more " * 6)).when(F.col("event_id") % 4 == 1, F.lit('{"a": "one two three four five six seven eight"}')).otherwise(F.concat(F.lit("["), items, F.lit("]")))
    return t.events.select("event_id", C.crushed(text, 6).alias("content"))


@query("compress_results", "C07 C12", f"SELECT doc_id AS node_id, {_CUT.format(w=S.word_list('text'), n=20)} AS content, left(sha256(text), 16) AS hash, {S.token_estimate('text')} AS tokens_before, {S.token_estimate(_CUT.format(w=S.word_list('text'), n=20))} AS tokens_after FROM documents")
def compress_results(t: Tables) -> DataFrame:
    return C.results(t.documents.select(F.col("doc_id").alias("node_id"), F.col("text").alias("content")), 8000, 1000)


#: Documents as stored contents, an hour apart by ten; retrievals are events that name them.
_STORE = f"(SELECT hash, text, created_at, coalesce(n, 0) AS retrievals FROM (SELECT left(sha256(text), 16) AS hash, min(text) AS text, min(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id // 10)) AS created_at FROM documents GROUP BY 1) LEFT JOIN (SELECT left(sha256(d.text), 16) AS hash, count(*) AS n FROM {SQL_FEEDBACK} f JOIN documents d ON d.doc_id = f.hash WHERE f.stream = 'retrieval' GROUP BY 1) USING (hash))"


def _store(t: Tables) -> DataFrame:
    made = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 3600 * F.expr("doc_id div 10")).cast("timestamp_ntz")
    store = C.stored(C.originals(t.documents.select(F.col("text").alias("content"), "doc_id"), made))
    return C.retrieved(store, _asked(t))


def _asked(t: Tables) -> DataFrame:
    hashes = t.documents.select(F.col("doc_id").alias("hash"), T.short_hash(F.col("text")).alias("__hash"))
    return t.feedback().where("stream = 'retrieval'").select("hash").join(hashes, "hash").select(F.col("__hash").alias("hash"))


@query("content_store", "S16 C07 C12", f"SELECT hash, length(text) AS chars, CAST(epoch(created_at) AS BIGINT) AS created, retrievals FROM {_STORE}")
def content_store(t: Tables) -> DataFrame:
    """Originals of compressed results under their hashes, with how often each was asked for again."""
    return _store(t).select("hash", F.length("content").cast("bigint").alias("chars"), F.unix_timestamp("created_at").alias("created"), "retrievals")


@query("evict_store", "U04 S16 T12", f"SELECT hash, retrievals FROM {_STORE} WHERE created_at + INTERVAL 72 HOUR >= (SELECT max(created_at) FROM {_STORE}) ORDER BY retrievals DESC, created_at DESC, hash LIMIT 100")
def evict_store(t: Tables) -> DataFrame:
    """What a store of a hundred entries and three days keeps."""
    from lumenfold.sources import storage

    store = storage.kept(t.spark, _store(t))
    now = store.agg(F.max("created_at").alias("now"))  # one row
    return C.evicted(store.join(F.broadcast(now)), F.col("now"), "INTERVAL 72 HOURS", 100).select("hash", "retrievals")


@query("search_store", "S16 P13 C12", f"SELECT hash, CAST(epoch(created_at) AS BIGINT) AS created FROM {_STORE} WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') ORDER BY created_at DESC, hash LIMIT 50")
def search_store(t: Tables) -> DataFrame:
    return C.search_store(_store(t), ["the", "AND"]).limit(50).select("hash", F.unix_timestamp("created_at").alias("created"))


@query("feedback_since", "S17 J19", f"SELECT event_id, hash, kind FROM {SQL_FEEDBACK} WHERE ts >= TIMESTAMP '2024-01-02' AND stream = 'retrieval'")
def feedback_since(t: Tables) -> DataFrame:
    """Retrievals since a time."""
    return t.feedback().where("ts >= TIMESTAMP_NTZ '2024-01-02' and stream = 'retrieval'").select("event_id", "hash", "kind")


@query("compress_review", "C09 A10", f"WITH f AS (SELECT event_type AS type, 'f' || user_id AS file, CAST(json_extract(props, '$.k') AS BIGINT) AS line, event_type || ' at ' || props || ' of ' || user_id AS text FROM events), g AS (SELECT type, file, count(*) AS matches, list_sort(list(DISTINCT line))[1:5] AS lines, CAST(sum({S.token_estimate('text')}) AS BIGINT) AS tokens_before FROM f GROUP BY ALL), h AS (SELECT *, type || ' ' || file || ' x' || matches || CASE WHEN len(lines) > 0 THEN ' ' || array_to_string(lines, ',') ELSE '' END AS summary FROM g) SELECT type, file, matches, tokens_before, summary, {S.token_estimate('summary')} AS tokens_after, left(sha256(type || chr(0) || file), 16) AS hash, round({S.token_estimate('summary')} / tokens_before, 6) AS ratio FROM h")
def compress_review(t: Tables) -> DataFrame:
    found = t.events.select(F.col("event_type").alias("type"), F.concat(F.lit("f"), "user_id").alias("file"), F.get_json_object("props", "$.k").cast("bigint").alias("line"), F.concat("event_type", F.lit(" at "), "props", F.lit(" of "), "user_id").alias("text"))
    return C.review(found).withColumn("ratio", F.round("ratio", 6))


@query("category_use", "K01", f"WITH m AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(content_type) = 0 THEN 'content_type' ELSE 'kind' END || ':' || coalesce(source, content_type, kind) AS category, count(*) FILTER (stream = 'compression') AS c, count(*) FILTER (stream = 'retrieval') AS r FROM {SQL_FEEDBACK} GROUP BY GROUPING SETS ((source), (content_type), (kind))) SELECT category, round(r / c, 6) AS rate, CASE WHEN r = 0 THEN 'never' ELSE 'frequent' END AS use FROM m WHERE c > 0 AND (r = 0 OR r / c >= 0.5)")
def category_use(t: Tables) -> DataFrame:
    """Categories of contents that are never asked for again, and those that often are."""
    return C.category_use(A.feedback_marginals(t.feedback()))


@query("freshness_gate", "T07 T08", f"WITH m AS (SELECT count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS failed, count(*) AS total FROM {SQL_MANIFEST}) SELECT failed = 0 AS allowed, CASE WHEN stale + pending + failed = 0 THEN 'fresh' WHEN failed = 0 THEN 'fresh after sync' ELSE 'blocked' END AS how, CASE WHEN failed = 0 THEN '' ELSE failed || ' failed' END AS warnings FROM m")
def freshness_gate(t: Tables) -> DataFrame:
    """Whether a search may run, after a sync that makes all but failed entries fresh."""
    manifest = t.manifest()
    synced = manifest.withColumn("state", F.when(F.col("state") == "failed", "failed").otherwise("fresh"))
    return C.gate(A.state_counts(manifest), False, A.state_counts(synced)).withColumn("warnings", F.array_join("warnings", ","))


_MARG = f"(SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(content_type) = 0 THEN 'content_type' ELSE 'kind' END AS dimension, coalesce(source, content_type, kind) AS category, count(*) FILTER (stream = 'compression') AS c, count(*) FILTER (stream = 'retrieval') AS r FROM {SQL_FEEDBACK} GROUP BY GROUPING SETS ((source), (content_type), (kind)))"


@query(
    "policy_rules",
    "K02 K01",
    f"""WITH m AS (SELECT dimension, category, c, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE r / c END AS rate FROM {_MARG})
    SELECT dimension, category, round(rate, 6) AS rate, a AS adjustment, v AS value FROM (SELECT *, 'graph-weight' AS a, '+0.1' AS v FROM m WHERE category = 'graph' AND rate > 0.6 UNION ALL SELECT *, 'graph-level', 'conservative' FROM m WHERE category = 'graph' AND rate > 0.6
      UNION ALL SELECT *, 'fts-level', 'aggressive' FROM m WHERE category = 'fts' AND c > 0 AND rate < 0.05 UNION ALL SELECT *, 'kind-boost', '+0.2' FROM m WHERE dimension = 'kind' AND c > 0 AND rate > 0.5
      UNION ALL SELECT *, 'code-level', 'conservative' FROM m WHERE category = 'code' AND rate > 0.7 UNION ALL SELECT *, 'json-level', 'aggressive' FROM m WHERE category = 'json' AND c > 0 AND rate < 0.1)""",
)
def policy_rules(t: Tables) -> DataFrame:
    return C.policy(A.feedback_marginals(t.feedback()))


@query(
    "adjustment_audit",
    "K03",
    f"""WITH m AS (SELECT dimension, category, c, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE r / c END AS rate FROM {_MARG}), p AS (SELECT *, 'graph-weight' AS a, '+0.1' AS v FROM m WHERE category = 'graph' AND rate > 0.6 UNION ALL SELECT *, 'graph-level', 'conservative' FROM m WHERE category = 'graph' AND rate > 0.6
      UNION ALL SELECT *, 'fts-level', 'aggressive' FROM m WHERE category = 'fts' AND c > 0 AND rate < 0.05 UNION ALL SELECT *, 'kind-boost', '+0.2' FROM m WHERE dimension = 'kind' AND c > 0 AND rate > 0.5
      UNION ALL SELECT *, 'code-level', 'conservative' FROM m WHERE category = 'code' AND rate > 0.7 UNION ALL SELECT *, 'json-level', 'aggressive' FROM m WHERE category = 'json' AND c > 0 AND rate < 0.1)
    SELECT CASE WHEN suffix(a, 'weight') THEN 'route-weight' WHEN suffix(a, 'boost') THEN 'kind-boost' ELSE 'compression-level' END AS type, a || '.' || category AS field, CASE a WHEN 'graph-weight' THEN '1.25' WHEN 'kind-boost' THEN '0' ELSE 'auto' END AS old_value, v AS new_value, dimension || ':' || category || ' retrieval rate ' || printf('%.3f', round(rate, 6)) AS reason FROM p""",
)
def adjustment_audit(t: Tables) -> DataFrame:
    """What feedback changes, with the value before and the reason."""
    rows = C.audit(C.policy(A.feedback_marginals(t.feedback())), {"graph-weight": "1.25", "kind-boost": "0"}, F.current_timestamp())
    return rows.drop("adjusted_at")


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in sorted(C.FAILURES.items())) + "], lambda x: x IS NOT NULL)"
_MADE = "(SELECT role, CASE WHEN turn % 5 = 0 THEN text || ' no results' WHEN turn % 7 = 0 THEN text || ' index is stale' ELSE text END AS text FROM conversations)"


@query("failure_patterns_having", "A11 K04", f"SELECT type, count(*) AS n, array_to_string(list_sort(list(DISTINCT role)), ',') AS files FROM (SELECT role, unnest({_FLAGS}) AS type FROM {_MADE}) GROUP BY type HAVING count(*) >= 3")
def failure_patterns_having(t: Tables) -> DataFrame:
    rows = C.failure_patterns(_logs(t))
    return rows.select("type", "n", F.array_join("files", ",").alias("files"))


def _logs(t: Tables) -> DataFrame:
    made = F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" no results"))).when(F.col("turn") % 7 == 0, F.concat("text", F.lit(" index is stale"))).otherwise(F.col("text"))
    return t.conversations.select(made.alias("text"), F.col("role").alias("file"))


_LESSON = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LESSONS.items()) + " END"


@query(
    "learned_rules",
    "K05",
    f"""WITH p AS (SELECT type, count(*) AS n, list_sort(list(DISTINCT role)) AS files FROM (SELECT role, unnest({_FLAGS}) AS type FROM {_MADE}) GROUP BY type HAVING count(*) >= 3),
    l AS (SELECT string_agg('- **' || type || '** (' || n || ' occurrence' || CASE WHEN n = 1 THEN '' ELSE 's' END || ', confidence ' || printf('%.2f', least(0.95, 0.5 + n * 0.05)) || '): ' || {_LESSON} || ' Affected files: ' || array_to_string(files, ', ') || '.', chr(10) ORDER BY n DESC, type) AS lines,
      string_agg('{{"type":"' || type || '","n":' || n || ',"files":["' || array_to_string(files, '","') || '"]}}', ',' ORDER BY n DESC, type) AS json FROM p)
    SELECT f.format, CASE WHEN f.title IS NULL THEN '{{"patterns":[' || coalesce(json, '') || ']}}' ELSE '# Learned ' || f.title || ' Guidance' || chr(10) || chr(10) || coalesce(lines, '- Nothing failed often enough to learn from.') || chr(10) END AS content FROM l, (VALUES {", ".join(f"('{k}', '{v}')" for k, v in C.FORMATS.items())}, ('json', NULL)) f(format, title)""",
)
def learned_rules(t: Tables) -> DataFrame:
    """What session logs teach, in each format."""
    return C.rules(C.failure_patterns(_logs(t)))


_SAID = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'review' ELSE 'retrieve' END AS tool, lower(text || CASE conv_id % 6 WHEN 0 THEN ' no results' WHEN 1 THEN ' a False Positive' WHEN 2 THEN ' lost context' WHEN 3 THEN ' the index is stale' ELSE '' END) AS t, conv_id % 5 = 0 AS nothing, conv_id % 7 = 0 AS late FROM conversations"


@query(
    "failures_of_logs",
    "K04",
    f"""SELECT conv_id, turn, array_to_string(list_filter([
      CASE WHEN (tool = 'retrieve' OR regexp_matches(t, 'retrieve|compression|compressed')) AND regexp_matches(t, 'missing detail|lost context|too aggressive|over.?aggressive|insufficient context|no content found|not enough context') THEN 'compression-over-aggressive' END,
      CASE WHEN tool = 'search' AND (nothing OR regexp_matches(t, '\\b(0 results|no results|no matches|not found)\\b')) THEN 'empty-search' END,
      CASE WHEN tool = 'review' AND regexp_matches(t, 'false positive|ignored|dismissed|already (handled|covered|implemented)|not applicable|no action needed') THEN 'review-false-positive' END,
      CASE WHEN late OR regexp_matches(t, '\\bstale\\b|out[- ]of[- ]date|pending sync|needs? (sync|reindex)|index missing|not indexed') THEN 'stale-index' END], lambda x: x IS NOT NULL), ',') AS types FROM ({_SAID})""",
)
def failures_of_logs(t: Tables) -> DataFrame:
    """Failures told by tool, text and payload of every turn, its text three levels deep in the JSON of its output."""
    from lumenfold.functions import nested

    conv, turn = F.col("conv_id"), F.col("turn")
    tool = F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "review").otherwise("retrieve")
    said = F.concat("text", F.when(conv % 6 == 0, " no results").when(conv % 6 == 1, " a False Positive").when(conv % 6 == 2, " lost context").when(conv % 6 == 3, " the index is stale").otherwise(""))
    nothing, late = F.when(conv % 5 == 0, F.array().cast("array<string>")), F.when(conv % 7 == 0, F.struct(F.lit(False).alias("isFresh")))
    inner = F.to_json(F.struct(F.array(F.struct(said.alias("note"))).alias("items"), nothing.alias("nodes"), late.alias("freshness")))
    output = F.to_json(F.struct(inner.alias("content"), (turn % 2 == 0).alias("ok")))
    return t.conversations.select("conv_id", "turn", F.array_join(nested.failures(tool, F.lit(""), output), ",").alias("types"))


@query(
    "redact_nested",
    "F21",
    """SELECT conv_id, turn, '{"user":"u' || conv_id || '","auth":{api_key=[REDACTED],"tries":' || turn || '},"said":["Bearer [REDACTED]","n' || turn || '",{Password=[REDACTED]}]}' AS clean FROM conversations""",
)
def redact_nested(t: Tables) -> DataFrame:
    """Every turn's log entry, with secrets at three depths, the text itself under a sensitive name."""
    from lumenfold.functions import nested

    auth = F.struct("role", "turn")
    auth = F.struct(auth.alias("api_key"), F.col("turn").alias("tries"))
    said = F.concat(F.lit('["Bearer abc.'), F.col("turn").cast("string"), F.lit('","n'), F.col("turn").cast("string"), F.lit('",'), F.to_json(F.struct(F.col("text").alias("Password"))), F.lit("]"))
    entry = F.concat(F.lit('{"user":"u'), F.col("conv_id").cast("string"), F.lit('","auth":'), F.to_json(auth), F.lit(',"said":'), said, F.lit("}"))
    return t.conversations.select("conv_id", "turn", nested.redacted(entry).alias("clean"))


@query("state_transitions", "T04 T05", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND state = 'fresh' THEN 'stale' WHEN doc_id % 6 = 0 AND state = 'pending' THEN 'fresh' ELSE state END AS state FROM {SQL_MANIFEST}")
def state_transitions(t: Tables) -> DataFrame:
    changed, synced = F.col("doc_id") % 4 == 0, F.col("doc_id") % 6 == 0
    state = F.when(changed & (F.col("state") == "fresh"), "stale").when(synced & (F.col("state") == "pending"), "fresh").otherwise(F.col("state"))
    return t.manifest().select("doc_id", state.alias("state"))


@query("incremental_refresh_set", "T06 J13", f"WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, content_hash AS had, state FROM {SQL_MANIFEST} WHERE doc_id % 7 <> 0), s AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 9 <> 0) SELECT coalesce(m.file_path, s.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'remove' ELSE 'refresh' END AS action FROM m FULL JOIN s ON m.file_path = s.file_path WHERE s.file_path IS NULL OR m.file_path IS NULL OR had <> content_hash OR state <> 'fresh'")
def incremental_refresh_set(t: Tables) -> DataFrame:
    manifest = t.manifest().where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("file_path"), "content_hash", "state", F.lit(1).alias("n_docs"))
    d = t.documents.where("doc_id % 9 <> 0")
    snapshot = d.select(F.col("doc_id").cast("string").alias("file_path"), F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_hash"))
    return Fr.refresh_sets(manifest, snapshot)


def _changes(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "change").when(F.col("event_type") == "click", "wait").when(F.col("event_type") == "purchase", "sync").otherwise("error")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), kind.alias("kind"))


_STATES = "SELECT 'f' || user_id AS file, CASE arg_max(event_type, (ts, event_id)) WHEN 'view' THEN 'stale' WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'fresh' ELSE 'failed' END AS state, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id"


@query("batch_manifest", "T02 T05", _STATES)
def batch_manifest(t: Tables) -> DataFrame:
    return Fr.final_states(_changes(t.events))


@query("stream_manifest", "T01 T02 T08", _STATES)
def stream_manifest(t: Tables) -> DataFrame:
    return Fr.streamed(t.spark, f"{t.sf_dir}/events.parquet", _changes)


@query(
    "stream_machine",
    "T01 T02 T03 T05 T12",
    """WITH e AS (SELECT 'f' || user_id AS file, event_id, epoch_ms(ts) AS t, CASE WHEN event_type IN ('view', 'click') THEN 'change' WHEN event_type = 'purchase' THEN 'sync' ELSE 'error' END AS kind FROM events),
    o AS (SELECT *, row_number() OVER w AS n, coalesce(lead(t) OVER w, (SELECT max(t) FROM e)) AS until FROM e WINDOW w AS (PARTITION BY file ORDER BY t, event_id)),
    x AS (SELECT *, kind = 'change' AND t + 600000 <= until AS waited, t + 7200000 <= until AS ended FROM o),
    l AS (SELECT file, max(n) AS last, coalesce(max(n) FILTER (kind = 'sync'), 0) AS synced, coalesce(max(n) FILTER (waited OR ended), 0) AS emptied, count(*) + count(*) FILTER (waited) + count(*) FILTER (ended) AS seq FROM x GROUP BY file)
    SELECT x.file, CASE WHEN ended THEN 'expired' WHEN waited THEN 'pending' WHEN kind = 'change' THEN 'stale' WHEN kind = 'sync' THEN 'fresh' ELSE 'failed' END AS state,
      CASE WHEN synced > 0 AND emptied < synced THEN (SELECT 'd' || y.event_id FROM x y WHERE y.file = x.file AND y.n = synced) ELSE '' END AS doc_ids, x.event_id, l.seq FROM x JOIN l ON l.file = x.file AND l.last = x.n""",
)
def stream_machine(t: Tables) -> DataFrame:
    """Where a stream of changes, syncs and errors leaves every file: pending ten minutes after a change, gone after two hours."""
    from lumenfold.streaming import machine as M

    def changes(events: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type").isin("view", "click"), "change").when(F.col("event_type") == "purchase", "sync").otherwise("error")
        ids = F.when(kind == "sync", F.array(F.concat(F.lit("d"), F.col("event_id").cast("string"))))
        return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), kind.alias("kind"), F.sha2("props", 256).alias("content_hash"), ids.alias("doc_ids"))

    moves = M.replayed(t.spark, f"{t.sf_dir}/events.parquet", changes, debounce_ms=600_000, live_ms=7_200_000)
    last = moves.groupBy("file").agg(F.max("seq").alias("seq"))
    return M.current(moves).join(last, "file").select("file", "state", F.array_join("doc_ids", ",").alias("doc_ids"), "event_id", "seq")


@query("stream_debounced", "T03", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT 'f' || user_id AS file, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, s.n")
def stream_debounced(t: Tables) -> DataFrame:
    return Fr.debounced(_changes(t.events)).select("file", F.unix_micros("start").alias("start_us"), "n")


@query("ttl_over_time", "T12", "SELECT event_id, ts + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events) AS expired FROM events")
def ttl_over_time(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now)).select("event_id", (F.col("ts") + F.expr("INTERVAL 30 MINUTE") < F.col("now")).alias("expired"))  # one row


@query("snapshot_modes", "S02 S08", "SELECT doc_id AS node_id, length(text) AS full_chars, CASE WHEN source IN ('src1', 'src2') THEN length(text) END AS some_chars FROM documents")
def snapshot_modes(t: Tables) -> DataFrame:
    """A snapshot that was written and is read whole, without contents, and with those of two files."""
    from lumenfold.sources import collections, storage

    nodes = t.nodes()
    path = storage.reused("snapshot", [nodes], ("nodes",), lambda to: collections.write_snapshot(nodes, to))  # once for the same files
    read = lambda mode: collections.read_snapshot(t.spark, path, mode, ["src1", "src2"])
    full, some = read("full").select("node_id", F.length("content").cast("bigint").alias("full_chars")), read("files").select("node_id", F.length("content").cast("bigint").alias("some_chars"))
    return read("lite").select("node_id").join(full, "node_id").join(some, "node_id")


@query("collection_lifecycle", "S10 S11 S12", "SELECT 'vd_' || left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || 'local'), 32) AS id, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source NOT IN ('src1', 'src2')")
def collection_lifecycle(t: Tables) -> DataFrame:
    """A collection after an upsert of all documents, one of every third, a deletion of two files' and a compaction."""
    from lumenfold.sources import collections, storage

    path = storage.scratch(t.spark)
    key = t.documents.select(F.col("doc_id").cast("string").alias("node"), F.lit("local").alias("profile"), F.col("source").alias("file_path"), "n_chars", "doc_id")
    docs = key.select(collections.document_id("node", "profile").alias("id"), "file_path", "n_chars", "doc_id")
    collections.upsert(docs.drop("doc_id"), path)
    collections.upsert(docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1).drop("doc_id"), path)
    collections.delete_files(t.spark, path, t.documents.where("source in ('src1', 'src2')").select(F.col("source").alias("file_path")))
    collections.optimize(t.spark, path)
    return collections.read(t.spark, path).select("id", "n_chars")


@query(
    "incremental_sync",
    "T06 T08 S12 S13 S15 R27",
    f"""WITH n AS (SELECT *, min(node_id) OVER (PARTITION BY file_path) AS first FROM {SQL_CODE}), d AS (SELECT file_path, 'vd_' || left(sha256(CAST(node_id AS VARCHAR) || chr(0) || 'local' || chr(0) || 'v1'), 32) AS id, content || CASE WHEN first % 4 = 1 THEN ' changed' ELSE '' END AS content, first FROM n WHERE first % 5 <> 2)
    SELECT id, file_path, sha256(content) AS content_hash, 'fresh' AS state, count(*) OVER (PARTITION BY file_path) AS n_docs, CAST(CASE WHEN first % 4 = 1 OR first % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS held FROM d""",
)
def incremental_sync(t: Tables) -> DataFrame:
    """An index built of most source files, then synced with their next version: some are new, changed or gone.

    Told are its documents with their file's state and the generation that wrote them: the second for new and changed files only."""
    from lumenfold.sources import collections, storage, sync

    code = t.code()
    first = code.groupBy("file_path").agg(F.min("node_id").alias("first"))
    code = code.join(first, "file_path").select("node_id", "file_path", "content", "first")
    later = code.where("first % 5 <> 2").withColumn("content", F.concat("content", F.when(F.col("first") % 4 == 1, " changed").otherwise("")))

    def told(nodes: DataFrame) -> tuple[DataFrame, object]:
        doc_id = collections.document_id(F.col("node_id").cast("string"), F.lit("local"), F.lit("v1"))
        docs = nodes.select("file_path", doc_id.alias("id"), F.sha2("content", 256).alias("content_hash"))
        return docs.groupBy("file_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), ""), 256).alias("content_hash")), lambda files: docs.join(files, "file_path", "left_semi")

    path = storage.scratch(t.spark)
    for version in (code.where("first % 7 <> 3"), later):
        sync.sync(t.spark, path, *told(version))
    known = sync.manifest(t.spark, path).select("file_path", "state", F.size("doc_ids").cast("bigint").alias("n_docs"), "held")
    return sync.documents(t.spark, path).join(known, "file_path").select("id", "file_path", "content_hash", "state", "n_docs", "held")


@query("session_logs", "S18", "SELECT conv_id, turn, role AS tool_name, length(text) AS chars, turn * 10 AS duration_ms FROM conversations")
def session_logs(t: Tables) -> DataFrame:
    """Logs in files of one JSON entry a line, read back."""
    from lumenfold.sources import session_logs as logs
    from lumenfold.sources import storage

    path = storage.scratch(t.spark)
    entry = F.struct(F.col("role").alias("toolName"), F.struct("conv_id", "turn").alias("input"), F.col("text").alias("output"), (F.col("turn") * 10).alias("durationMs"))
    t.conversations.select(F.to_json(entry).alias("value")).write.text(path)
    rows = logs.read(t.spark, path)
    return rows.select(F.get_json_object("input", "$.conv_id").cast("bigint").alias("conv_id"), F.get_json_object("input", "$.turn").cast("bigint").alias("turn"), "tool_name", F.length("output").cast("bigint").alias("chars"), "duration_ms")
