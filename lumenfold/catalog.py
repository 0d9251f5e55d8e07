"""Tables of a data directory, and the views that stand in for a code graph's entities.

Documents stand for symbol nodes with text, parts for short-named symbols, lineitem for call edges,
events for feedback, conversations for session logs, documents with labels for the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("function", "class", "method", "interface", "component")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


class Tables:
    """Tables by name; each is read with the columns a query selects, no more."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """Documents as nodes: node_id, kind, file_path, language, content."""
        kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
        return self.documents.select(F.col("doc_id").alias("node_id"), kind.alias("kind"), F.col("source").alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"))

    def symbols(self) -> DataFrame:
        """Parts as symbols: node_id, name, qualified_name, kind, file_path."""
        return self.part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file_path"))

    def calls(self) -> DataFrame:
        """Line items as call edges: caller (order), callee (part)."""
        return self.lineitem.select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"))

    def flows(self) -> DataFrame:
        """Parts as callers of the part in the next line of the same order: caller, callee, each pair once."""
        return self._steps().distinct()

    def _steps(self) -> DataFrame:
        after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
        return self.lineitem.select(F.col("l_partkey").alias("caller"), after.alias("callee")).where("callee <> caller")

    def code(self) -> DataFrame:
        """Parts as symbols of source files: node_id, name, qualified_name, kind, language, file_path, signature, docstring, content."""
        one, two, folder = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type")
        name = F.concat(_capital(one), _capital(two))
        path = F.concat(F.lit("src/"), folder, F.lit("/"), one, F.lit("_"), two, F.when(F.col("p_partkey") % 7 == 0, ".test.ts").otherwise(".ts"))
        is_class = F.col("p_partkey") % 2 == 0
        a_class = F.concat(F.lit("class "), name, F.lit(" extends "), _capital(folder), F.lit("Base implements "), _capital(two), F.lit(", Sized"))
        a_function = F.concat(F.lit("function "), one, _capital(two), F.lit("(size: number): "), _capital(two))
        signature = F.when(is_class, a_class).otherwise(a_function)
        imports = F.concat(F.lit('import { x } from "./'), one, F.lit("_"), two, F.lit('";\nimport "../'), folder, F.lit("/"), one, F.lit("_"), two, F.lit('";\n'))
        doc = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_brand"))
        kind = F.when(is_class, "class").otherwise("function")
        return self.part.select(F.col("p_partkey").alias("node_id"), name.alias("name"), F.concat(folder, F.lit("::"), name).alias("qualified_name"), kind.alias("kind"), F.lit("typescript").alias("language"), path.alias("file_path"), signature.alias("signature"), doc.alias("docstring"), F.concat(imports, signature, F.lit(" {}")).alias("content"))

    def code_calls(self) -> DataFrame:
        """Calls of `code`: caller (a node) and the name it calls, each pair once."""
        return self._named_steps().distinct()

    def said(self) -> DataFrame:
        """What the nodes of `code` call: node_id, calls (names, each once, sorted). Pairs meet once, at their caller."""
        return self._named_steps().groupBy(F.col("caller").alias("node_id")).agg(F.array_sort(F.collect_set("call")).alias("calls"))

    def _named_steps(self) -> DataFrame:
        names = self.code().select(F.col("node_id").alias("callee"), F.col("name").alias("call"))
        return self._steps().join(names, "callee").select("caller", "call")

    def manifest(self) -> DataFrame:
        """Documents with the state of their index entry: doc_id, file_path, state, content_hash."""
        state = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "stale").otherwise("fresh")
        rows = self.documents.join(self.labels, "doc_id", "left")
        return rows.select("doc_id", F.col("source").alias("file_path"), state.alias("state"), F.sha2("text", 256).alias("content_hash"))

    def feedback(self) -> DataFrame:
        """Events as feedback: ts, stream, hash, source, content_type, kind."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        stream = F.when(F.col("event_type").isin("view", "click"), "retrieval").otherwise("compression")
        source = F.element_at(F.array(F.lit("graph"), F.lit("vector"), F.lit("fts")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
        content = F.element_at(F.array(F.lit("json"), F.lit("code"), F.lit("text")), (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int"))
        return self.events.select("event_id", "ts", stream.alias("stream"), k.alias("hash"), source.alias("source"), content.alias("content_type"), F.col("event_type").alias("kind"))


#: The same views for the SQL side.
SQL_NODES = "(SELECT doc_id AS node_id, CASE doc_id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' ELSE 'component' END AS kind, source AS file_path, lang AS language, text AS content FROM documents)"
SQL_SYMBOLS = "(SELECT p_partkey AS node_id, p_name AS name, p_brand || '::' || p_name AS qualified_name, p_type AS kind, p_brand AS file_path FROM part)"
SQL_CALLS = "(SELECT l_orderkey AS caller, l_partkey AS callee FROM lineitem)"
SQL_FLOWS = "(SELECT DISTINCT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee FROM lineitem) WHERE callee <> caller)"
SQL_MANIFEST = "(SELECT d.doc_id, d.source AS file_path, CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'stale' ELSE 'fresh' END AS state, sha256(d.text) AS content_hash FROM documents d LEFT JOIN labels l USING (doc_id))"
SQL_FEEDBACK = "(SELECT event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'retrieval' ELSE 'compression' END AS stream, k AS hash, CASE k % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'vector' ELSE 'fts' END AS source, CASE user_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'code' ELSE 'text' END AS content_type, event_type AS kind FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"


def _sql_capital(x: str) -> str:
    return f"(upper(left({x}, 1)) || substr({x}, 2))"


_ONE, _TWO = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_NAME = f"{_sql_capital(_ONE)} || {_sql_capital(_TWO)}"
_SIGNATURE = f"CASE WHEN p_partkey % 2 = 0 THEN 'class ' || {_NAME} || ' extends ' || {_sql_capital('lower(p_type)')} || 'Base implements ' || {_sql_capital(_TWO)} || ', Sized' ELSE 'function ' || {_ONE} || {_sql_capital(_TWO)} || '(size: number): ' || {_sql_capital(_TWO)} END"
_IMPORTS = f"""'import {{ x }} from "./' || {_ONE} || '_' || {_TWO} || '";' || chr(10) || 'import "../' || lower(p_type) || '/' || {_ONE} || '_' || {_TWO} || '";' || chr(10)"""
SQL_CODE = f"(SELECT p_partkey AS node_id, {_NAME} AS name, lower(p_type) || '::' || {_NAME} AS qualified_name, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'function' END AS kind, 'typescript' AS language, 'src/' || lower(p_type) || '/' || {_ONE} || '_' || {_TWO} || CASE WHEN p_partkey % 7 = 0 THEN '.test.ts' ELSE '.ts' END AS file_path, {_SIGNATURE} AS signature, CASE WHEN p_partkey % 3 <> 0 THEN 'The ' || p_name || ' of ' || p_brand END AS docstring, {_IMPORTS} || {_SIGNATURE} || ' {{}}' AS content FROM part)"
SQL_CODE_CALLS = f"(SELECT DISTINCT f.caller, c.name AS call FROM {SQL_FLOWS} f JOIN {SQL_CODE} c ON f.callee = c.node_id)"
