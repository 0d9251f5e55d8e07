"""Scans, filters and projections of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged_candidates(nodes: DataFrame, stages: list[Column], most: int, order: tuple[str, ...] = ("name", "node_id")) -> DataFrame:
    """Nodes that any selector takes, with the first that does (stage), the earliest stages first, `most` at most (16 to 2000)."""
    stage = F.coalesce(*(F.when(s, F.lit(i)) for i, s in enumerate(stages)))
    return nodes.withColumn("stage", stage).where("stage is not null").orderBy("stage", *order).limit(max(16, min(2000, most)))


def snippet(text: Column, first: int, last: int, most_lines: int = 80, most_chars: int = 6000) -> Column:
    """Lines first..last (from 1) of a text, cut to limits and without white space at the end."""
    lines = F.slice(F.split(text, "\r?\n"), first, min(last - first + 1, most_lines))
    return F.substring(F.rtrim(F.array_join(lines, "\n")), 1, most_chars)


#: Characters of a file that snippets are cut from.
LONGEST_FILE = 1 << 20


def is_inside(path: Column) -> Column:
    """A path that names a file of the project: relative, and never above its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (F.trim(path) != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")


def with_snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (node_id, file_path, first, last) with the lines of their files (file_path, content) as snippet.

    A file is cut once to what snippets may need; nodes of files that are not there, or outside, are left out."""
    cut = files.where(is_inside(F.col("file_path"))).select("file_path", F.split(F.substring("content", 1, LONGEST_FILE), "\r?\n").alias("__lines"))
    lines = F.slice("__lines", F.col("first"), F.least(F.col("last") - F.col("first") + 1, F.lit(80)))
    text = F.substring(F.rtrim(F.array_join(lines, "\n")), 1, 6000)
    return nodes.join(cut, "file_path").withColumn("snippet", text).drop("__lines")


def current(rows: DataFrame, profile: str, chunker: str, version: int) -> DataFrame:
    """Stored rows (profile, chunker, body: JSON) that the present code wrote."""
    of = F.try_variant_get(F.try_parse_json("body"), "$.version", "bigint")
    return rows.where((F.col("profile") == profile) & (F.col("chunker") == chunker) & (of == version))


# Fields of stored nodes, files and manifest entries, and the kind of each.
NODE_FIELDS = {"id": "STRING", "kind": "STRING", "name": "STRING", "calls": "ARRAY"}
FILE_FIELDS = {"path": "STRING", "contentHash": "STRING", "language": "STRING"}


def is_valid(text: Column, fields: dict[str, str]) -> Column:
    """Whether a text is a JSON object that has all the fields, each of its kind."""
    value = F.try_parse_json(text)
    kinds = (F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")).startswith(kind) for name, kind in fields.items())
    ok = F.lit(True)
    for k in kinds:
        ok = ok & F.coalesce(k, F.lit(False))
    return ok


def summarised(nodes: DataFrame) -> DataFrame:
    """nodes without contents, scores to four decimals, empty texts as null."""
    kept = [F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in nodes.dtypes if c not in ("content", "score")]
    return nodes.select(*kept, F.round("score", 4).alias("score"))


def filtered(nodes: DataFrame, filters: dict[str, str], names: tuple[str, ...] = ("name", "qualified_name")) -> DataFrame:
    """Scalar filters: kind, language and file are equal, path is a prefix, name is contained in any case."""
    for key, column in (("kind", "kind"), ("language", "language"), ("file", "file_path")):
        if key in filters:
            nodes = nodes.where(F.col(column) == filters[key])
    if "path" in filters:
        nodes = nodes.where(F.col("file_path").startswith(filters["path"]))
    if "name" in filters:
        hits = [F.lower(n).contains(filters["name"].lower()) for n in names]
        nodes = nodes.where(hits[0] if len(hits) == 1 else hits[0] | hits[1])
    return nodes


def contains_all(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    found = F.lower(column)
    for term in terms:
        rows = rows.where(found.contains(term.lower()))
    return rows


def compact(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first row of each key, the first `most` of them, with their rank."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    top = first.orderBy(order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(order)))  # `most` rows


def latest_by(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of each key's last row, by an aggregate that combines before the shuffle."""
    last = F.max_by(F.struct(*values), order).alias("v")
    return rows.groupBy(*keys).agg(last, F.max(order).alias(order)).select(*keys, "v.*", order)


def capsule(nodes: DataFrame, query: str, most: int) -> DataFrame:
    """One row, content: a JSON capsule of the best `most` nodes (node_id, name, file_path, docstring, score) of a query, without empty fields."""
    few = summarised(nodes).orderBy(F.desc("score"), "node_id").limit(most)
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "node_id", "name", "file_path", "docstring", "score"))), lambda x: F.to_json(F.struct(x["node_id"].alias("id"), x["name"].alias("name"), x["file_path"].alias("file"), x["docstring"].alias("doc"), x["score"].alias("score"))))
    return few.agg(F.concat(F.lit('{"query":'), F.lit('"' + query.replace("\\", "\\\\").replace('"', '\\"') + '"'), F.lit(',"nodes":['), F.array_join(items, ","), F.lit("]}")).alias("content"))


def cached(candidates: DataFrame, *parts: str) -> DataFrame:
    """Candidates of a query and its options (parts) from the store, and into it if they are not there. What is stored is
    told by its source too: by what it selects, and by the names, sizes and times of the files that it reads."""
    from lumenfold.sources import storage

    path = storage.reused("candidates", [candidates], parts, lambda to: candidates.write.parquet(to))
    return candidates.sparkSession.read.schema(candidates.schema).parquet(path)


def sidecar_warnings(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """file_path and warning: where a manifest (file_path, n_docs, content_hash) and what is stored (file_path, content_hash) disagree."""
    held = stored.groupBy("file_path").agg(F.count("*").alias("held"), F.min("content_hash").alias("low"), F.max("content_hash").alias("high"))
    both = manifest.join(held, "file_path", "full_outer")
    warning = (
        F.when(F.col("n_docs").isNull(), "documents of a file that the manifest lacks")
        .when(F.col("held").isNull() & (F.col("n_docs") > 0), "no documents of a file in the manifest")
        .when(F.coalesce("held", F.lit(0)) != F.col("n_docs"), "another number of documents than the manifest says")
        .when((F.col("low") != F.col("content_hash")) | (F.col("high") != F.col("content_hash")), "documents of another content than the manifest's")
    )
    return both.select("file_path", warning.alias("warning")).where("warning is not null")
