"""A regular-expression scanner of source text: declarations, where they end, and what they call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T

#: Words before a parenthesis that are not calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new")


def declarations(files: DataFrame) -> DataFrame:
    """files (file_path, content) -> node_id, kind, name, file_path, language, start_line, end_line, calls.

    A declaration ends on the first line at or after it where as many braces are closed as
    opened since; without braces, on its own line. Null content has no lines."""
    lines = files.select("file_path", F.posexplode(F.split("content", "\r?\n")).alias("at", "line"))
    opened = F.length("line") - F.length(F.regexp_replace("line", r"\{", ""))
    closed = F.length("line") - F.length(F.regexp_replace("line", r"\}", ""))
    so_far = Window.partitionBy("file_path").orderBy("at")
    lines = lines.withColumn("opened", opened).withColumn("depth", F.sum(opened - closed).over(so_far)).withColumn("before", F.col("depth") - (opened - closed))
    kind = F.when(F.col("line").rlike(r"^\s*(export\s+)?(abstract\s+)?class\s+\w+"), "class").when(F.col("line").rlike(r"^\s*(export\s+)?interface\s+\w+"), "interface").when(F.col("line").rlike(r"^\s*(export\s+)?(async\s+)?function\s+\w+|^\s*(export\s+)?const\s+\w+\s*=\s*(async\s*)?\("), "function")
    found = lines.withColumn("kind", kind)
    starts = found.where("kind is not null").select("file_path", F.col("at").alias("start"), "kind", "before", F.regexp_extract("line", r"(?:class|interface|function|const)\s+(\w+)", 1).alias("name"), F.col("opened").alias("own"))
    inside = starts.join(lines.select("file_path", "at", "line", "depth"), "file_path").where("at >= start")
    ends = inside.groupBy("file_path", "start", "kind", "name", "before", "own").agg(F.min(F.when((F.col("depth") <= F.col("before")) & ((F.col("at") > F.col("start")) | (F.col("own") == 0) | (F.col("depth") == F.col("before"))), F.col("at"))).alias("end"))
    body = ends.join(lines.select("file_path", "at", "line"), "file_path").where("at >= start and at <= coalesce(end, start)")
    named = F.filter(F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1), lambda c: ~c.isin(*NOT_CALLS))
    calls = body.groupBy("file_path", "start", "kind", "name", "end").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(named)))).alias("calls"))
    return calls.select(T.rolling_hash31(F.concat_ws(":", "file_path", "name", "start")).alias("node_id"), "kind", "name", "file_path", T.language_of(F.col("file_path")).alias("language"), (F.col("start") + 1).alias("start_line"), (F.coalesce("end", "start") + 1).alias("end_line"), F.array_remove("calls", F.col("name")).alias("calls"))
