"""Session logs from JSON: arrays, {"logs": [...]} wrappers, single objects or a line each, with other spellings of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of each field.
ALIASES = {"tool_name": ["toolName", "tool_name", "tool"], "input": ["input"], "output": ["output"], "recorded_at": ["recordedAt", "recorded_at", "timestamp"], "duration_ms": ["durationMs", "duration_ms"], "error": ["error"]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """tool_name, input, output, recorded_at, duration_ms, error of every entry in the files at `path`.

    What is not JSON is left out; a missing field is null; input and output may be any JSON and stay text."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("raw"))
    # a first line that is JSON by itself says that every line is an entry
    by_line = F.try_parse_json(F.split_part("raw", F.lit("\n"), F.lit(1))).isNotNull()
    one = whole.where(~by_line & F.try_parse_json("raw").isNotNull())
    lines = whole.where(by_line | F.try_parse_json("raw").isNull()).select(F.explode(F.split("raw", "\r?\n")).alias("raw"))
    documents = one.unionByName(lines.select(F.trim("raw").alias("raw")).where(F.try_parse_json("raw").isNotNull()))
    inner = F.coalesce(F.get_json_object("raw", "$.logs"), F.col("raw"))
    items = F.when(inner.startswith("["), F.from_json(inner, "array<string>")).otherwise(F.array(inner))
    rows = documents.select(F.explode(items).alias("item"))
    pick = lambda names: F.coalesce(*(F.get_json_object("item", f"$.{n}") for n in names))
    out = rows.select(*(pick(v).alias(k) for k, v in ALIASES.items()))
    return out.withColumn("recorded_at", F.col("recorded_at").try_cast("bigint")).withColumn("duration_ms", F.col("duration_ms").try_cast("bigint"))
