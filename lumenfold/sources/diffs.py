"""Unified diffs: added lines with their files, and the functions, imports and classes they declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How the language writes declarations.
_FUNCTION = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*(?::\s*([^ {;]+(?:\s*[^ {;]+)*))?"
_ARROW = r"^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|([A-Za-z_$][\w$]*))\s*(?::\s*([^=]+?))?\s*=>"
_FROM, _ALONE = r"""^import\s+(.+?)\s+from\s+['"]([^'"]+)['"]""", r"""^import\s+['"]([^'"]+)['"]"""
_CLASS = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([A-Za-z_$][\w$.]*))?(?:\s+implements\s+([^<{]+(?:<[^>]+>)?[^ {]*))?"


def added_lines(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, content) -> diff_id, at, file_path, line: each added line with the file named last above
    it, without white space around it; blank lines and line comments are left out."""
    lines = diffs.select("diff_id", F.posexplode(F.split("content", "\r?\n")).alias("at", "raw"))
    named = F.when(F.col("raw").startswith("+++ "), F.regexp_replace(F.trim(F.substring("raw", 5, 4096)), "^[ab]/", ""))
    above = Window.partitionBy("diff_id").orderBy("at")
    lines = lines.withColumn("file_path", F.last(named, ignorenulls=True).over(above))
    kept = F.col("raw").startswith("+") & ~F.col("raw").startswith("+++")
    rows = lines.where(kept).select("diff_id", "at", F.nullif(F.col("file_path"), F.lit("/dev/null")).alias("file_path"), F.regexp_replace(F.expr("substring(raw, 2)"), r"^\s+|\s+$", "").alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("//"))


def _signature(name: Column, params: Column, returned: Column) -> Column:
    spaced = F.trim(F.regexp_replace(params, r"\s+", " "))
    return F.concat(F.lit("function "), name, F.lit("("), spaced, F.lit(")"), F.coalesce(F.concat(F.lit(": "), returned), F.lit("")))


def additions(diffs: DataFrame) -> DataFrame:
    """diff_id, file_path, type (function, import, class), name, detail, local: what added lines declare.

    Of functions and classes, detail is the signature; of imports name is the module, detail the imported
    name (* for all, default for the default, null if only the module is run) and local what it is called here."""
    lines = added_lines(diffs)
    get = lambda p, k: F.nullif(F.trim(F.regexp_extract("line", p, k)), F.lit(""))
    empty = lambda c: F.coalesce(c, F.lit(""))
    none = F.lit(None).cast("string").alias("local")
    plain, arrow = get(_FUNCTION, 1), get(_ARROW, 1)
    made = F.when(plain.isNotNull(), _signature(plain, empty(get(_FUNCTION, 2)), get(_FUNCTION, 3))).otherwise(_signature(arrow, F.coalesce(get(_ARROW, 2), get(_ARROW, 3), F.lit("")), get(_ARROW, 4)))
    functions = lines.where(F.coalesce(plain, arrow).isNotNull()).select("diff_id", "file_path", F.lit("function").alias("type"), F.coalesce(plain, arrow).alias("name"), made.alias("detail"), none)

    said = get(_FROM, 1)
    pair = lambda name, local: F.struct(name.alias("detail"), local.alias("local"))
    items = F.filter(F.transform(F.split(F.regexp_replace(said, r"^\{|\}$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda x: F.split(x, r"(?i)\s+as\s+")
    listed = F.transform(items, lambda x: pair(F.trim(parts(x)[0]), F.trim(F.coalesce(F.get(parts(x), F.lit(1)), parts(x)[0]))))
    star = F.array(pair(F.lit("*"), F.trim(F.substring(said, 6, 4096))))
    default = F.array(pair(F.lit("default"), F.trim(F.split(said, ",")[0])))
    found = F.when(said.startswith("{") & said.endswith("}"), listed).when(said.startswith("* as "), star).when(F.trim(F.split(said, ",")[0]) != "", default)
    imports = lines.where(get(_FROM, 2).isNotNull()).select("diff_id", "file_path", F.lit("import").alias("type"), get(_FROM, 2).alias("name"), F.explode(found).alias("i")).select("diff_id", "file_path", "type", "name", "i.detail", "i.local")
    alone = lines.where(get(_FROM, 2).isNull() & get(_ALONE, 1).isNotNull()).select("diff_id", "file_path", F.lit("import").alias("type"), get(_ALONE, 1).alias("name"), F.lit(None).cast("string").alias("detail"), none)

    names = F.array_join(F.filter(F.transform(F.split(get(_CLASS, 3), ","), lambda x: F.trim(x)), lambda x: x != ""), ", ")
    shown = F.concat_ws(" ", F.concat(F.lit("class "), get(_CLASS, 1)), F.concat(F.lit("extends "), get(_CLASS, 2)), F.concat(F.lit("implements "), F.nullif(names, F.lit(""))))
    classes = lines.where(get(_CLASS, 1).isNotNull()).select("diff_id", "file_path", F.lit("class").alias("type"), get(_CLASS, 1).alias("name"), shown.alias("detail"), none)
    return functions.unionByName(imports).unionByName(alone).unionByName(classes)
