"""Findings of a review: what is declared twice, what nothing calls, what was said before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.sources import collections


def findings(symbols: DataFrame, called: DataFrame) -> DataFrame:
    """type, subject: symbols whose signature an earlier one has, and symbols that nothing calls."""
    keyed = symbols.select("node_id", T.signature_key(F.col("name")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("node_id").alias("first"))
    same = keyed.join(first, "key").where("node_id > first").select(F.lit("same-signature").alias("type"), F.col("node_id").alias("subject"))
    dead = symbols.join(called, "node_id", "left_anti").select(F.lit("dead-code").alias("type"), F.col("node_id").alias("subject"))
    return same.unionByName(dead)


def signature(kind: Column, evidence: Column, keys: tuple[str, ...]) -> Column:
    """type:subject, the subject from the first of the keys that the evidence (JSON) has."""
    return F.concat(kind, F.lit(":"), F.coalesce(*(F.get_json_object(evidence, f"$.{k}") for k in keys), F.lit("none")))


def discussed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `discussed`: an earlier row (by order) has the same keys. The earliest of a key is an
    aggregate that combines before the shuffle; no key's rows meet in one task."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    both = same[0]
    for c in same[1:]:
        both = both & c
    joined = rows.alias("r").join(first.alias("f"), both)
    return joined.select("r.*", (F.struct(*(F.col(f"r.{o}") for o in order)) != F.col("__first")).alias("discussed"))


def review(added: DataFrame, existing: DataFrame, imports: DataFrame, calls: DataFrame, most_callers: int = 1) -> DataFrame:
    """type, subject, file_path: what four finders say of added symbols (node_id, name, kind, file_path, signature).

    same-signature: an existing symbol has it; similar-class: an existing class of another name extends the same;
    redundant-import: an added import (file_path, specifier, is_added) stands in its file already; unneeded: a class
    or function of whose callers there is evidence (calls: caller, call), `most_callers` or fewer; without evidence
    nothing is said. Each finder is one join on equal keys."""
    key = T.signature_key(F.col("signature"))
    found = lambda kind, df: df.select(F.lit(kind).alias("type"), F.col("name").alias("subject"), "file_path").distinct()
    same = added.withColumn("__key", key).join(existing.select(key.alias("__key")).distinct(), "__key", "left_semi")
    base = lambda df: df.where("kind = 'class'").withColumn("__base", F.nullif(F.lower(F.regexp_extract("signature", r"(?i)extends\s+([A-Za-z0-9_.:<>]+)", 1)), F.lit("")))
    # a class of another name: the base's least or greatest name is not its own
    ends = base(existing).where("__base is not null").groupBy("__base").agg(F.min("name").alias("__low"), F.max("name").alias("__high"))
    similar = base(added).join(ends, "__base").where("__low <> name or __high <> name")
    before = imports.where("not is_added").select("file_path", "specifier").distinct()
    twice = imports.where("is_added").join(before, ["file_path", "specifier"], "left_semi").withColumn("name", F.col("specifier"))
    counts = calls.groupBy(F.col("call").alias("name")).agg(F.count("caller").alias("__n"))
    unneeded = added.where("kind in ('class', 'function')").join(counts, "name").where(F.col("__n") <= most_callers)
    return found("same-signature", same).unionByName(found("similar-class", similar)).unionByName(found("redundant-import", twice)).unionByName(found("unneeded", unneeded))


def remember(said: DataFrame, path: str) -> None:
    """Findings (scope, signature) into the store of what was discussed."""
    collections.upsert(said.select(F.sha2(F.concat_ws("\0", "scope", "signature"), 256).alias("id"), "scope", "signature"), path)


def remembered(findings: DataFrame, path: str) -> DataFrame:
    """findings (scope, signature) with `discussed`: the store has them in their scope."""
    known = collections.read(findings.sparkSession, path)
    if known is None:
        return findings.withColumn("discussed", F.lit(False))
    marked = known.select("scope", "signature", F.lit(True).alias("discussed"))
    return findings.join(marked, ["scope", "signature"], "left").withColumn("discussed", F.coalesce("discussed", F.lit(False)))
