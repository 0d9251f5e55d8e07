"""Positions and running totals within groups of any size, without a task that sees a whole group; keys of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.base import fresh, written

#: Bits of a signed long that hold a key.
_KEY_BITS = 62


def running(df: DataFrame, group: list[str], order: list[str], before: str, total: str | None = None, weight: Column | None = None) -> DataFrame:
    """df with `before`, the sum of weights (1 a row) of the rows before it in its group, in the order of the
    columns `order` (nulls first), and `total`, the sum over its group. Group columns must not be null.

    Rows are dealt by ranges of group and order. A range's sums, one row a range and group, say what lies
    before it; the rest is a window inside a range. Rows equal in group and order stand in any order."""
    part, w, start = (fresh(k, *df.columns, before, *([total] if total else [])) for k in ("__part", "__w", "__start"))
    ranged = df.withColumn(w, F.lit(1).cast("long") if weight is None else weight.cast("long")).repartitionByRange(*group, *(F.col(c).asc_nulls_first() for c in order))
    ranged = written(ranged.withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part, *group).agg(F.sum(w).alias(w))
    earlier = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(part, *group, F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(start), *([F.sum(w).over(W.partitionBy(*group)).alias(total)] if total else []))
    inside = W.partitionBy(part, *group).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(sums, [part, *group]).withColumn(before, F.col(start) + F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return out.select(*df.columns, before, *([total] if total else []))


@dataclass
class Keyed:
    """rows: a table with a column that tells its different texts apart; texts: doc_id (that key) and text, once
    each; bits: how many low bits of a key number the texts of an id, so that key >> bits orders like the ids."""

    rows: DataFrame
    texts: DataFrame
    bits: int


def keyed(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> Keyed:
    """A key for each (id, text) of docs, so that rows that share an id but not a text are documents of their own.

    The key is the id where no id has different texts; only ids are counted to know. Else its low bits are the
    number of the text among the id's, in the order of digests. Ids that leave too few bits for that are
    replaced by their numbers in order. Rows without an id have a null key and no text."""
    ident = F.col(id_col).cast("long")
    i, d, nth, place = (fresh(n, *docs.columns, key) for n in ("__i", "__d", "__nth", "__place"))
    again = written(docs.select(ident.alias(i)).where(F.col(i).isNotNull()).groupBy(i).agg(F.count("*").alias("n")).where("n > 1").select(i))
    of = lambda rows: rows.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if again.isEmpty():
        rows = docs.withColumn(key, ident)
        return Keyed(rows, of(rows), 0)
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    several = docs.select(ident.alias(i), digest.alias(d)).join(again, i, "left_semi").distinct()
    several = written(running(several, [i], [d], nth))
    bits = int(several.agg(F.max(nth)).first()[0]).bit_length()
    low, high = docs.agg(F.min(ident), F.max(ident)).first()
    rows = docs.withColumn(i, ident).withColumn(d, digest).join(several, [i, d], "left")
    if max(abs(low), abs(high)) >> (_KEY_BITS - bits):
        ids = docs.select(ident.alias(i)).where(F.col(i).isNotNull()).distinct().withColumn("all", F.lit(0))
        rows = rows.join(running(ids, ["all"], [i], place).drop("all"), i, "left")
    else:
        rows = rows.withColumn(place, F.col(i))
    rows = written(rows.withColumn(key, F.shiftleft(place, bits) + F.coalesce(nth, F.lit(0))).select(*docs.columns, key))
    return Keyed(rows, written(of(rows).dropDuplicates(["doc_id"])), bits)
