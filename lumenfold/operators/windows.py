"""Ranked and budgeted selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list[str], order: list, most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each key with their rank from 1; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank, n).where(F.col(rank) <= most).withColumn(rank, F.col(rank).cast("bigint"))


def top(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows and their rank from 1: a bounded sort on each task, then one over what is left."""
    few = rows.orderBy(*order).limit(most)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def round_robin(rows: DataFrame, key: str, order: list, cap: int, most: int) -> DataFrame:
    """Rows dealt key by key: every key's first row, then every key's second, `cap` of a key at most."""
    return top(first_per(rows, [key], order, cap, "depth"), ["depth", *order], most)


def source_priority(graph: Column, vector: Column, fts: Column) -> Column:
    """What a budget takes first: found by the graph, else by vectors, else by text; of one source, what others found too."""
    also = lambda c, v: F.when(c, v).otherwise(0)
    return F.when(graph, 3000 + also(vector, 20) + also(fts, 10)).when(vector, 2000 + also(fts, 10)).otherwise(1000)


def median_run(rows: DataFrame, key: str, value: str, index: str, size: str) -> DataFrame:
    """The row of each key nearest its median; of equals the first by index, then the smallest. Two aggregates that combine before the shuffle."""
    middle = rows.groupBy(key).agg(F.median(value).alias("__m"))
    near = F.struct(F.abs(F.col(value) - F.col("__m")), F.col(index), F.col(size))
    return rows.join(middle, key).groupBy(key).agg(F.min_by(F.struct(index, value, size), near).alias("b")).select(key, "b.*")


def budgeted(rows: DataFrame, order: list, cost: Column, budget: int, overhead: int, most: int) -> DataFrame:
    """Rows of a ranked list of `most` at most that a budget admits, with `used` tokens each.

    Every row costs `overhead` besides its content; the row that does not fit whole is cut to what is left, and
    those after it are dropped. With one overhead for all, a running sum says it."""
    ranked = top(rows, order, most)
    before = F.coalesce(F.sum(cost + overhead).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # `most` rows
    left = budget - before
    used = F.least(cost + overhead, left)
    return ranked.withColumn("left", left).where(F.col("left") > overhead).withColumn("used", used.cast("bigint")).drop("left")


def tail_inserted(selected: DataFrame, extra: DataFrame, key: str, most: int) -> DataFrame:
    """key and place of a list (key, place) after extras (key, place) were put at its end one by one: in a full list each
    takes the last one's place. Keys that the list has are not put again. Lists are short; one task orders them."""
    new = extra.join(selected.select(key), key, "left_anti").groupBy(key).agg(F.min("place").alias("place"))
    both = selected.select(key, F.lit(0).alias("__part"), "place").unionByName(new.select(key, F.lit(1).alias("__part"), "place"))
    whole = Window.orderBy("__part", "place", key)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    rows = both.withColumn("__at", F.row_number().over(whole)).withColumn("__n", n)
    kept = rows.where((F.col("__n") <= most) | (F.col("__at") < most) | (F.col("__at") == F.col("__n")))
    return kept.select(key, F.least("__at", F.lit(most)).cast("bigint").alias("place"))
