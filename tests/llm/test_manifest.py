"""The Merkle manifest against plain recursion."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm.merkle import checked


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def beside(levels, i, fanout):
    """Digests left and right of a node's path, level by level."""
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        yield nodes[first:i], nodes[i + 1 : first + fanout]
        i //= fanout


def plain(rows, suspects, fields, group, fanout):
    groups = {}
    for row, other in zip(rows, suspects, strict=True):
        groups.setdefault(row[group], []).append((row["doc_id"], leaf([row[f] for f in fields]), leaf([other[f] for f in fields])))
    names = sorted(groups, key=lambda g: (g is not None, str(g).encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = up([x[1] for x in groups[g]], fanout)
    top = up([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (doc_id, own, fold) in enumerate(groups[g]):
            proof = ""
            for left, right in [*beside(trees[g], i, fanout), *beside(top, k, fanout)]:
                proof += "".join(left + right)
                fold = h(*left, fold, *right)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.fixture
def odd(docs):
    """The odd documents, in groups of several sizes, with columns named like the operator's own."""
    return docs.select("*", F.col("blob").alias("source"), F.char_length("text").alias("n_chars"), F.lit(0).alias("tree"), F.lit(1).alias("at"), F.lit("x").alias("steps"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("fanout", [2, 3])
def test_plain(odd, fanout):
    rows = [r.asDict() for r in odd.collect()]
    other = [r | {"n_chars": None if r["n_chars"] is None else r["n_chars"] + (r["doc_id"] in (3, 8))} for r in rows]
    found = checked(odd, {"n_chars": F.when(F.col("doc_id").isin(3, 8), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fanout=fanout)
    want = plain(rows, other, FIELDS, "lang", fanout)
    assert rows_of(found) == want
    assert sorted(r[0] for r in want if not r[-1]) == [3, 8, 8]


def test_one_group_and_one_row(spark, odd):
    one = odd.where("doc_id = 1")
    rows = [r.asDict() for r in one.collect()]
    assert rows_of(checked(one, {})) == plain(rows, rows, FIELDS, "lang", 2)
    many = spark.range(37).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.lit("abc").alias("text"))
    rows = [r.asDict() for r in many.collect()]
    assert rows_of(checked(many, {})) == plain(rows, rows, FIELDS, "lang", 2)


def test_many_groups(spark):
    many = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") != 7, F.concat(F.lit("é"), (F.col("id") % 23).cast("string"))).alias("lang"), F.lit(3).alias("n_chars"), F.lit("abc").alias("text"))
    rows = [r.asDict() for r in many.collect()]
    assert rows_of(checked(many, {})) == plain(rows, rows, FIELDS, "lang", 2)


def test_any_change_is_seen(odd):
    found = checked(odd, {"text": F.when(F.col("doc_id") == 5, F.lit(None).cast("string")).when(F.col("doc_id") == 4, F.lit("")).otherwise(F.col("text"))})
    assert sorted(r["doc_id"] for r in found.where("not verified").collect()) == [4, 5]


def test_empty(odd):
    assert checked(odd.where("false"), {}).collect() == []
