"""Merkle manifest of a table: a leaf a row, a tree a group of rows, a tree of those trees.

Every level is a DataFrame. Leaves are numbered within their group; a node's number divided by the
fanout is its parent's, whose digest is that of the sorted array of its children. Levels are written
on the way up. On the way down one join a level hands each node's proof, the digests beside
its own path, to its children: a level's proofs are made once for all leaves below, so the joins
of all levels together meet about as many rows as there are leaves, however high the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.base import fresh, written
from lumenfold.llm.numbering import running

#: Fields of a leaf, in this order, and the one whose values have a tree each.
FIELDS, GROUP = ("doc_id", "source", "lang", "n_chars", "text"), "lang"
FANOUT = 2


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value, or `-` if null."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Written tables (tree, at, n, hash, children) from the leaves up, until each tree has one node."""
    out = [nodes.withColumn("children", F.lit(None).cast("array<struct<at:bigint,hash:string>>"))]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // fanout)
        children = F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("children")
        up = out[-1].where("n > 1").groupBy("tree", F.floor(F.col("at") / fanout).cast("long").alias("up"))
        up = up.agg(F.ceil(F.max("n") / fanout).cast("long").alias("n"), children)
        out.append(written(up.select("tree", F.col("up").alias("at"), "n", digest(F.array_join("children.hash", "")).alias("hash"), "children")))
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("n = 1").select("tree", "hash")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("tree", "hash"))
    return out


def _beside(at: str, joined: str) -> Column:
    """Digests of the children before or after child `at`, one after another."""
    return F.array_join(F.transform(F.filter("children", lambda c: c["at"] < F.col(at) if joined == "left" else c["at"] > F.col(at)), lambda c: c["hash"]), "").alias(joined)


def _proofs(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, at and steps of each leaf; `above` has the steps (left and right digests) from each tree's top on."""
    path = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].where("n = 1").select("tree", "at").join(above, "tree")
        if path is not None:
            down = levels[k + 1].select("tree", F.col("at").alias("up"), "children").join(path.withColumnRenamed("at", "up"), ["tree", "up"])
            down = down.select("tree", "children", "steps", F.explode("children.at").alias("at"))
            step = F.struct(_beside("at", "left"), _beside("at", "right"))
            here = here.unionByName(down.select("tree", "at", F.concat(F.array(step), "steps").alias("steps")))
        path = here
    return path


@dataclass
class Manifest:
    #: id columns, leaf, subroot, steps (left and right digests from leaf to root)
    proofs: DataFrame
    root: str | None


def manifest(leaves: DataFrame, ids: list[str], group_col: str, order_col: str, fanout: int = FANOUT) -> Manifest:
    """Trees over `leaves` (ids, group, order and `leaf`, the digest). Groups follow each other in the order
    of their UTF-8 bytes, null first; leaves in the order of order_col, null first, then of digests.

    A group of one leaf is its own subroot, one group's subroot the root. Rows that repeat an id are leaves
    of their own; equal rows are told apart by their place only. An empty table has no root."""
    # a group's key is never null and keeps the order: null is empty, others have a mark before them
    keyed = leaves.select(*ids, F.col(order_col).alias("__order"), "leaf", F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("")).alias("tree"))
    placed = written(running(keyed, ["tree"], ["__order", "leaf"], "at", "n"))
    levels = _levels(placed.select("tree", "at", "n", F.col("leaf").alias("hash")), fanout)
    tops = written(running(_tops(levels).withColumn("all", F.lit(0)), ["all"], ["tree"], "at", "n"))
    roots = _levels(tops.select(F.lit("").alias("tree"), "at", "n", "hash"), fanout)
    root = _tops(roots).first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = _proofs(roots, tops.select(F.lit("").alias("tree")).limit(1).withColumn("steps", none))
    above = written(tops.join(above.select("at", "steps"), "at").select("tree", F.col("hash").alias("subroot"), "steps"))
    steps = _proofs(levels, above.select("tree", "steps"))
    proofs = placed.select("tree", "at", *ids, "leaf").join(steps, ["tree", "at"]).join(above.select("tree", "subroot"), "tree")
    return Manifest(proofs.select(*ids, "leaf", "subroot", "steps"), root["hash"] if root else None)


def checked(docs: DataFrame, suspect: dict[str, Column], fields: tuple[str, ...] = FIELDS, group_col: str = GROUP, id_col: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 of each row of docs; folded_root, the root that the row with the
    columns of `suspect` in place of its own leads to by the row's proof; and verified, whether it is the root.

    Every row is a leaf, also those with a null id; null fields count as such, apart from empty ones. Other
    columns are not read and may have any name. An empty table gives no rows."""
    taken = fresh("__suspect", *fields)
    rows = docs.select(*fields)
    changed = None
    for name, value in suspect.items():
        differs = ~value.eqNullSafe(F.col(name))
        changed = differs if changed is None else changed | differs
    other = F.lit(None).cast("string") if changed is None else F.when(changed, leaf(*(suspect.get(f, F.col(f)) for f in fields)))
    # one read of the texts: digests are all that goes on
    leaves = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf(*(F.col(f) for f in fields)).alias("leaf"), other.alias(taken))
    found = manifest(leaves, ["id", taken], "group", "id", fanout)
    root, again = F.lit(found.root).cast("string"), folded(F.coalesce(taken, "leaf"), F.col("steps"))
    out = found.proofs.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of `documents` by lang; where 7 divides crc32(doc_id) the row is checked with n_chars + 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return checked(docs, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
