"""Sharding by balanced label propagation over links between documents.

Linked documents (of equal texts) should share a shard, and shards must hold equally many documents,
at every step. Documents of a group that stand in the same shard are alike, so what propagates is
kept as cells (group, shard, number of documents), and a link is never a pair: a document's neighbours
are its group's cells. Each round joins every cell with its group's others; a cell wants to go to
the largest one that is larger than itself and whose shard is open. Per pair of shards Spark
sums what wants to move; quotas cut that so that no shard exceeds its capacity; within a quota those
with the most neighbours at their goal go first, by running totals over ranges. Documents without
links fill what is left, so that counts are always at most one apart. Moves only lead from
smaller to larger cells of a group, so the number of links within shards grows with every move. A group
that is stuck between full shards may go as a whole to a shard with room for it.

Only DataFrame functions are used. Groups of any size are numbered by ranges and meet their cells by
blocks of numbers, so no key gathers a group. The driver sees one number a pair of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.base import written
from lumenfold.llm.numbering import running

SHARDS = 16
#: Documents of a group that meet their cells by one key.
BLOCK = 512


def quotas(wants: dict[tuple[int, int], int], held: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from shard to shard: all that want to, cut where a shard would hold more than its capacity.

    What leaves makes room, so two shards may swap even if both are full. Cutting what arrives somewhere keeps
    it where it came from, which may be too much there; the loop ends as every cut makes the sum smaller."""
    allowed = dict(wants)
    while True:
        over = None
        for j, (h, c) in enumerate(zip(held, capacity, strict=True)):
            much = h + sum(n for (a, b), n in allowed.items() if b == j) - sum(n for (a, b), n in allowed.items() if a == j) - c
            if much > 0 and (over is None or much > over[0]):
                over = (much, j)
        if over is None:
            return {k: n for k, n in allowed.items() if n}
        much, j = over
        arriving = sorted((k for k in allowed if k[1] == j), key=lambda k: (allowed[k], k))
        total = sum(allowed[k] for k in arriving)
        for i, k in enumerate(arriving):  # in proportion, what rounding leaves from the last
            cut = min(allowed[k], much * allowed[k] // total if i < len(arriving) - 1 else much)
            allowed[k], much, total = allowed[k] - cut, much - cut, total - allowed[k]
        for k in reversed(arriving):
            cut = min(allowed[k], max(0, much))
            allowed[k], much = allowed[k] - cut, much - cut


def _wishes(cells: DataFrame, is_open: list[bool]) -> DataFrame:
    """g, n, src, dst, goal: the cells that want to move, and the size of the cell they want to join."""
    rank = W.partitionBy("g").orderBy(F.desc("n"), F.xxhash64("g", "shard"), "shard")  # a group has at most a cell a shard
    open_ = F.element_at(F.array(*(F.lit(x) for x in is_open)), F.col("shard") + 1)
    best = F.first(F.when(open_, F.struct("shard", "n")), ignorenulls=True).over(rank.rowsBetween(W.unboundedPreceding, -1))
    out = cells.withColumn("best", best).where("best is not null")
    return out.select("g", "n", F.col("shard").alias("src"), F.col("best.shard").alias("dst"), F.col("best.n").alias("goal"))


def _shifted(cells: DataFrame, going: DataFrame) -> DataFrame:
    """Cells after `going` (g, src, dst, m: so many documents) have moved, written."""
    change = going.select("g", F.col("src").alias("shard"), (-F.col("m")).alias("n")).unionByName(going.select("g", F.col("dst").alias("shard"), F.col("m").alias("n")))
    return written(cells.unionByName(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def _granted(wishes: DataFrame, wants: dict[tuple[int, int], int], allowed: dict[tuple[int, int], int], shards: int) -> DataFrame:
    """The wishes with m, how many of each may move: all of a pair of shards, or those whose goal is largest first."""
    wishes = wishes.withColumn("pair", (F.col("src") * shards + F.col("dst")).cast("int")).withColumn("last", -F.col("goal"))
    whole = [i * shards + j for (i, j), n in allowed.items() if n == wants[i, j]]
    cut = {i * shards + j: n for (i, j), n in allowed.items() if n < wants[i, j]}
    going = wishes.where(F.col("pair").isin(whole)).withColumn("m", F.col("n"))
    if cut:
        quota = F.create_map(*(F.lit(x) for kv in cut.items() for x in kv))
        tight = running(wishes.where(F.col("pair").isin([*cut])), ["pair"], ["last", "g"], "before", weight=F.col("n"))
        tight = tight.withColumn("m", F.least("n", F.element_at(quota, F.col("pair")) - F.col("before"))).where("m > 0")
        going = going.unionByName(tight.drop("before"))
    return going


def _resettled(cells: DataFrame, room: list[int]) -> tuple[DataFrame, int]:
    """Cells after groups that still stand in several shards went to one with room for all of each; and how many did."""
    split = cells.groupBy("g").agg(F.sum("n").alias("s"), F.count("*").alias("k")).where("k > 1").drop("k")
    fits = F.filter(F.array(*(F.struct(F.lit(j).alias("shard"), F.lit(r).cast("long").alias("room")) for j, r in enumerate(room) if r)), lambda x: x["room"] >= F.col("s"))
    # any of them, by the group's hash; the smallest groups first, so that as many as can be are whole
    split = split.withColumn("fits", fits).where("size(fits) > 0").withColumn("to", F.element_at("fits", (F.pmod(F.xxhash64("g"), F.size("fits")) + 1).cast("int")))
    split = running(split.select("g", "s", F.col("to.shard").alias("dst"), F.col("to.room").alias("room")), ["dst"], ["s", "g"], "before", weight=F.col("s"))
    moved = written(split.where("before + s <= room").select("g", "dst"))
    n = moved.count()
    going = cells.join(moved, "g").where("shard != dst").select("g", F.col("shard").alias("src"), "dst", F.col("n").alias("m"))
    return (_shifted(cells, going), n) if n else (cells, 0)


def propagated(cells: DataFrame, capacity: list[int]) -> DataFrame:
    """Cells (g, shard, n), written, after rounds of moves under the capacities of the shards.

    A round takes all that its quotas let go, so there are few besides those that a group larger than a shard
    needs to fill one shard after another. Where all of a group's shards are full of linked documents, it may
    go as a whole to one with room, and the rounds go on. It ends when nothing may move."""
    shards = len(capacity)
    while True:
        held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        held = [held.get(j, 0) for j in range(shards)]
        room, allowed = [c - h for h, c in zip(held, capacity, strict=True)], {}
        # a full shard is open too in so far as others want to leave it, which quotas see to; if that lets nothing move, only those with room are
        for is_open in ([True] * shards, [r > 0 for r in room]):
            wishes = written(_wishes(cells, is_open))
            wants = {(r["src"], r["dst"]): r["n"] for r in wishes.groupBy("src", "dst").agg(F.sum("n").alias("n")).collect()}
            if not wants and all(is_open):
                return cells
            if allowed := quotas(wants, held, capacity):
                break
        if allowed:
            cells = _shifted(cells, _granted(wishes, wants, allowed, shards))
            continue
        if not any(room):
            return cells
        cells, n = _resettled(cells, room)
        if not n:
            return cells


def _dealt(number: Column, room: list[int]) -> Column:
    """The shard of the number-th of those that fill the rooms one after another."""
    out, upto = F.lit(len(room) - 1), sum(room)
    for j in range(len(room) - 1, -1, -1):
        out = F.when(number < upto, F.lit(j)).otherwise(out)
        upto -= room[j]
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (bytes of the text and 1), text_crc32, law (`rows`: counts at most one apart), shard, slot (from 0
    within the shard, by id) and grown_shard (null under this law).

    Equal texts are links; null and empty texts count as equal. Every row has a shard, those with a null id
    and those that repeat one too. A group larger than a shard fills some. An empty table gives no rows;
    other columns are not read and may have any name."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), F.struct(F.md5(data), F.octet_length(data)).alias("g"))
    # the text's digest stands for it: a false match would only be a link too many
    rows = rows.withColumn("g", F.concat("g.col1", F.lit("-"), "g.col2"))
    # all documents by id, dealt round
    rows = running(rows.withColumn("all", F.lit(0)), ["all"], ["id", "g"], "at", "total").drop("all").withColumn("shard", F.pmod("at", F.lit(shards)).cast("int"))
    rows = written(running(rows, ["g"], ["at"], "nth", "mates"))
    total = rows.agg(F.max("total")).first()[0] or 0
    capacity = [total // shards + (j < total % shards) for j in range(shards)]

    linked = rows.where("mates > 1")
    cells = propagated(written(linked.groupBy("g", "shard").agg(F.count("*").alias("n"))), capacity)
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}

    # a group's documents in order fill its cells; both meet by blocks of numbers
    first = F.sum("n").over(W.partitionBy("g").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    spans = cells.withColumn("first", F.coalesce(first, F.lit(0))).withColumn("end", F.col("first") + F.col("n")).drop("n")
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))
    placed = linked.drop("shard").withColumn("block", F.floor(F.col("nth") / BLOCK)).join(spans, ["g", "block"]).where("nth >= first and nth < end")

    single = running(rows.where("mates = 1").drop("shard").withColumn("all", F.lit(0)), ["all"], ["at"], "free")
    single = single.withColumn("shard", _dealt(F.col("free"), [capacity[j] - held.get(j, 0) for j in range(shards)]))
    keep = ["id", "size", "crc", "at", "shard"]
    out = running(placed.select(*keep).unionByName(single.select(*keep)), ["shard"], ["at"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in 16 shards whose counts are at most one apart, equal texts together as far as that allows."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
