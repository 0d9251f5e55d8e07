"""Joins between nodes, edges, documents and names. All of them meet by equal keys; a substring meets by its rarest characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import windows as W
from lumenfold.sources import storage

#: Targets of a call that are told: those a result shows.
MOST_TARGETS = 8
#: Characters by which a substring and what contains it meet.
GRAM = 3


def target_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller and name, each pair once: the names a caller calls."""
    return edges.join(nodes.select(F.col("node_id").alias("callee"), "name"), "callee").select("caller", "name").distinct()


def resolved_calls(calls: DataFrame, symbols: DataFrame, least: int = 3, most: int = MOST_TARGETS) -> DataFrame:
    """caller, call, how, targets: the first `most` symbols, by id, whose name or qualified name is the
    call's; only for calls that none answers, the first of those that share a token of `least` characters or more.

    Each key's first symbols are cut before the join, so a common name or token costs a call `most` rows."""
    keyed = calls.withColumn("key", T.reference_key(F.col("call")))
    names = symbols.select("node_id", F.explode(F.array_distinct(F.array(T.reference_key(F.col("name")), T.reference_key(F.col("qualified_name"))))).alias("key"))
    parts = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= least)))
    tokens = symbols.select("node_id", parts(T.reference_key(F.col("name"))).alias("token"))
    first = lambda df, key: W.first_per(df, [key], ["node_id"], most).groupBy(key).agg(F.collect_list("node_id").alias("ids"))
    targets = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("targets")
    by_name = first(names, "key")
    exact = keyed.join(by_name, "key").groupBy("caller", "call").agg(targets).select("caller", "call", F.lit("exact").alias("how"), "targets")
    rest = keyed.join(by_name, "key", "left_anti")
    loose = rest.select("caller", "call", parts(F.col("key")).alias("token")).join(first(tokens, "token"), "token")
    return exact.unionByName(loose.groupBy("caller", "call").agg(targets).select("caller", "call", F.lit("token").alias("how"), "targets"))


def loosely_resolved(calls: DataFrame, symbols: DataFrame, least: int = 3) -> DataFrame:
    """caller, callee: for calls (caller, call) that no symbol's name or qualified name is, all symbols whose name shares a token with it."""
    keyed = calls.withColumn("key", T.reference_key(F.col("call")))
    names = symbols.select(F.explode(F.array(T.reference_key(F.col("name")), T.reference_key(F.col("qualified_name")))).alias("key")).distinct()
    parts = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= least)))
    tokens = symbols.select(F.col("node_id").alias("callee"), parts(T.reference_key(F.col("name"))).alias("token"))
    return keyed.join(names, "key", "left_anti").select("caller", parts(F.col("key")).alias("token")).join(tokens, "token").select("caller", "callee").distinct()


def call_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller and callee_id for every edge whose target's name or qualified name a node has."""
    keys = nodes.select(F.col("node_id").alias("callee_id"), F.explode(F.array_distinct(F.array(T.reference_key(F.col("name")), T.reference_key(F.col("qualified_name"))))).alias("key"))
    return edges.withColumn("key", T.reference_key(F.col("target"))).join(keys, "key").select("caller", "callee_id").distinct()


def first_peers(rows: DataFrame, key: str, node: str, order: list[str], most: int) -> DataFrame:
    """Pairs of different rows with a key in common, the first `most` peers of each row.

    A row's first `most` peers are among the key's first `most` + 1 rows, so those alone are joined:
    a key with many rows costs each of them `most` + 1 pairs."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, node))
    heads = rows.withColumn("__rank", rank).where(F.col("__rank") <= most + 1).select(key, F.col(node).alias("peer"), "__rank")
    pairs = rows.select(key, node).join(heads, key).where(F.col(node) != F.col("peer"))
    place = F.row_number().over(Window.partitionBy(node).orderBy("__rank"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= most).select(node, "peer", F.col("rank").cast("bigint"))


#: Sets of up to so many tokens meet by all their subsets; of larger ones the rarest CORE tokens' subsets give a first bound.
SMALL, CORE = 8, 5


def most_shared(sets: DataFrame, most: int, key: str = "node_id", items: str = "tokens") -> DataFrame:
    """key, peer, shared, rank: for each set the `most` others that share most items with it (one at least), of equals
    those of smaller key. Exact; items are distinct within a set.

    A subset of items keeps its first `most` + 1 owners only. Nothing better is lost: if a peer shares exactly the
    items T, every owner of T with a smaller key shares as much or more, so a peer beyond T's first ones is
    beyond the best ones too. Small sets list all their subsets. A larger set lists those of its rarest
    items, which bounds from below how much its last peer shares; whoever shares as much has one of its
    rarest items among all but so many less one, and likewise on the other side, so items that
    many sets hold make no candidates but where nothing better is known. Equal sets meet once."""
    spark = sets.sparkSession
    held = sets.select(F.col(key).alias("__id"), F.explode(items).alias("__item"))
    often = held.groupBy("__item").agg(F.count("*").alias("__df"))
    ordered = held.join(often, "__item").groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__df", "__item"))), lambda x: x["__item"]).alias("__items"))
    ordered = storage.kept(spark, ordered)  # rarest first
    kinds = W.first_per(ordered, ["__items"], ["__id"], most + 1).groupBy("__items").agg(F.array_sort(F.collect_list("__id")).alias("__ids"))
    kinds = storage.kept(spark, kinds.withColumn("__set", F.element_at("__ids", 1)).withColumn("__n", F.size("__items")))
    core = F.when(F.col("__n") <= SMALL, F.col("__items")).otherwise(F.slice("__items", 1, CORE))
    mask = F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("__core")).cast("int") - 1))
    listed = kinds.select("__set", "__n", "__ids", core.alias("__core")).select("*", mask.alias("__mask"))
    part = F.filter("__core", lambda x, i: F.getbit(F.col("__mask"), i) == 1)
    listed = storage.kept(spark, listed.select("__set", "__n", "__ids", part.alias("__part")))
    owners = W.first_per(listed.select("__part", F.explode("__ids").alias("__peer")), ["__part"], ["__peer"], most + 1).drop("rank")
    met = listed.select("__set", "__n", "__part").join(owners, "__part").groupBy("__set", "__peer").agg(F.max(F.size("__part")).alias("__shared"))
    best = lambda df: W.first_per(df, ["__set"], [F.desc("__shared"), F.asc("__peer")], most + 1).drop("rank")  # noqa: E731  one may be the node itself
    if kinds.where(F.col("__n") > SMALL).isEmpty():
        found = best(met)
    else:
        of_peer = ordered.select(F.col("__id").alias("__peer"), F.col("__items").alias("__theirs"))
        mine = kinds.select("__set", "__items", "__n")
        checked = met.join(mine, "__set").join(of_peer, "__peer")
        checked = checked.select("__set", "__peer", F.size(F.array_intersect("__items", "__theirs")).alias("__shared"))
        first = storage.kept(spark, best(checked))
        least = first.groupBy("__set").agg(F.when(F.count("*") > most, F.min("__shared")).alias("__least"))
        bounded = mine.join(least, "__set", "left").withColumn("__least", F.coalesce("__least", F.lit(1)))
        posts = lambda df, by: df.select("*", F.posexplode("__items").alias("__pos", "__item")).drop("__items").withColumnRenamed("__n", by)
        left = posts(bounded, "__m").where("__pos <= __m - __least").withColumnRenamed("__set", "__left")
        right = posts(kinds.select("__set", "__items", "__n"), "__n").withColumnRenamed("__pos", "__at")
        pairs = left.join(right, "__item").where((F.greatest("__m", "__n") > SMALL) & (F.col("__at") <= F.col("__n") - F.col("__least")))
        pairs = pairs.select("__left", "__set", "__least").distinct()
        theirs = kinds.select("__set", F.col("__items").alias("__theirs"), "__ids")
        wide = pairs.join(mine.select(F.col("__set").alias("__left"), "__items"), "__left").join(theirs, "__set")
        wide = wide.withColumn("__shared", F.size(F.array_intersect("__items", "__theirs"))).where("__shared >= __least")
        wide = wide.select(F.col("__left").alias("__set"), F.explode("__ids").alias("__peer"), "__shared")
        found = best(first.unionByName(wide).groupBy("__set", "__peer").agg(F.max("__shared").alias("__shared")))
    shown = ordered.join(kinds.select("__items", "__set"), "__items").select("__id", "__set").join(found, "__set").where("__id <> __peer")
    shown = shown.select(F.col("__id").alias(key), F.col("__peer").alias("peer"), F.col("__shared").cast("bigint").alias("shared"))
    return W.first_per(shown, [key], [F.desc("shared"), F.asc("peer")], most)


def rare_token_neighbours(tokens: DataFrame, nodes: DataFrame, share: float = 0.35, most: int = MOST_TARGETS) -> DataFrame:
    """node, peer, shared, rank: the `most` peers of each node that share most tokens which few enough nodes
    have (`share` of all, two at least); of equals those of smaller id."""
    n_docs = nodes.agg(F.greatest(F.lit(2), F.ceil(share * F.count("*"))).alias("limit"))  # one row
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n_docs)).where("df >= 2 and df <= limit")
    sets = tokens.join(df.select("token"), "token").groupBy("node_id").agg(F.collect_set("token").alias("tokens"))
    return most_shared(sets, most)


def subsets(sets: DataFrame, key: str, items: str, most: int = 2) -> DataFrame:
    """items and ids: for each different set, the first `most` owners (by key) of sets that hold all of it.

    A set can only be held by those that have its rarest item, so sets meet by that."""
    kinds = sets.withColumn(items, F.array_sort(F.array_distinct(items)))
    kinds = W.first_per(kinds, [items], [key], most).groupBy(items).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    posts = kinds.select(F.col(items).alias("theirs"), "ids", F.explode(items).alias("item"))
    often = posts.groupBy("item").agg(F.count("*").alias("n"))
    rarest = kinds.select(items, F.explode(items).alias("item")).join(often, "item").groupBy(items).agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    held = rarest.join(posts, "item").where(F.size(F.array_except(items, "theirs")) == 0)
    owners = W.first_per(held.select(items, F.explode("ids").alias("id")), [items], ["id"], most)
    return owners.groupBy(items).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _grams(text, n: int):
    """All runs of n characters of a text, each once."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(seeds: DataFrame, rows: DataFrame, needle: str, haystack: str, gram: int = GRAM) -> DataFrame:
    """Rows whose haystack contains a seed's needle, with that needle, once each; an empty or null needle is in none.

    Different haystacks get numbers and are cut into runs of up to `gram` characters, of which only those that some needle
    has are kept, with the number alone. A needle looks only where the rarest of its own runs stands, so no pair is
    tried that shares nothing; a haystack itself moves for the pairs that are tried, and to its rows."""
    needles = seeds.select(F.col(needle).alias("__needle")).where("length(__needle) > 0").distinct()
    texts = rows.select(F.col(haystack).alias("__text")).where("__text is not null").distinct()
    texts = storage.kept(rows.sparkSession, texts.withColumn("__at", F.monotonically_increasing_id()))
    own = F.coalesce(*(F.when(F.length("__needle") >= n, _grams(F.col("__needle"), n)) for n in range(gram, 0, -1)))
    asked = storage.kept(rows.sparkSession, needles.select("__needle", F.explode(own).alias("__gram")))
    cut = texts.select("__at", F.explode(F.concat(*(_grams(F.col("__text"), n) for n in range(1, gram + 1)))).alias("__gram"))
    posts = storage.kept(rows.sparkSession, cut.join(asked.select("__gram").distinct(), "__gram", "left_semi"))
    often = posts.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = asked.join(often, "__gram", "left").groupBy("__needle").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__gram"))
    tried = posts.join(rarest, "__gram").select("__at", "__needle").join(texts, "__at")
    found = tried.where(F.col("__text").contains(F.col("__needle"))).select(F.col("__text").alias(haystack), F.col("__needle").alias(needle))
    return rows.join(found, haystack)


def latest_compression(feedback: DataFrame) -> DataFrame:
    """Retrievals with the source, type and kind of the latest compression of the same hash, or defaults."""
    last = feedback.where("stream = 'compression'").groupBy("hash").agg(F.max_by(F.struct("source", "content_type", "kind"), F.struct("ts", "event_id")).alias("c"))
    hit = feedback.where("stream = 'retrieval'").select("event_id", "hash").join(last, "hash", "left")
    return hit.select("event_id", "hash", F.coalesce("c.source", F.lit("graph")).alias("source"), F.coalesce("c.content_type", F.lit("text")).alias("content_type"), F.coalesce("c.kind", F.lit("unknown")).alias("kind"))


def merged_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scored lists as one: min(1, max + 0.15 * second) where both have a node."""
    both = a.withColumnRenamed("score", "sa").join(b.withColumnRenamed("score", "sb"), "node_id", "full_outer")
    return both.select("node_id", F.least(F.lit(1.0), F.greatest(F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0))) + 0.15 * F.coalesce("sb", F.lit(0.0))).alias("score"))
