"""The fast path: symbols scored by one expression, from what the driver reads in a query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import windows
from lumenfold.plans import query as Q
from lumenfold.sources import storage

# What each kind of evidence counts.
EXACT, WHOLE_TERM, NAMED = 25, 10, 5
FAMILY, FAMILY_EACH, MOST_FAMILY, FAMILY_TEST = 18, 8, 24, 6
PATH, PATH_EACH, BASE_NAME = 30, 8, 4
PATH_STRENGTH = {"equal": 2.5, "ending": 1.4, "inside": 1.1, "other": 0.85}
SYMBOL_STRENGTH = {"name": 4.0, "segment": 2.0, "evidence": 0.6, "beginning": 1.5}
WITH_PATH, WITH_PATH_OTHERS, ROOT_TYPE = 0.7, 0.35, (5, 8)
REFERENCE, MOST_REFERENCE = 0.3, 0.6
TESTS_ASKED, TEST_UNASKED, TYPE_OF_MANY = 36, -2, 2
TERM = {False: (3.0, 1.0), True: (0.1, 0.05)}
NO_FAMILY = ["source", "destination", "connector", "connectors", "unit", "integration", "test", "tests"]


def families(query: Q.Query, without: list[str] = NO_FAMILY) -> list[str]:
    """Words of the base names of a query's paths, which may name a family of files; those in `without` are too common for it."""
    found = []
    for path in query.paths:
        stem = re.sub(r"\.[^.]+$", "", path.replace("\\", "/").rsplit("/", 1)[-1])
        found += [w for w in re.split(r"[^a-z0-9]+", " ".join(Q.tokens(stem, synonyms=False))) if len(w) >= 3 and not w.isdecimal() and w not in without]
    return list(dict.fromkeys(found))


def symbol_bonus(symbol: str) -> int:
    """What an exact symbol counts: more for capitals and length, less for tests."""
    size = len(re.sub(r"[^A-Za-z0-9_$]", "", symbol))
    is_test = bool(re.match("test", symbol, re.I) or re.search(r"(?:^|_)test(?:_|$)", symbol, re.I))
    return max(4, (14 if re.search("[A-Z]", symbol) or "::" in symbol else 8) + min(10, size // 3) - 3 * is_test)


def _sum(columns: list[Column]) -> Column:
    return sum(columns, F.lit(0.0))


def score(query: Q.Query, name: Column, qualified: Column, path: Column, kind: Column, signature: Column, doc: Column, source: Column, calls: Column) -> Column:
    """A symbol's score for a query: exact names, families of files, paths, symbols, references, tests and terms.

    calls: what the symbol calls, as one text. Texts may be null. One expression over the row; nothing is joined."""
    return _score(query, name, qualified, path, kind, signature, doc, source, calls, lambda **made: made)


def scored(rows: DataFrame, query: Q.Query) -> DataFrame:
    """rows (name, qualified_name, file_path, kind, signature, docstring, content, said: what a symbol calls, as one text)
    with their `score`. What the score asks of a text more than once is made once, in columns before it."""
    at = {"rows": rows}

    def keep(**made: Column) -> dict[str, Column]:
        at["rows"] = at["rows"].select("*", *(c.alias(f"__{k}") for k, c in made.items()))
        return {k: F.col(f"__{k}") for k in made}

    total = _score(query, *(F.col(c) for c in ("name", "qualified_name", "file_path", "kind", "signature", "docstring", "content", "said")), keep)
    return at["rows"].select(*rows.columns, total.alias("score"))


def _score(query: Q.Query, name: Column, qualified: Column, path: Column, kind: Column, signature: Column, doc: Column, source: Column, calls: Column, keep) -> Column:
    """The score; `keep` gets columns that are used more than once and returns what stands for them."""
    text = lambda *cs: T.normalized(F.concat_ws(" ", *cs))
    flats = keep(name=T.normalized(name), qualified=T.normalized(qualified), path=T.normalized(path), signature=T.normalized(signature), doc=T.normalized(doc), source=T.normalized(source), calls=T.normalized(calls))
    # no hump or run of marks goes across the space between two texts, so each is normalised alone
    held = lambda *ks: F.concat_ws(" ", *(flats[k] for k in ks))
    made = keep(metadata=held("name", "qualified", "path", "signature", "doc", "calls"), body=held("source"), evidence=held("signature", "doc", "source", "calls"), plain_path=held("path"), plain_name=held("qualified"), is_test=T.is_test_file(path), **{f"own{i}": T.canonical(c) for i, c in enumerate((name, qualified, T.name_tail(qualified)))})
    metadata, body, evidence, own = made["metadata"], made["body"], made["evidence"], [made[f"own{i}"] for i in range(3)]
    plain_path, plain_name, is_test = made["plain_path"], made["plain_name"], made["is_test"]
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    flat = lambda x: re.sub(r"""[_\-./:(){}\[\],;<>+=!?'"`|\\]+""", " ", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x))).lower()
    same = lambda x: re.sub(r"[^A-Za-z0-9_$]", "", x).lower()
    total = F.lit(0.0)

    whole = same(" ".join(query.terms))
    if whole:
        total = total + when((own[0] == whole) | (own[1] == whole), float(EXACT))

    words, found = T.identifier_words(path), families(query)
    if found:
        words = keep(words=words)["words"]
        family = keep(family=_sum([F.when(F.array_contains(words, w), 2).when(plain_path.contains(w), 1).otherwise(0) for w in found]))["family"]
        total = total + when(family > 0, FAMILY + F.least(F.lit(float(MOST_FAMILY)), family * FAMILY_EACH) + when(is_test, float(FAMILY_TEST)))

    paths = list(dict.fromkeys([*(query.filters[k] for k in ("file", "path") if k in query.filters), *query.paths]))
    hits = []
    for p in map(flat, paths):
        hits.append((plain_path == p) | plain_path.contains(p) | F.lit(p).contains(plain_path) | plain_name.contains(p))
    made = keep(**{f"hit{i}": h for i, h in enumerate(hits)}) if hits else {}
    hits = list(made.values())
    n_paths = keep(n_paths=_sum([h.cast("int") for h in hits]))["n_paths"] if hits else F.lit(0.0)
    for i, (p, hit) in enumerate(zip(map(flat, paths), hits, strict=True)):
        first = 1.0 if len(paths) <= 1 else 1 + (1 - i / (len(paths) - 1)) * 0.5
        ending = plain_path.endswith(p) | F.lit(p).endswith(plain_path)
        strength = F.when(plain_path == p, PATH_STRENGTH["equal"]).when(ending, PATH_STRENGTH["ending"]).when(plain_path.contains(p) | plain_name.contains(p), PATH_STRENGTH["inside"]).otherwise(PATH_STRENGTH["other"])
        total = total + when(hit, (PATH + (n_paths - 1) * PATH_EACH) * first * strength)
    if paths:
        base = text(F.regexp_replace(path, r"^.*[/\\]", ""))
        named = F.lit(False)
        for p in map(flat, paths):
            named = named | F.lit(p).contains(base)
        total = total + when((n_paths > 0) & (base != "") & named, float(BASE_NAME))

    symbols = list(dict.fromkeys([*([query.filters["name"]] if "name" in query.filters else []), *query.symbols]))
    segments = F.transform(F.split(qualified, r"[:.#/\\]+"), T.canonical)
    strengths, bonuses = [], []
    if symbols:
        made = keep(segments=segments, plain_evidence=T.canonical(evidence))
        segments, plain_evidence = made["segments"], made["plain_evidence"]
    for i, s in enumerate(symbols):
        key = same(s)
        is_own = (own[0] == key) | (own[1] == key) | (own[2] == key)
        said = evidence.contains(key) | plain_evidence.contains(key)
        strength = F.when(is_own, SYMBOL_STRENGTH["name"]).when(F.array_contains(segments, key), SYMBOL_STRENGTH["segment"]).when(said, SYMBOL_STRENGTH["evidence"]).when(own[1].startswith(key), SYMBOL_STRENGTH["beginning"]).otherwise(0.0)
        strength = keep(**{f"strength{i}": strength})[f"strength{i}"]
        strengths.append((strength, is_own, own[0] == key, evidence.contains(flat(s))))
        bonuses.append(strength * symbol_bonus(s))
    if symbols:
        best = bonuses[0] if len(bonuses) == 1 else F.greatest(*bonuses)
        others = _sum(bonuses) - best
        n_roots = _sum([(x[2] & kind.isin("class", "interface")).cast("int") for x in strengths])
        total = total + F.when(n_paths > 0, best * WITH_PATH + others * WITH_PATH_OTHERS + n_roots * ROOT_TYPE[1]).otherwise(best + others + n_roots * ROOT_TYPE[0])
        n_said = _sum([(~x[1] & x[3]).cast("int") for x in strengths])
        total = total * (1 + F.least(F.lit(MOST_REFERENCE), n_said * REFERENCE))
    asked = [p for p in paths if re.search(r"(?:^|/)(?:tests|unit_tests|integration_tests)(?:/|$)|(?:^|/)src/test(?:/|$)|testdata", p.replace("\\", "/"), re.I)]
    if asked:
        total = total + when(is_test, float(TESTS_ASKED + min(12, 12 * (len(asked) - 1))))

    anchored = n_paths > 0
    for s, *_ in strengths:
        anchored = anchored | (s > 0)
    anchored = keep(anchored=anchored)["anchored"]
    for t in query.terms:
        at = lambda k, t=t: F.when(metadata.contains(t), TERM[k][0]).when(body.contains(t), TERM[k][1]).otherwise(0.0)
        total = total + F.when(anchored, at(True)).otherwise(at(False))
    if "name" in query.filters:
        total = total + when(plain_name.contains(flat(query.filters["name"])), float(NAMED))
    if len(query.terms) == 1:
        total = total + when(text(name) == query.terms[0], float(WHOLE_TERM))
    if not {"test", "tests"} & set(query.terms):
        total = total + when(is_test, float(TEST_UNASKED))
    if len(query.terms) > 1:
        total = total + when(kind.isin("class", "interface"), float(TYPE_OF_MANY))
    return total


#: Symbols of a file that a result shows at most, and of an anchor.
PER_FILE, PER_ANCHOR = 4, 3


def selected(scored: DataFrame, query: Q.Query, most: int) -> DataFrame:
    """node_id, file_path, score, why, rank: the `most` symbols that a result shows, of scored ones (node_id, name,
    qualified_name, file_path, score).

    First come the best of each symbol that the query names, and the first PER_ANCHOR of each path it names; then
    files in turn, each one's best first, PER_FILE of a file at most. Each part is cut before the parts meet."""
    order = [F.desc(F.round("score", 9)), F.asc("node_id")]
    asked = []
    for s in query.symbols:
        key = T.canonical(F.lit(s))
        asked.append((((T.canonical(F.col("name")) == key) | (T.canonical(F.col("qualified_name")) == key)), 1, "symbol"))
    for p in query.paths:
        asked.append((T.normalized(F.col("file_path")).contains(T.normalized(F.lit(p))), PER_ANCHOR, "path"))
    # each part reads what is written; a filter on scores that are yet to be made would make them again
    some = scored.select("node_id", "file_path", "score", *(c.alias(f"__in{i}") for i, (c, *_) in enumerate(asked)))
    some = storage.kept(scored.sparkSession, some).where("score > 0")
    parts = []
    for i, (_, cap, why) in enumerate(asked):
        parts.append(windows.top(some.where(f"__in{i}"), order, cap).select("node_id", "file_path", "score", F.lit(why).alias("why"), F.lit(i).alias("part"), "rank"))
    rest = windows.round_robin(some, "file_path", order, PER_FILE, 2 * most)
    out = rest.select("node_id", "file_path", "score", F.lit("ranked").alias("why"), F.lit(1 << 20).alias("part"), "rank")
    for part in parts:
        out = out.unionByName(part)
    first = out.groupBy("node_id", "file_path", "score").agg(F.min(F.struct("part", "rank", "why")).alias("f"))
    return windows.top(first, ["f.part", "f.rank", "node_id"], most).select("node_id", "file_path", "score", "f.why", "rank")
