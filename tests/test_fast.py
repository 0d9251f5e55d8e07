"""The fast path's expression against the same rules read row by row."""

import re

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import fast
from lumenfold.plans import query as Q

NODES = [
    ("ColdWidget", "economy::ColdWidget", "src/economy/cold_widget.ts", "class", "class ColdWidget extends Base", "The cold widget", "class ColdWidget {}", "RedBolt"),
    ("coldWidget", "economy::Cold::coldWidget", "tests/cold_widget.test.ts", "function", "function coldWidget()", None, None, "ColdWidget open"),
    ("RedBolt", "small::RedBolt", "src/small/red_bolt.ts", "interface", "interface RedBolt", "Uses ColdWidget.", "", None),
    ("other", "lib.other", "lib/other.py", "function", None, None, "cold and widget", ""),
    ("ColdWidgetFactory", "economy::ColdWidgetFactory", "src/economy/factory.ts", "class", "class ColdWidgetFactory", "", "", "ColdWidget"),
]
QUERIES = ["cold widget", "fix ColdWidget in src/economy/cold_widget.ts", "ColdWidget RedBolt", "tests/cold_widget.test.ts src/small/red_bolt.ts ColdWidget", "widget", "name:ColdWidget", "path:src/small bolt", "the tests of cold", ""]


def flat(x):
    x = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x))
    return re.sub(r"""[_\-./:(){}\[\],;<>+=!?'"`|\\]+""", " ", x).lower()


def canonical(x):
    return re.sub(r"[^A-Za-z0-9_$]", "", x).lower()


def is_test(path):
    return bool(re.search(r"(?:^|/)(?:tests|unit_tests|integration_tests|__tests__)(?:/|$)|(?:^|/)src/test(?:/|$)|\.(?:test|spec)\.[cm]?[jt]sx?$", path.lower()))


def plain(q, node):
    name, qualified, path, kind, signature, doc, source, calls = (x or "" for x in node)
    join = lambda *xs: flat(" ".join(x for x in xs if x != "\0"))
    some = lambda *ks: " ".join(x for x in (node[k] for k in ks) if x is not None)
    metadata, evidence, body = flat(some(0, 1, 2, 4, 5, 7)), flat(some(4, 5, 6, 7)), join(source)
    p, n, tail = flat(path), flat(qualified), re.split(r"::|[:.#]", qualified)[-1]
    total = 0.0
    whole = canonical(" ".join(q.terms))
    total += fast.EXACT * bool(whole and whole in (canonical(name), canonical(qualified)))
    words = [w for w in re.split(r"[^a-z0-9]+", flat(path)) if len(w) >= 3]
    family = sum(2 if w in words else w in p for w in fast.families(q))
    if family:
        total += 18 + min(24, 8 * family) + 6 * is_test(path)
    paths = list(dict.fromkeys([*(q.filters[k] for k in ("file", "path") if k in q.filters), *q.paths]))
    hit = [i for i, x in enumerate(paths) if flat(x) == p or flat(x) in p or p in flat(x) or flat(x) in n]
    for i in hit:
        x = flat(paths[i])
        strength = 2.5 if x == p else 1.4 if p.endswith(x) or x.endswith(p) else 1.1 if x in p or x in n else 0.85
        total += (30 + 8 * (len(hit) - 1)) * (1 if len(paths) == 1 else 1 + (1 - i / (len(paths) - 1)) * 0.5) * strength
    if hit and any(flat(path.rsplit("/", 1)[-1]) in flat(x) for x in paths):
        total += 4
    symbols = list(dict.fromkeys([*([q.filters["name"]] if "name" in q.filters else []), *q.symbols]))
    scores, said, roots = [], 0, 0
    for s in symbols:
        key = canonical(s)
        own = key in (canonical(name), canonical(qualified), canonical(tail))
        segments = [canonical(x) for x in re.split(r"[:.#/\\]+", qualified)]
        strength = 4 if own else 2 if key in segments else 0.6 if key in evidence or key in canonical(evidence) else 1.5 if canonical(qualified).startswith(key) else 0
        scores.append(strength * fast.symbol_bonus(s))
        roots += kind in ("class", "interface") and canonical(name) == key
        said += not own and flat(s) in evidence
    if symbols:
        total += max(scores) * (0.7 if hit else 1) + (sum(scores) - max(scores)) * (0.35 if hit else 1) + roots * (8 if hit else 5)
        total *= 1 + min(0.6, 0.3 * said)
    asked = [x for x in paths if re.search(r"(?:^|/)(?:tests|unit_tests|integration_tests)(?:/|$)|testdata", x, re.I)]
    if asked and is_test(path):
        total += 36 + min(12, 12 * (len(asked) - 1))
    anchored = bool(hit) or any(scores)
    for t in q.terms:
        total += (0.1 if anchored else 3) if t in metadata else (0.05 if anchored else 1) if t in body else 0
    total += 5 * ("name" in q.filters and flat(q.filters["name"]) in n)
    total += 10 * (len(q.terms) == 1 and flat(name) == q.terms[0])
    total -= 2 * (is_test(path) and not {"test", "tests"} & set(q.terms))
    return total + 2 * (kind in ("class", "interface") and len(q.terms) > 1)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(NODES)], "id long, name string, qualified string, path string, kind string, signature string, doc string, source string, calls string")


@pytest.mark.parametrize("text", QUERIES)
def test_scores(nodes, text):
    q = Q.parse(text)
    made = fast.score(q, *(F.col(c) for c in ("name", "qualified", "path", "kind", "signature", "doc", "source", "calls")))
    got = {r["id"]: r["s"] for r in nodes.select("id", made.alias("s")).collect()}
    for i, x in enumerate(NODES):
        assert abs(got[i] - plain(q, x)) < 1e-9, (text, x, got[i], plain(q, x))


def test_selection_puts_anchors_first(nodes):
    q = Q.parse("fix ColdWidget in src/small/red_bolt.ts")
    rows = nodes.select(F.col("id").alias("node_id"), "name", F.col("qualified").alias("qualified_name"), F.col("path").alias("file_path"), F.lit(1.0).alias("score"))
    got = [(r["node_id"], r["why"]) for r in fast.selected(rows, q, 4).orderBy("rank").collect()]
    assert got == [(0, "symbol"), (2, "path"), (1, "ranked"), (3, "ranked")]


@pytest.mark.parametrize("text", QUERIES)
def test_scores_in_stages(nodes, text):
    """What is made in columns first scores the same, and no long text is made twice."""
    q = Q.parse(text)
    rows = nodes.withColumnsRenamed({"qualified": "qualified_name", "path": "file_path", "doc": "docstring", "source": "content", "calls": "said"})
    made = fast.scored(rows, q)
    assert made.columns == [*rows.columns, "score"]
    for r in made.collect():
        assert abs(r["score"] - plain(q, NODES[r["id"]])) < 1e-9, (text, r)
    made_twice = made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(concat_ws( , signature")
    assert made_twice <= 1, text


def test_selection_reads_scores_once(nodes):
    q = Q.parse("fix ColdWidget in src/small/red_bolt.ts")
    read = nodes.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        read.add(1)
        return 1.0

    rows = nodes.select(F.col("id").alias("node_id"), "name", F.col("qualified").alias("qualified_name"), F.col("path").alias("file_path"), score("id").alias("score"))
    assert len(fast.selected(rows, q, 4).collect()) == 4
    assert read.value == len(NODES)
