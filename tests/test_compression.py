"""Folds over lines against plain loops."""

import random
import re

from lumenfold.operators import compression
from lumenfold.sources import code
from pyspark.sql import functions as F

WORDS = "import export function class const if return TODO alpha beta gamma delta { } ( ) ;".split()


def text_of(rng):
    lines = []
    for _ in range(rng.randint(0, 14)):
        lines.append("  " * rng.randint(0, 2) + " ".join(rng.choices(WORDS, k=rng.randint(0, 6))))
    return "\n".join(lines)


def estimate(text):
    return max(1, len([w for w in re.split(r"\s+", text) if w]))


def first_words(text, n):
    words = [w for w in re.split(r"\s+", text) if w]
    return text if len(words) <= n else " ".join(words[:n]) + " ... [compressed]"


def score(line, i, n):
    trimmed = line.strip(" ")
    if not trimmed:
        return -1
    total = sum(v for p, v in compression.LINE_SCORES if re.search(p, trimmed))
    return total + (2 if i < 3 or i >= n - 2 else 0)


def important(text, budget):
    lines = text.split("\n")
    if sum(map(estimate, lines)) <= budget:
        return text
    used, kept = 0, []
    for _, i in sorted((-score(x, i, len(lines)), i) for i, x in enumerate(lines)):
        if used + estimate(lines[i]) <= budget:
            used += estimate(lines[i])
            kept.append(i)
    out = "\n".join(lines[i] for i in sorted(kept))
    return out if out else first_words(text, budget)


def code_lines(text, budget):
    lines = text.split("\n")
    heads = [x for x in lines if re.search(compression.SIGNATURE, x.strip(" "))]
    body = [x for x in lines if not re.search(compression.SIGNATURE, x.strip(" "))]
    head, rest = "\n".join(heads), "\n".join(body)
    room = budget - estimate(head)
    if room <= 0:
        return first_words(head, budget)
    if estimate(rest) <= room:
        return text
    kept = max(1, len(body) * room // estimate(rest))
    return "\n".join([*heads, *body[:kept], f"// ... {len(body) - kept} lines compressed"])


def test_lines_and_code(spark):
    rng = random.Random(3)
    texts = [text_of(rng) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for budget in (3, 9, 25):
        for r in df.select("id", "text", compression.important_lines(F.col("text"), budget).alias("a"), compression.code(F.col("text"), budget).alias("b")).collect():
            assert r["a"] == important(r["text"], budget), (budget, r["text"])
            assert r["b"] == code_lines(r["text"], budget), (budget, r["text"])


def test_json(spark):
    rows = ['[{"a": 1}, {"a": 2}, {"a": 3}, "x y z", 5, 6, "p q r s"]', '{"a": "one two three four five"}', "not json at all but many words here", None, "[]", "[1]", '"just text"']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(compression.crushed(F.col("t"), 3)).collect()]
    assert got == [
        '{"__compressed":true,"totalItems":7,"shownItems":3,"items":[{"a":1},{"a":2},{"a":3}]}',
        '{"a":"one two three ... [compressed]',
        "not json at ... [compressed]",
        None,
        "[]",
        "[1]",
        '"just text"',
    ]


def test_declarations(spark):
    """The scanner of source files finds what a reader would, with the line it stands in."""
    content = "import x from 'y';\nexport class Box {\n  open(a) {\n  }\n}\nexport function fill(b) {\n  return b;\n}\nconst lid = (c) => c;\n"
    got = {(r["name"], r["kind"]) for r in code.declarations(spark.createDataFrame([("src/box.ts", content), ("src/none.ts", None)], "file_path string, content string")).collect()}
    assert {("Box", "class"), ("fill", "function")} <= got
