import math
import random
from collections import Counter

import numpy as np

from lumenfold.llm import quality_rules as Q


def drawn(cells, values, chain, prior=None):
    """For each document: the median of its cells, from the widest to its own, each counting its documents against WIDER of
    the wider, and the widest's against WIDER of a prior, if there is one."""
    out = [prior] * len(values)
    for keys in chain:
        groups = {}
        for cell, v in zip(cells, values, strict=True):
            groups.setdefault(tuple(cell[k] for k in keys), []).append(v)
        for i, cell in enumerate(cells):
            mine = groups[tuple(cell[k] for k in keys)]
            out[i] = np.median(mine) if out[i] is None else (len(mine) * np.median(mine) + Q.WIDER * out[i]) / (len(mine) + Q.WIDER)
    return np.array(out)


def test_verdicts_against_a_plain_loop(spark):
    """Every language, however rare, is judged; copies count once; rows of one id are judged each on its own."""
    rng = random.Random(5)
    words = "the of and to in that it was for on as with his they at be this from have or by one had not but what all were when".split()
    sentences = [" ".join(rng.choices(words, k=rng.randint(20, 200))) for _ in range(120)]
    rows = [(i, t, "en" if i % 3 else "fr") for i, t in enumerate(sentences)]
    rows += [(200 + i, sentences[0], "en") for i in range(300)]
    rows += [(600, "xqzkvw" * 40 + " " + " ".join("zxqj" + str(i) + "vkq" for i in range(40)), "tlh"), (601, sentences[5], "tlh"), (601, sentences[6], "tlh")]
    rows += [(700, " ".join(["ж"] * 30), "en"), (701, None, "en"), (702, "", None), (703, "short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.asDict() for r in Q.judged(df).collect()]
    assert len(got) == len(rows)
    text = {(i, len((t or "").split())): (t, lang) for i, t, lang in rows}
    known = [(r, *text[r["doc_id"], r["n_words"]]) for r in got]
    once = {}
    for r, t, lang in known:
        if r["n_words"] >= Q.LEAST_WORDS:
            script = "cyrillic" if "ж" in t else "latin"
            once[lang, t] = ({"kind": lang, "script": script, "length_class": math.floor(2 * math.log2(r["n_tokens"]))}, r)
    cells = [c for c, _ in once.values()]
    step = lambda x: float(math.floor(x * Q.STEPS + 0.5))
    out = {"chars": [], "bits": [], "bytes": []}
    for suffix in Q.SUFFIXES:
        figures = {v: np.array([step(r[k + suffix]) for _, r in once.values()]) for v, k in (("chars", "chars_per_token"), ("bits", "entropy"), ("bytes", "fallback_share"))}
        root = np.sqrt([r["n_tokens" + suffix] for _, r in once.values()])
        middle = {v: drawn(cells, x, Q._BY_LENGTH if v == "bits" else Q._BY_KIND) for v, x in figures.items()}
        spread = {}
        for v, x in figures.items():
            d = np.abs(x - middle[v]) * (root if v == "chars" else 1)
            power = np.floor(np.log2(1 + d) * Q.STEPS + 0.5)
            prior = math.floor(math.log2(1 + Q.PRIOR[f"d_{v}"]) * Q.STEPS + 0.5)
            spread[v] = 2 ** (drawn(cells, power, Q._BY_LENGTH if v == "bits" else Q._BY_KIND, prior) / Q.STEPS) - 1
        out["chars"].append(np.abs(figures["chars"] - middle["chars"]) * root / np.maximum(spread["chars"], Q.STEPS / 4))
        out["bits"].append((middle["bits"] - figures["bits"]) / np.maximum(spread["bits"], 2))
        out["bytes"].append((figures["bytes"] - middle["bytes"]) / np.maximum(spread["bytes"], Q.FALLBACK * Q.STEPS / Q.BAND))
    rejected = np.any([np.mean(v, axis=0) > Q.BAND for v in out.values()], axis=0)
    verdict = dict(zip(once, ~rejected, strict=True))
    for r, t, lang in known:
        assert r["kept"] == (not r["base_failed"] and bool(verdict.get((lang, t), False))), r
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[600] and not kept[700] and Counter(kept.values())[True] > 300


def test_a_few_documents_reject_none_of_their_like(spark):
    """Bands of a tiny corpus are wide: texts that differ in their words alone all stay."""
    rows = [(i, " ".join(f"word{k}" for k in range(60 * i, 60 * i + 40 + 30 * i)), "en") for i in range(4)]
    assert all(r["kept"] for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
