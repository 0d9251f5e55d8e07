import hashlib
import random
import re

import numpy as np
import pytest

from lumenfold.llm import metric_join, ngram_join, substring_dedup, suffix_dedup
from lumenfold.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages and short texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(body))
        if i % 3 == 0:
            texts.append(" ".join(body))
        if i % 4 == 0:
            near = list(body)
            near[rng.randrange(len(near))] = "changed"
            texts.append("  ".join(near).upper() if i % 8 == 0 else "\n".join(near))
        if i % 5 == 0:
            texts.append(f"{texts[-1]} {passage} {i}")
    texts += ["", None, " \n ", passage * 3, "same", "Same", "é" * 150, "é" * 150 + "x"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def in_order(df):
    return [(r["doc_id"], r["text"] or "") for r in df.orderBy("doc_id").collect()]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window", [3, 13])
def test_windows_that_start_in_smaller_documents_go(corpus, window):
    out = {r["doc_id"]: r for r in substring_dedup.deduplicated(corpus, window, digests=True).collect()}
    plain = {r["doc_id"]: r["kept_text"] for r in substring_dedup.deduplicated(corpus, window).collect()}
    seen = {}
    for doc, text in in_order(corpus):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), doc) < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (out[doc]["n_words"], out[doc]["n_removed"], out[doc]["kept_sha256"]) == (len(words), sum(gone), sha(kept.encode()))
        assert plain[doc] == kept


def test_rewriting_keeps_other_columns_and_spacing(spark):
    body = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(1, body, "x"), (2, f"own  words\n{body} end\there", "y"), (3, None, "z"), (None, body, "w")], "doc_id long, text string, blobs string")
    out = {r["blobs"]: (r["doc_id"], r["text"]) for r in substring_dedup.rewritten(docs).collect()}
    assert out == {"x": (1, body), "y": (2, "own  words end\there"), "z": (3, None), "w": (None, body)}


@pytest.mark.parametrize("hot, paired", [(2_000, 24), (2, 24), (2_000, 1)])
def test_strings_that_start_earlier_go(monkeypatch, corpus, hot, paired):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MOST_PAIRED", paired)
    monkeypatch.setattr(suffix_dedup, "BATCH_ANCHORS", 16)
    monkeypatch.setattr(suffix_dedup, "BATCH", 200)
    length = 40
    out = {r["doc_id"]: r for r in suffix_dedup.deduplicated(corpus, length, digests=True).collect()}
    seen = set()
    for doc, text in in_order(corpus):
        data = text.encode()
        edge = np.zeros(len(data) + 1, int)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                edge[i] += 1
                edge[i + length] -= 1
            seen.add(data[i : i + length])
        keep = np.cumsum(edge[:-1]) == 0
        kept = bytes(b for b, k in zip(data, keep.tolist(), strict=True) if k)
        spans = int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum())
        assert (out[doc]["n_bytes"], out[doc]["n_removed"], out[doc]["n_spans"], out[doc]["kept_sha256"]) == (len(data), len(data) - len(kept), spans, sha(kept)), doc


def anchors_of(texts, length):
    """All anchors of texts, in corpus order; documents are numbered from 0."""
    data = [t if isinstance(t, bytes) else t.encode() for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    found = suffix_dedup.Instances(flat, offsets, length)
    windows = found.last - found.first + 1
    return suffix_dedup.Anchors(found.hash, found.text, found.first - offsets[found.text], windows, found.at - found.first, flat[suffix_dedup.spread(found.first, windows + length - 1)], length)


@pytest.mark.parametrize("paired, batch, windows", [(24, 1 << 16, 1 << 16), (24, 7, 1 << 16), (1, 7, 30), (3, 40, 100)])
def test_the_family_finds_every_window(monkeypatch, paired, batch, windows):
    """Pairs, crowds and equal surroundings in one batch and in many; levels stay logarithmic."""
    monkeypatch.setattr(suffix_dedup, "MOST_PAIRED", paired)
    monkeypatch.setattr(suffix_dedup, "BATCH_ANCHORS", batch)
    monkeypatch.setattr(suffix_dedup, "BATCH", windows)
    rng, length = random.Random(paired + batch), 12
    passages = ["".join(rng.choices("ab\0", k=rng.randint(5, 40))) for _ in range(12)]
    texts = ["".join(rng.choices([*passages, "x", "yy", "\0\0"], k=rng.randint(0, 8))) for _ in range(60)] + ["a" * 50] * 3
    family = suffix_dedup.SuffixFamily(length)
    doc, start, runs = family.extend(anchors_of(texts, length))
    got = {(d, s + i) for d, s, n in zip(doc.tolist(), start.tolist(), runs.tolist(), strict=True) for i in range(n)}
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                want.add((d, i))
            seen.add(t[i : i + length])
    assert got == want
    sizes = list(map(len, family.levels))
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 10


def test_a_kept_index_meets_the_next_batch(spark, corpus):
    """Two batches through a kept index mark what one run over both does."""
    length = 40
    rows = in_order(corpus)
    whole, cut = {r["doc_id"]: r["blob"] for r in suffix_dedup.later_windows(suffix_dedup.base.documents(corpus), length).collect()}, 45
    marks, index = suffix_dedup.extended(corpus.where(f"doc_id < {cut}"), None, length)
    later, index = suffix_dedup.extended(corpus.where(f"doc_id >= {cut}"), index, length)
    assert {r["doc_id"] for r in marks.collect()} <= set(range(cut))
    kept = {r["doc_id"]: r["blob"] for r in marks.union(later).collect()}
    for doc, text in rows:
        n = len(text.encode())
        assert suffix_dedup.kept_bytes(n, kept.get(doc), length).tolist() == suffix_dedup.kept_bytes(n, whole.get(doc), length).tolist(), doc
    again, _ = suffix_dedup.extended(corpus.where("doc_id % 7 = 0"), index, length)
    gone = {r["doc_id"]: r["blob"] for r in again.collect()}
    for doc, text in rows:
        if doc % 7 == 0 and len(text.encode()) >= length:
            assert not suffix_dedup.kept_bytes(len(text.encode()), gone[doc], length).any()


def test_anchors_that_become_hot_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda repeated: np.array(sorted(hot), np.uint64))
    length, hot = 20, set()
    texts = [f"{i} some common passage of many words {i} and more" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = suffix_dedup.deduplicated(docs, length).orderBy("doc_id").collect()
    marks, index = suffix_dedup.extended(docs.where("doc_id < 10"), None, length)
    hot |= set(anchors_of(texts, length).h.tolist()[::2])
    later, _ = suffix_dedup.extended(docs.where("doc_id >= 10"), index, length)
    got = {r["doc_id"]: r["blob"] for r in marks.union(later).collect()}
    for r, text in zip(plain, texts, strict=True):
        keep = suffix_dedup.kept_bytes(len(text), got.get(r["doc_id"]), length)
        assert bytes(b for b, k in zip(text.encode(), keep.tolist(), strict=True) if k) == bytes(r["kept"])


def brute_join(rows, words, similar):
    sets = {}
    for doc, text in rows:
        w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    top, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * similar[1] >= similar[0] * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


@pytest.mark.parametrize("words, similar, block", [(4, (85, 100), 512), (5, (80, 100), 2), (1, (50, 100), 4)])
def test_join_finds_every_link(monkeypatch, corpus, words, similar, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.joined(corpus, words, similar).collect()}
    assert out == brute_join(in_order(corpus), words, similar)


def test_odd_documents_and_empty_tables(docs, empty):
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(docs).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert ngram_join.joined(empty).count() == 0
    for operator in (substring_dedup, suffix_dedup):
        assert operator.deduplicated(docs).count() == 10
        assert operator.deduplicated(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_range_join_is_exact(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[rng.integers(6, size=90)] + rng.normal(scale=0.12, size=(90, 8)), rng.normal(size=(30, 8))])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(500 + i, x[3].tolist(), 1) for i in range(20)]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 8, None), (904, [1.0, None], 1), (905, [], 1), (906, [float("inf")] * 8, 0), (907, [1.0, 1.0], 1), (None, [1.0] * 8, 1)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    top, links = {r[0]: r[0] for r in rows}, dict.fromkeys([r[0] for r in rows], 0)

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for i, (a, u, l1) in enumerate(rows):
        for b, v, l2 in rows[:i]:
            if l1 == l2 and np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    for r in rows:
        assert out[r[0]] == (links[r[0]], find(r[0]), find(r[0]) == r[0])
    for r in odd[:-1]:
        assert out[r[0]] == (0, r[0], True)
    assert len(out) == len(rows) + len(odd) - 1


def test_repeated_ids_are_one_document(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:20])), (1, " ".join(words[20:])), (1, " ".join(words[:20])), (2, "\n".join(words)), (3, " ".join(words[:20])), (2, None)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (36, 1, 1), 2: (36, 1, 1), 3: (16, 3, 0)}


@pytest.mark.parametrize("far", [0, 1 << 61])
def test_texts_of_one_id_are_judged_each_on_its_own(spark, far):
    """far: ids beside which no bits are left for the number of a text."""
    alpha, beta, gamma = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma"))
    rows = [(0, alpha), (1, alpha), (1, beta), (1, beta), (2 + far, f"{gamma} {beta}"), (2 + far, gamma), (-far, None), (None, alpha)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(0, alpha), (1, ""), (1, beta), (1, beta), (2 + far, gamma), (2 + far, gamma), (-far, "")])
    cut = substring_dedup.deduplicated(table).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in cut) == want
    assert sorted((r["doc_id"], r["text"] or "") for r in substring_dedup.rewritten(table).where("doc_id is not null").collect()) == want
    # strings of 100 bytes: one of the two rows with gamma has it later than the other
    kept = sorted((r["doc_id"], r["kept"].decode().strip()) for r in suffix_dedup.deduplicated(table).collect())
    later = [t for i, t in kept if i == 2 + far]
    assert sorted(later) == sorted(["", gamma]) and [x for x in kept if x[0] != 2 + far] == sorted([(-far, ""), (0, alpha), (1, ""), (1, beta), (1, beta)])
