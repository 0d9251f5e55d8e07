import random

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, docs, empty):
    words = [f"word{i}" for i in range(400)]
    text = lambda a, b: " ".join(words[a:b])
    rows = [(1, text(0, 100), "en", "a", 1), (2, text(0, 100), "en", "b", 1), (3, text(0, 99) + " changed", "en", "c", 1), (4, text(150, 250) + " " + text(20, 80), "en", "d", 1), (5, "too short", "en", "e", 1), (6, None, "en", "f", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
        seen[name] = {r["doc_id"]: r for r in table.collect()} if name != "packing" else table.collect()
        if name != "packing":
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            table = spark.createDataFrame(list(seen[name].values()), table.schema)
    assert set(seen["quality_rules"]) == {1, 2, 3, 4}
    assert set(seen["ngram_join"]) == {1, 4}
    cut = seen["substring_dedup"]
    assert cut[1]["text"] == rows[0][1]
    assert cut[4]["text"] == text(150, 250)
    assert cut[4]["n_chars"] == len(cut[4]["text"])
    assert {r["doc_id"] for r in seen["packing"]} == {1, 4}
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, empty, "").count() == 0
        assert stage(spark, docs, "").count() >= 0


def test_stages_against_plain_loops(spark):
    """Near duplicates and repeated passages of a made-up corpus, with columns named like the stages' own."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = []
    for i in range(40):
        body = rng.choices(vocabulary, k=rng.randint(5, 90))
        texts.append(" ".join(body))
        if i % 4 == 0:
            texts.append(" ".join([*body[:-1], "changed"]))
        if i % 5 == 0:
            texts.append(f"{passage} own{i} " + " ".join(rng.choices(vocabulary, k=20)))
    texts += ["", None]
    columns = "doc_id long, text string, __id long, __marks string, blob string, share int, n long"
    table = spark.createDataFrame([(i, t, -i, "m", "b", 1, 2) for i, t in enumerate(texts)], columns)
    stages = dict(corpus_pipeline.STAGES)

    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    kept = stages["ngram_join"](spark, table, "")
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, g in enumerate(group) if g == i]

    first, want = {}, {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if first.setdefault(tuple(words[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = t if t is None or not any(gone) else " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    cut = stages["substring_dedup"](spark, table, "")
    assert cut.columns == table.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    judged = stages["quality_rules"](spark, table, "")
    assert judged.columns == table.columns and None not in {r["text"] for r in judged.collect()}


def test_repeated_ids_and_an_empty_table(spark, tmp_path):
    """Rows of one id with different texts through all stages, from files; and no rows at all."""
    words = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(0, words("alpha"), "en"), (1, words("beta"), "en"), (1, f"{words('gamma')} {words('alpha')}", "en"), (1, "short", "en"), (None, words("delta"), "en"), (2, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, table, "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((i, t) for i, t, _ in rows[:3])
    cut = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, kept, "")
    assert sorted((r["doc_id"], r["text"]) for r in cut.collect()) == sorted([(0, words("alpha")), (1, words("beta")), (1, words("gamma"))])
    table.write.parquet(str(tmp_path / "some/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r["doc_id"] for r in out} == {0, 1} and len({(r["doc_id"], r["ids_crc32"]) for r in out}) == 3
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out)
    table.where("false").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
