"""DuckDB SQL for the queries that SQL can say: plain, and only for small tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Windows, the smallest document of each, the words that marked windows cover, and what is left.
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
marked AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM marked, (SELECT unnest(range(13)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Sets of shingles, pairs that share one, and the smallest document that links reach.
NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT s.doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(r.root) AS component_id, (SELECT count(*) FROM l WHERE l.a = s.doc_id) AS n_links FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id
"""

#: Cosines of all pairs of a label.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(root) AS component_id, v.vec_id = min(root) AS kept FROM v JOIN r ON r.node = v.vec_id GROUP BY v.vec_id
"""

#: Strings of 100 bytes that an earlier start has, the runs of bytes that they cover, and what lies between.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
marked AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
cut AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM marked),
run AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM cut) GROUP BY doc_id, r),
part AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM run),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS gone, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS t FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Integer vectors, the first 40 by digest, five rounds of floors of means, and the last assignment.
CENTROIDS = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)," + """
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS z, e FROM (SELECT e, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),""" + "".join(
    f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, min_by(z, (d, z)) AS z, min(d) AS d FROM (SELECT vec_id, v.e, z, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c) v GROUP BY vec_id),
s{r} AS (SELECT z, i, sum(x) AS s, count(*) AS n FROM (SELECT z, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY z, i),
c{r + 1} AS MATERIALIZED (SELECT c.z, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT z, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY z) m USING (z)),"""
    for r in range(6)
) + """
t AS (SELECT z, CAST(sum(d) AS BIGINT) AS s FROM a5 GROUP BY z)
SELECT vec_id, CAST(a5.z AS INTEGER) AS cluster, d AS distance, t.s AS cluster_inertia, CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c5.e, ',')) AS centroid_sha256
FROM a5 JOIN t USING (z) JOIN c5 USING (z)
"""

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"


def _tree(name: str, first: str, levels: int) -> str:
    """CTEs of a tree's levels: pairs become their digest, a lone node stays as it is; and of each leaf's siblings."""
    out = f"{name}0 AS (SELECT g, i, n, h FROM {first}),\n"
    for k in range(levels):
        up = f"SELECT g, i // 2 AS i, (any_value(n) + 1) // 2 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, i // 2"
        out += f"{name}{k + 1} AS MATERIALIZED ({up}),\n"
    return out


def _path(name: str, levels: int) -> str:
    """Columns p (siblings) and f (what a leaf t folds to) of each leaf in `{name}l`, level by level."""
    out = f"{name}p0 AS (SELECT g, i AS pos, i, t, '' AS p FROM {name}l),\n"
    for k in range(levels):
        step = f"SELECT x.g, pos, x.i // 2 AS i, CASE WHEN o.n = 1 THEN t WHEN s.h IS NULL THEN sha256(t) WHEN x.i % 2 = 1 THEN sha256(s.h || t) ELSE sha256(t || s.h) END AS t, p || CASE WHEN o.n = 1 THEN '' ELSE coalesce(s.h, '') END AS p"
        out += f"{name}p{k + 1} AS MATERIALIZED ({step} FROM {name}p{k} x JOIN (SELECT g, i, n FROM {name}{k}) o ON o.g = x.g AND o.i = x.i LEFT JOIN {name}{k} s ON s.g = x.g AND s.i = xor(x.i, 1)),\n"
    return out


#: Levels that the SQL goes up: enough for as many leaves of a language as two to this power, and for as many languages.
_UP, _UP_LANGS = 14, 4

#: The table of CRC-32 from its polynomial, leaves, levels, siblings and what leaves fold to.
MERKLE = f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8),
d AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) % 7 = 0 AS hit FROM documents, tab),
leaf AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE 'v' || lang END AS g, {_LEAF.format(n="n_chars")} AS h, {_LEAF.format(n="n_chars + CASE WHEN hit THEN 1 ELSE 0 END")} AS t FROM d),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf),
al AS (SELECT g, i, t FROM placed),
{_tree("a", "placed", _UP)}{_path("a", _UP)}
langs AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS lang FROM a{_UP}),
{_tree("b", "langs", _UP_LANGS)}
bs AS (SELECT placed.g || ' ' || placed.i AS leaf_of, langs.i AS i, p, ap.t FROM placed JOIN ap{_UP} ap ON ap.g = placed.g AND ap.pos = placed.i JOIN langs ON langs.lang = placed.g),
bp0 AS (SELECT leaf_of, i, t, p FROM bs),
""" + "".join(
    f"bp{k + 1} AS MATERIALIZED (SELECT leaf_of, x.i // 2 AS i, CASE WHEN o.n = 1 THEN t WHEN s.h IS NULL THEN sha256(t) WHEN x.i % 2 = 1 THEN sha256(s.h || t) ELSE sha256(t || s.h) END AS t, p || CASE WHEN o.n = 1 THEN '' ELSE coalesce(s.h, '') END AS p FROM bp{k} x JOIN (SELECT i, n FROM b{k}) o ON o.i = x.i LEFT JOIN b{k} s ON s.i = xor(x.i, 1)),\n"
    for k in range(_UP_LANGS)
) + f"""
root AS (SELECT h AS root FROM b{_UP_LANGS})
SELECT doc_id, placed.h AS leaf, langs.h AS subroot, root, sha256(p) AS proof_sha256, bp.t AS folded_root, bp.t = root AS verified
FROM placed JOIN langs ON langs.lang = placed.g JOIN bp{_UP_LANGS} bp ON bp.leaf_of = placed.g || ' ' || placed.i CROSS JOIN root
"""

ORACLE_SQL = {"op4_suffix_dedup": SUFFIX_DEDUP, "op2_ngram_join": NGRAM_JOIN, "op6_substring_dedup": SUBSTRING_DEDUP, "op8_embedding_dedup": EMBEDDING_DEDUP, "op12_centroid_clusters": CENTROIDS, "op13_merkle_manifest": MERKLE}
