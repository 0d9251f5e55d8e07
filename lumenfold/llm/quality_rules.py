"""Quality rules with tokeniser fertility.

Public vocabularies say how well a text is made of the pieces its language is usually made of:
characters per token, the share of byte-fallback tokens, and the entropy of its tokens. Each language
(or, without one, each script) has its own rejection bands, from medians of all documents:

* characters per token: |value - median| * sqrt(tokens) beyond BAND medians of itself, as the
  spread of a mean shrinks with the root of its length;
* entropy: beyond BAND median deviations below the median of documents of like length (half
  powers of two of tokens), since long texts have more of it;
* byte fallback: more than FALLBACK above the language's median and beyond BAND median deviations.

Two vocabularies of different kinds are asked: pieces with byte fallback, and byte-level pairs made for many
languages, where a token that is no whole characters counts as fallback. Each has medians of its own, and
a document is out of a band if its deviations, in what each vocabulary allows, are beyond it on average,
so that what one vocabulary happens to lack rejects nothing alone.

Every document is judged. A cell's median and deviation are drawn towards those of the next wider
cell, which count as much as WIDER documents: language to script to all documents, and for entropy
language and length to script and length to length to all. Deviations of all documents are drawn
in the same way towards PRIOR, as three documents that happen to be alike say little of a fourth. So
a cell of few documents has about its wider cell's bands, a corpus of few has wide ones, and no
size changes the rule. Equal texts count once, so a text
that a third of all rows repeat doesn't set the bands; different texts with equal figures count each.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import base
from lumenfold.llm.base import SEPARATOR, chunks, flat, group_starts, mix, rolling, spread, word_hashes, word_spans, written
from lumenfold.llm.tokens import CODED_BYTES, Coder, coded, joined

BAND = 8.0
WIDER = 30
FALLBACK = 0.1
#: Figures are counted in steps of 1 / STEPS, and deviations in steps of a STEPS-th power of two, so
#: the medians' histograms have a few thousand entries however many and long the documents are.
STEPS = 128
#: Base rules: fewer words fail, and a larger share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8

#: Deviations that count as WIDER documents beside all of them, in steps: of characters a token (times the
#: root of tokens), share of byte fallback, and bits of entropy.
PRIOR = {"d_chars": 2.0 * STEPS, "d_bytes": 0.05 * STEPS, "d_bits": 0.25 * STEPS}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Scripts by the first byte of their characters in UTF-8.
_SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east-asian", "other")
_SCRIPT = np.full(256, -1)
_SCRIPT[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = 0
_SCRIPT[[0xCD, 0xCE, 0xCF]] = 1
_SCRIPT[range(0xD0, 0xD4)] = 2
_SCRIPT[range(0xD6, 0xDE)] = 3
_SCRIPT[0xE0] = 4
_SCRIPT[range(0xE3, 0xEE)] = 5
_SCRIPT[[0xE1, 0xE2, *range(0xEE, 0xF5)]] = 6

_held: dict = {}
base.CACHES.append(_held)


#: The vocabularies, the first of which also says how long a text is.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: What each vocabulary's columns are called after.
SUFFIXES = ("", "_2")


def _pieces(path: str):
    """Of a sentencepiece vocabulary: words to id lists, and which ids are bytes it fell back to."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fallback = [model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())]
    return lambda words: model.encode(words, num_threads=1), fallback


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _pairs(path: str):
    """Of a byte-level vocabulary of ranks: words (as they stand after a space; an empty one has none) to id lists, and which ids are no whole characters."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fallback = [True] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        fallback[rank] = not _whole(token)
    return lambda words: [encoding.encode_ordinary(" " + w) if w else [] for w in words], fallback


def vocabulary_coder(paths: tuple[str, ...]) -> tuple[Coder, np.ndarray, np.ndarray]:
    """Ids of words in all vocabularies, one after another, the ids of each beginning where those before end; which ids are
    fallbacks; and where each vocabulary's begin."""
    if paths not in _held:
        base.release()  # of other vocabularies
        parts = [(_pieces if path.endswith(".model") else _pairs)(path) for path in paths]
        begin = np.concatenate([[0], np.cumsum([len(f) for _, f in parts])])

        def encode(words: list) -> tuple[np.ndarray, np.ndarray]:
            lists = [joined(code(words)) for code, _ in parts]
            each = np.array([sizes for _, sizes in lists]).reshape(len(parts), -1)
            sizes = each.sum(axis=0)
            at = np.cumsum(sizes) - sizes + np.concatenate([np.zeros((1, len(words)), np.int64), np.cumsum(each, axis=0)[:-1]])
            out = np.zeros(int(sizes.sum()), np.uint32)
            for k, (ids, _) in enumerate(lists):
                out[spread(at[k], each[k])] = ids + np.uint32(begin[k])
            return out, sizes

        _held[paths] = Coder(encode), np.concatenate([np.array(f, bool) for _, f in parts]), begin
    return _held[paths]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, and a hash of its words."""
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    lines = np.zeros(len(n_words), np.int64)
    raw = data.tobytes()
    for i in range(len(n_words)):
        found = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(found) - len(set(found))
    windows = np.maximum(n_words - REPEAT_WINDOW + 1, 0)
    where = spread(first[:-1], windows)
    words = word_hashes(data, starts, ends)
    prints = mix(rolling(words, first[:-1], first[1:]) + n_words.astype(np.uint64))
    h = mix(rolling(words, where, where + REPEAT_WINDOW))
    h = mix(h ^ mix(np.repeat(np.arange(len(n_words), dtype=np.uint64), windows)))
    order = np.argsort(h, kind="stable")
    begin = group_starts(h[order])
    each = np.diff(np.append(begin, len(h)))
    edge = np.zeros(len(starts) + 1, np.int64)
    again = where[order[np.repeat(each > 1, each)]]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return {"n_words": n_words, "word_chars": total(~SEPARATOR[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data]), "n_dup_lines": lines, "n_repeat_words": covered[first[1:]] - covered[first[:-1]], "print": prints.view(np.int64)}


def script_votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many characters of each script each text has."""
    script = _SCRIPT[data]
    return np.stack([np.diff(np.concatenate([[0], np.cumsum(script == k)])[offsets]) for k in range(len(_SCRIPTS))])


def fertility(column: pa.Array, paths: tuple[str, ...] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vocabulary: tokens, byte-fallback tokens and token entropy (bits) of each text, its words encoded one by one."""
    coder, fallback, begin = vocabulary_coder(paths or tuple(public_tokenizers.path(v) for v in VOCABULARIES))
    out = [tuple(np.zeros(len(column), kind) for kind in (np.int64, np.int64, float)) for _ in begin[1:]]
    for i, j, first, codes in coded(column, coder):
        ids, each = coder.gather(codes)
        of = np.repeat(np.arange(j - i), np.diff(np.concatenate([[0], np.cumsum(each)])[first]))
        keys = of * len(fallback) + ids
        for k, (n, bytes_, entropy) in enumerate(out):
            mine = (ids >= begin[k]) & (ids < begin[k + 1])
            n[i:j] = np.bincount(of[mine], minlength=j - i)
            bytes_[i:j] = np.bincount(of[mine], fallback[ids[mine]], j - i)
            key = np.sort(keys[mine])
            starts = group_starts(key)
            times = np.diff(np.append(starts, len(key)))
            text = key[starts] // len(fallback)
            share = times / n[i:j][text]
            entropy[i:j] = np.bincount(text, -share * np.log2(share), j - i)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id bigint, lang string, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "print")) + "".join(f", n_tokens{x} bigint, n_fallback{x} bigint, entropy{x} double" for x in SUFFIXES) + ", script string"


def measured(docs: DataFrame, vocabularies: tuple[str, ...] | None = None) -> DataFrame:
    """The counts of every document; a map over rows, nothing is shuffled. docs: doc_id, text, lang."""

    def run(batches):
        for batch in batches:
            for part in base.pieces(batch, CODED_BYTES):
                data, offsets = flat(part.column("text"))
                found = [base_counts(d, o) for _, _, d, o in chunks(data, offsets)]  # a megabyte at a time
                counts = {c: np.concatenate([x[c] for x in found]) for c in (*COUNTS, "print")}
                tokens = [x for found_ in fertility(part.column("text"), vocabularies) for x in found_]
                votes = np.concatenate([script_votes(d, o) for _, _, d, o in chunks(data, offsets)], axis=1)
                names = np.array(_SCRIPTS)[votes.argmax(axis=0)]
                columns = [part.column("doc_id"), part.column("lang"), *(pa.array(counts[c], pa.int64()) for c in (*COUNTS, "print")), *map(pa.array, tokens), pa.array(names.astype(object), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *COUNTS, "print", *(f"{c}{x}" for x in SUFFIXES for c in ("n_tokens", "n_fallback", "entropy")), "script"])
                del data, offsets, found, counts, tokens, votes, names, columns
        base.trim()

    return docs.mapInArrow(run, MEASURED)


#: Cells, from the widest to a document's own; the columns of each.
_CELL = ["kind", "script", "length_class"]
_BY_KIND = ([], ["script"], ["kind"])
_BY_LENGTH = ([], ["length_class"], ["script", "length_class"], ["kind", "length_class"])


def medians(rows: DataFrame, cells: DataFrame, values: dict[str, tuple[list[str], ...]], priors: dict[str, float] | None = None) -> DataFrame:
    """cells (kind, script, length_class) with the median of each value, drawn from its prior, if it has
    one, and the widest cell to the cell's own as `values` says. Medians are aggregates that combine counts of values before the shuffle."""
    priors = priors or {}
    kinds = sorted({tuple(k) for chain in values.values() for k in chain})
    found = rows.groupingSets([[F.col(c) for c in k] for k in kinds], *_CELL).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *(F.percentile(v, 0.5).alias(v) for v in values))
    found = written(found)
    known = {v: None for v in values}
    for keys in sorted(kinds, key=len):
        level = sum(1 << (len(_CELL) - 1 - i) for i, c in enumerate(_CELL) if c not in keys)
        names = {v: f"__{v}_{level}" for v, chain in values.items() if list(keys) in chain}
        wide = found.where(F.col("level") == level).select(*keys, F.col("n").alias(f"__n_{level}"), *(F.col(v).alias(n) for v, n in names.items()))
        cells = cells.join(wide, list(keys)) if keys else cells.join(F.broadcast(wide))  # one row
    for v, chain in values.items():
        drawn: Column | None = None
        for keys in chain:
            level = sum(1 << (len(_CELL) - 1 - i) for i, c in enumerate(_CELL) if c not in keys)
            own, n = F.col(f"__{v}_{level}"), F.col(f"__n_{level}")
            if drawn is None and v in priors:
                drawn = F.lit(priors[v])
            drawn = own if drawn is None else (n * own + WIDER * drawn) / (n + WIDER)
        known[v] = drawn
    return cells.select(*_CELL, *(c.alias(f"m_{v}") for v, c in known.items()))


def judged(docs: DataFrame, vocabularies: tuple[str, ...] | None = None, band: float = BAND, lang_col: str | None = "lang") -> DataFrame:
    """The counts of every document, base_failed (too few words, or too many in repeated windows), its
    fertility by each of the two vocabularies (paths; chars_per_token, fallback_share, entropy) and kept.

    Null texts have no words and fail. Documents without a language are held to their script's
    bands. An empty table gives no rows; rows that repeat an id are judged each on its own, and
    count once in bands if their words are equal too."""
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).where("doc_id is not null")
    base.bounded(docs.sparkSession)
    facts = written(measured(rows, vocabularies))
    facts = facts.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    facts = facts.withColumn("kind", F.coalesce("lang", F.concat(F.lit("script:"), "script")))
    step = lambda c: F.round(c * STEPS)
    for x in SUFFIXES:
        tokens = F.greatest(f"n_tokens{x}", F.lit(1))
        facts = facts.withColumn(f"chars_per_token{x}", F.col("word_chars") / tokens).withColumn(f"fallback_share{x}", F.col(f"n_fallback{x}") / tokens)
        facts = facts.withColumn(f"chars{x}", step(F.col(f"chars_per_token{x}"))).withColumn(f"bits{x}", step(F.col(f"entropy{x}"))).withColumn(f"bytes{x}", step(F.col(f"fallback_share{x}")))
    facts = facts.withColumn("length_class", F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))).cast("int"))
    figures = ["script", "length_class", *(f"{c}{x}" for x in SUFFIXES for c in ("n_tokens", "chars", "bits", "bytes"))]
    once = facts.where(F.col("n_words") >= LEAST_WORDS).groupBy("kind", "print").agg(F.min(F.struct(*figures)).alias("f"))
    once = written(once.select("kind", "f.*"))
    cells = once.select(*_CELL).distinct()
    chains = {"chars": _BY_KIND, "bytes": _BY_KIND, "bits": _BY_LENGTH}
    middle = written(medians(once, cells, {f"{c}{x}": k for x in SUFFIXES for c, k in chains.items()}))
    power = lambda c: F.round(F.log2(1 + c) * STEPS)
    apart = lambda c, x: F.abs(F.col(f"{c}{x}") - F.col(f"m_{c}{x}")) * (F.sqrt(f"n_tokens{x}") if c == "chars" else F.lit(1.0))
    off = once.join(middle, _CELL).select(*_CELL, *(power(apart(c, x)).alias(f"d_{c}{x}") for x in SUFFIXES for c in chains))
    priors = {f"{k}{x}": float(np.round(np.log2(1 + d) * STEPS)) for k, d in PRIOR.items() for x in SUFFIXES}
    spread_ = medians(off, cells, {f"d_{c}{x}": k for x in SUFFIXES for c, k in chains.items()}, priors)
    bands = written(middle.join(spread_, _CELL))
    held = facts.join(bands, _CELL, "left")
    back = lambda c: F.pow(F.lit(2.0), F.col(c) / STEPS) - 1
    mean = lambda parts: sum(parts[1:], parts[0]) / len(parts)
    chars = mean([apart("chars", x) / F.greatest(back(f"m_d_chars{x}"), F.lit(STEPS / 4)) for x in SUFFIXES]) > band
    entropy = mean([(F.col(f"m_bits{x}") - F.col(f"bits{x}")) / F.greatest(back(f"m_d_bits{x}"), F.lit(2.0)) for x in SUFFIXES]) > band
    fallback = mean([(F.col(f"bytes{x}") - F.col(f"m_bytes{x}")) / F.greatest(back(f"m_d_bytes{x}"), F.lit(FALLBACK * STEPS / band)) for x in SUFFIXES]) > band
    rejected = F.coalesce(chars | entropy | fallback, F.lit(False))
    shown = [f"{c}{x}" for x in SUFFIXES for c in ("n_tokens", "chars_per_token", "fallback_share", "entropy")]
    return held.select("doc_id", *COUNTS, "base_failed", *shown, (~F.col("base_failed") & ~rejected).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: doc_id, the five counts, base_failed, kept and the fertility figures."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
