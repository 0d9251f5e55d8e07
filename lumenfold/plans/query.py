"""What the driver knows before a query runs: the parsed text, its intent, its route, and what follows from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import text as T

# Words that tell an intent, in the order in which intents are tried.
HINTS = {
    "compression-feedback": ["compress", "compression", "compressor", "feedback", "retrieve", "retrieval", "stats", "hash", "ccr"],
    "freshness/status": ["fresh", "freshness", "stale", "pending", "failed", "manifest", "status", "sync", "autosync", "update", "updates", "vector", "vectors", "changed"],
    "graph-navigation": ["graph", "impact", "caller", "callers", "callee", "callees", "call", "calls", "dependency", "dependencies", "trace", "flow", "topology"],
    "semantic-ranking": ["semantic", "similar", "ranking", "rank", "relevance", "related", "rerank", "retrieve"],
}
GRAPH_FIRST = ["caller", "callers", "callee", "callees", "impact", "trace", "topology"]
FILTER_ALIASES = {"lang": "language", "language": "language", "kind": "kind", "file": "file", "path": "path", "name": "name"}

# How much each source counts on a route, and each feature for an intent.
ROUTE_WEIGHTS = {"graph-first": {"graph": 1.25, "vector": 1.0, "fts": 1.0}, "graph-first-filter": {"graph": 1.25, "vector": 1.0, "fts": 1.0}, "vector-first": {"graph": 1.0, "vector": 1.35, "fts": 1.0}, "hybrid": {"graph": 1.0, "vector": 1.0, "fts": 1.0}}
PRIOR_WEIGHTS = {"graph-first": 0.35, "graph-first-filter": 0.45, "vector-first": 0.1, "hybrid": 0.2}
FEATURE_WEIGHTS = {
    "exact-symbol": {"lexical": 0.2, "semantic": 0.05, "structure": 0.65, "freshness": 0.1},
    "graph-navigation": {"lexical": 0.22, "semantic": 0.18, "structure": 0.5, "freshness": 0.1},
    "freshness/status": {"lexical": 0.18, "semantic": 0.12, "structure": 0.3, "freshness": 0.4},
    "semantic-ranking": {"lexical": 0.18, "semantic": 0.52, "structure": 0.22, "freshness": 0.08},
    "compression-feedback": {"lexical": 0.22, "semantic": 0.22, "structure": 0.4, "freshness": 0.16},
}
STATE_SCORES = {"fresh": 1.0, "pending": 0.45, "stale": 0.15, "failed": 0.0}
UNKNOWN_STATE = 0.6
#: Candidates of each branch, and of all, as multiples of the number of results.
CANDIDATES = {"graph": 6, "vector": 2, "fts": 6, "merged": 8}

_SYMBOL = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*$")
_PATH = re.compile(r"[\\/]|::|\.[A-Za-z0-9]{1,8}\b")


def is_symbol(text: str) -> bool:
    text = text.strip()
    return bool(_SYMBOL.match(text)) and bool(re.search("[a-z0-9][A-Z]", text) or text[:1].isupper() or "_" in text)


def is_path(text: str) -> bool:
    return bool(_PATH.search(text))


def tokens(text: str, synonyms: bool = True) -> list[str]:
    """The driver's form of functions.text.tokens."""
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text))
    words = [w for w in re.split(r"\s+", re.sub(r"""[_\-./:(){}\[\],;<>+=!?'"`|\\]+""", " ", text).lower()) if len(w) >= T.LEAST_TOKEN and not w.isdecimal()]
    out = set(words)
    for w in words:
        forms = [w[: -len(e)] for e in ("ation", "ing", "ed", "es", "s") if w.endswith(e) and len(w) > len(e) + 2]
        if w.endswith("ation") and len(w) > 7:
            forms.append(w[:-5] + "e")
        if w.endswith("ing") and len(w) > 5:
            root = w[:-3]
            forms.append(root[:-1] if root[-1:] == root[-2:-1] else root)
        out.update(f for f in forms if len(f) >= T.LEAST_TOKEN)
        out.update(T.SYNONYMS.get(w, ()) if synonyms else ())
    if synonyms and out & set(T.ROUTING_ANCHORS) and out & set(T.ROUTING_TRIGGERS):
        out |= set(T.ROUTING_HINTS)
    return sorted(out)


@dataclass(frozen=True)
class Query:
    """A parsed query; everything later stages choose by is here, before any plan is built."""

    original: str
    text: str
    filters: dict[str, str] = field(default_factory=dict)
    terms: tuple[str, ...] = ()
    intent: str = "graph-navigation"
    route: str = "hybrid"

    @property
    def weights(self) -> dict[str, float]:
        return ROUTE_WEIGHTS[self.route]

    @property
    def features(self) -> dict[str, float]:
        return FEATURE_WEIGHTS[self.intent]

    @property
    def vector_mode(self) -> str:
        """How vectors are searched: `dense`, `sparse` or `hybrid`, both at once."""
        if self.intent == "semantic-ranking":
            return "sparse" if self.filters.get("path") or self.filters.get("file") else "hybrid"
        return "hybrid" if self.intent in ("compression-feedback", "freshness/status") else "dense"

    def feature_weights(self, mode: str = "hybrid", lexical: float | None = None, semantic: float | None = None) -> dict[str, float]:
        """What each feature counts, 1 in all. Mode `bm25` counts words alone, `embedding` meaning alone. Own weights of
        these two leave what they don't use to structure and freshness alike; else the intent says."""
        if mode in ("bm25", "embedding"):
            return {"lexical": float(mode == "bm25"), "semantic": float(mode == "embedding"), "structure": 0.0, "freshness": 0.0}
        if mode != "hybrid":
            raise ValueError(f"no such mode: {mode}")
        made = dict(self.features)
        if lexical is not None or semantic is not None:
            one, two = max(0.0, lexical or 0.0), max(0.0, semantic or 0.0)
            rest = max(0.0, 1 - one - two) / 2
            made = {"lexical": one, "semantic": two, "structure": rest, "freshness": rest}
        total = sum(made.values())
        return {k: v / total for k, v in made.items()} if total > 0 else {"lexical": 1.0, "semantic": 0.0, "structure": 0.0, "freshness": 0.0}

    @property
    def symbols(self) -> list[str]:
        return [p for p in self.text.split() if is_symbol(p)]

    @property
    def paths(self) -> list[str]:
        return [p for p in self.text.split() if is_path(p)]

    @property
    def anchors_only(self) -> bool:
        """Enough paths or exact symbols that vector and text candidates add nothing."""
        return len(self.paths) >= 2 or len(self.symbols) >= 3


def parse(query: str) -> Query:
    """key:value words become filters (the last of a key wins), the rest is the text."""
    filters, rest = {}, []
    for part in query.split():
        key, colon, value = part.partition(":")
        if colon and value and not value.startswith(":") and key.lower() in FILTER_ALIASES:
            filters[FILTER_ALIASES[key.lower()]] = value
        else:
            rest.append(part)
    text = " ".join(rest)
    seed = text or filters.get("name") or filters.get("file") or filters.get("path") or ""
    terms = tuple(tokens(seed))
    made = intent(text, filters, terms)
    return Query(query, text, filters, terms, made, route(text, filters, terms, made))


def field_columns(text: Column) -> dict[str, Column]:
    """`parse` of many queries at once: a column a field (null where it is missing), and `rest`, the free text."""
    parts = T.word_list(text)
    is_field = lambda names: lambda p: p.rlike(f"(?i)^({'|'.join(names)}):[^:]")
    out = {}
    for name in dict.fromkeys(FILTER_ALIASES.values()):
        found = F.filter(parts, is_field([k for k, v in FILTER_ALIASES.items() if v == name]))
        out[name] = F.regexp_replace(F.try_element_at(found, F.lit(-1)), "^[^:]*:", "")
    rest = is_field(list(FILTER_ALIASES))
    return out | {"rest": F.array_join(F.filter(parts, lambda p: ~rest(p)), " ")}


def intent(text: str, filters: dict[str, str], terms: tuple[str, ...]) -> str:
    if is_symbol(text) or is_symbol(filters.get("name", "")):
        return "exact-symbol"
    has = {k: bool(set(terms) & set(v)) for k, v in HINTS.items()}
    for k in ("compression-feedback", "freshness/status"):
        if has[k]:
            return k
    parts = text.split()
    symbols = sum(map(is_symbol, parts))
    if len(parts) >= 2 and (symbols == len(parts) or symbols >= 3 or sum(map(is_path, parts)) >= 2):
        return "exact-symbol"
    if has["graph-navigation"] or not has["semantic-ranking"]:
        return "graph-navigation"
    return "semantic-ranking"


def route(text: str, filters: dict[str, str], terms: tuple[str, ...], made: str) -> str:
    if filters.get("path") or filters.get("file") or (filters.get("name") and not text):
        return "graph-first-filter"
    if made == "exact-symbol":
        return "graph-first"
    if made == "semantic-ranking":
        return "vector-first"
    if made != "graph-navigation":
        return "hybrid"
    if set(terms) & set(GRAPH_FIRST):
        return "graph-first"
    if set(terms) & set(HINTS["graph-navigation"]):
        return "hybrid"
    return "graph-first-filter" if is_path(text) else "hybrid"


def intent_column(text: Column) -> Column:
    """`intent` of a text without filters, for many queries at once."""
    terms = T.tokens(text, synonyms=True)
    parts = T.word_list(text)
    has = {k: F.arrays_overlap(terms, F.array(*map(F.lit, v))) for k, v in HINTS.items()}
    symbols, paths = F.size(F.filter(parts, T.is_symbol)), F.size(F.filter(parts, T.is_path))
    dense = (F.size(parts) >= 2) & ((symbols == F.size(parts)) | (symbols >= 3) | (paths >= 2))
    out = F.when(T.is_symbol(text), "exact-symbol").when(has["compression-feedback"], "compression-feedback").when(has["freshness/status"], "freshness/status").when(dense, "exact-symbol")
    return out.when(has["graph-navigation"] | ~has["semantic-ranking"], "graph-navigation").otherwise("semantic-ranking")


def route_column(text: Column, made: Column) -> Column:
    terms = T.tokens(text, synonyms=True)
    lit = lambda xs: F.array(*map(F.lit, xs))
    graph = F.when(F.arrays_overlap(terms, lit(GRAPH_FIRST)), "graph-first").when(F.arrays_overlap(terms, lit(HINTS["graph-navigation"])), "hybrid").when(T.is_path(text), "graph-first-filter").otherwise("hybrid")
    return F.when(made == "exact-symbol", "graph-first").when(made == "semantic-ranking", "vector-first").when(made == "graph-navigation", graph).otherwise("hybrid")


def checked(topk: int | str | None = None, threshold: float | str | None = None) -> tuple[int | None, float | None]:
    """Options as numbers: topk a whole number above 0, threshold from 0 to 1; ValueError for anything else."""
    try:
        whole = None if topk is None else int(str(topk).strip())
        share = None if threshold is None else float(str(threshold).strip())
    except ValueError as error:
        raise ValueError("topk must be a whole number, threshold a number") from error
    if whole is not None and whole <= 0:
        raise ValueError("topk must be above 0")
    if share is not None and not 0 <= share <= 1:
        raise ValueError("threshold must be from 0 to 1")
    return whole, share


def result_limit(query: Query, asked: int) -> int:
    """Results shown: more for queries rich in anchors, few for one exact symbol."""
    if len(query.symbols) + len(query.paths) >= 3:
        return min(12, max(asked, 12))
    return min(asked, 4) if query.intent == "exact-symbol" and len(query.text.split()) == 1 else min(asked, 10)
