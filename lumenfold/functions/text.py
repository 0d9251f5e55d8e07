"""Column functions on identifiers, paths, lines and free text: all built-in expressions, so they stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shortest token, and words that a query's words also stand for.
LEAST_TOKEN = 2
SYNONYMS = {
    "decide": ["route", "resolve", "select"],
    "decides": ["route", "resolve", "select"],
    "mixed": ["fusion", "merge"],
    "multiple": ["multi"],
    "ordering": ["rank", "ranking", "order"],
    "ordered": ["rank", "ranking", "order"],
    "priority": ["rank", "ranking", "order"],
    "relevance": ["rank", "ranking"],
    "result": ["candidate", "hit"],
    "results": ["candidate", "hit"],
    "routing": ["route", "resolve"],
    "source": ["origin", "input"],
    "sources": ["origin", "input"],
}
# A word of each of the first two sets brings in the third.
ROUTING_ANCHORS = ["priority", "ordering", "rank", "ranking"]
ROUTING_TRIGGERS = ["mixed", "multiple", "results", "search", "sources"]
ROUTING_HINTS = ["intent", "parse", "query", "route", "router"]

_PUNCTUATION = r"""[_\-./:(){}\[\],;<>+=!?'"`|\\]+"""


#: The marks of _PUNCTUATION one by one.
_MARKS = """_-./:(){}[],;<>+=!?'"`|\\"""


def _humps(text: Column) -> Column:
    camel = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(camel, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def spaced(text: Column) -> Column:
    """Words of identifiers and paths set apart by spaces; case stays."""
    return F.regexp_replace(_humps(text), _PUNCTUATION, " ")


def normalized(text: Column) -> Column:
    return F.lower(spaced(text))


def words(text: Column) -> Column:
    """Distinct, sorted tokens of LEAST_TOKEN characters or more that are not numbers; no stems."""
    # marks become spaces one by one, as runs of spaces split alike; only different tokens are looked at
    parts = F.split(F.lower(F.translate(_humps(text), _MARKS, " " * len(_MARKS))), r"\s+")
    return F.sort_array(F.filter(F.array_distinct(parts), lambda t: (F.length(t) >= LEAST_TOKEN) & ~t.rlike(r"^\d+$")))


def stems(token: Column) -> Column:
    """Shorter forms of a token by its endings; those of LEAST_TOKEN characters or more."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    plain = [F.when(token.endswith(e) & (n > len(e) + 2), cut(len(e))) for e in ("ation", "ing", "ed", "es", "s")]
    to_e = F.when(token.endswith("ation") & (n > 7), F.concat(cut(5), F.lit("e")))
    root = cut(3)
    doubled = (n > 4) & (F.substring(token, n - 3, F.lit(1)) == F.substring(token, n - 4, F.lit(1)))
    undoubled = F.when(token.endswith("ing") & (n > 5), F.when(doubled, cut(4)).otherwise(root))
    return F.filter(F.array_compact(F.array(*plain, to_e, undoubled)), lambda s: F.length(s) >= LEAST_TOKEN)


def tokens(text: Column, synonyms: bool = False) -> Column:
    """Distinct, sorted tokens with their stems and, if asked for, synonyms and routing hints."""
    base = words(text)
    parts = [base, F.flatten(F.transform(base, stems))]
    if synonyms:
        table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        none = F.array().cast("array<string>")
        parts.append(F.flatten(F.transform(base, lambda t: F.coalesce(F.try_element_at(table, t), none))))
    out = F.array_distinct(F.concat(*parts))
    if synonyms:
        lit = lambda xs: F.array(*map(F.lit, xs))
        asked = F.arrays_overlap(out, lit(ROUTING_ANCHORS)) & F.arrays_overlap(out, lit(ROUTING_TRIGGERS))
        out = F.when(asked, F.array_union(out, lit(ROUTING_HINTS))).otherwise(out)
    return F.sort_array(out)


def canonical(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9_$]", ""))


def reference_key(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def identifier_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized(text), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$")))


def is_symbol(text: Column) -> Column:
    """Looks like an exact symbol: an identifier with a camel hump, a leading capital or an underscore."""
    t = F.trim(text)
    return t.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & (t.rlike("[a-z0-9][A-Z]") | t.rlike("^[A-Z]") | t.contains("_"))


def is_path(text: Column) -> Column:
    return text.rlike(r"[\\/]") | text.contains("::") | text.rlike(r"\.[A-Za-z0-9]{1,8}\b")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)(/|$)|[._-](test|spec)\.[a-z]+$")


# What makes a path a test's, in files of a project and in words of a query.
_TEST_FILE = r"(?:^|/)(?:tests|unit_tests|integration_tests|__tests__)(?:/|$)|(?:^|/)src/test(?:/|$)|^tests/|\.test\.[cm]?[jt]sx?$|\.spec\.[cm]?[jt]sx?$"
_TEST_PART = r"(?i)(?:^|/)(?:tests|unit_tests|integration_tests)(?:/|$)|(?:^|/)src/test(?:/|$)|testdata"
_TEST_LIKE = r"(?i)(^|[/\\])(?:test|tests|spec|specs)([/\\]|$)|(?:test|spec)\.[A-Za-z0-9]+$"


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_test_file(path: Column) -> Column:
    """A file of tests, by its folders or its ending."""
    return F.lower(_slashes(path)).rlike(_TEST_FILE)


def is_test_part(part: Column) -> Column:
    """A word of a query that asks for tests' folders."""
    return _slashes(part).rlike(_TEST_PART)


def is_test_like(path: Column) -> Column:
    """Anything that looks like a test: the widest of the three."""
    return path.rlike(_TEST_LIKE)


# Words that say nothing of a symbol, and names that are too common to be one.
STOP_WORDS = ["the", "and", "for", "from", "with", "this", "that", "test", "tests", "src", "source", "unit", "integration", "function", "class", "method", "file", "path"]
BROAD_NAMES = ["add", "build", "check", "create", "delete", "execute", "fetch", "get", "init", "list", "load", "main", "open", "patch", "read", "run", "set", "start", "stop", "sync", "test", "update", "validate", "write"]
MOST_FTS_TERMS, MOST_FAMILIES = 16, 4


def exact_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case and in order."""
    return F.filter(F.transform(F.split(text, "[^A-Za-z0-9_]+"), F.lower), lambda t: t != "")


def split_identifiers(text: Column) -> Column:
    """Words of identifiers: cut at humps, underscores and marks; case stays."""
    return F.filter(F.split(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9_]+|_+"), lambda t: t != "")


def _telling(words: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike(r"^\d+$")))


def path_stem_tokens(path: Column) -> Column:
    """Telling words of a file's name without its ending."""
    return _telling(split_identifiers(F.regexp_replace(F.regexp_replace(_slashes(path), "^.*/", ""), r"\.[A-Za-z0-9]{1,8}$", "")))


def _clean_part(part: Column) -> Column:
    return F.regexp_replace(F.trim(part), "^[`'\"]+|[`'\",;]+$", "")


def query_paths(text: Column) -> Column:
    """Words of a query that hold a slash, without quotes and field names."""
    parts = F.filter(F.transform(word_list(text), _clean_part), lambda p: p.contains("/") | p.contains("\\"))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: _slashes(F.regexp_replace(F.regexp_replace(p, "(?i)^file:", ""), "(?i)^path:", ""))), lambda p: F.length(p) > 1))


def query_symbols(text: Column) -> Column:
    """Words of a query that may be names, and their last parts."""
    parts = F.filter(F.transform(word_list(text), _clean_part), lambda p: (p != "") & ~p.contains("/"))
    plain = F.transform(parts, lambda p: F.regexp_replace(p, "(?i)^(?:name|symbol|kind):", ""))
    both = F.flatten(F.transform(plain, lambda p: F.array(p, F.coalesce(F.try_element_at(F.filter(F.split(p, "::|[.#]"), lambda x: x != ""), F.lit(-1)), F.lit("")))))
    return F.array_distinct(F.filter(both, lambda p: p.rlike(r"^[A-Za-z_$][\w$.:#-]*$") & (F.length(p) >= 2)))


def fts_terms(text: Column) -> Column:
    """Telling words of a query for full-text search."""
    return _telling(F.flatten(F.transform(F.split(text, "[^A-Za-z0-9_]+"), split_identifiers)))


def family_terms(terms: Column) -> Column:
    """The first terms that can name a family of files."""
    broad = F.array(*map(F.lit, [*BROAD_NAMES, *STOP_WORDS]))
    return F.slice(F.filter(terms, lambda t: (F.length(t) >= 4) & ~F.array_contains(broad, t)), 1, MOST_FAMILIES)


def fts_query(terms: Column) -> Column:
    """Terms in quotes, any of which may match; the first MOST_FTS_TERMS."""
    return F.array_join(F.transform(F.slice(F.array_distinct(terms), 1, MOST_FTS_TERMS), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def path_matches(path: Column, wanted: Column) -> Column:
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted))


def language_of(path: Column) -> Column:
    return F.when(path.rlike(r"\.[cm]?tsx?$"), "typescript").when(path.rlike(r"\.[cm]?jsx?$"), "javascript").otherwise("text")


def signature_key(signature: Column) -> Column:
    """A signature without leading keywords, spaces around marks, and case."""
    out = F.regexp_replace(F.trim(F.regexp_replace(signature, r"\s+", " ")), r"^(export )?(default )?(async )?", "")
    for mark in (":", ",", r"\(", r"\)"):
        out = F.regexp_replace(out, rf"\s*{mark}\s*", mark.replace("\\", ""))
    return F.lower(out)


def name_depth(qualified: Column) -> Column:
    """How many scopes a name stands in."""
    return (F.size(F.split(qualified, "::|[:.#]")) - 1).cast("bigint")


def name_tail(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, "::|[:.#]"), -1)


def enclosing_type(qualified: Column) -> Column:
    return F.try_element_at(F.split(qualified, "::|[:.#]"), F.lit(-2))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """Whitespace words, at least one."""
    return F.greatest(F.lit(1), F.size(word_list(text))).cast("bigint")


def char_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def first_lines(text: Column, n: int) -> Column:
    """The first n lines, with a note of how many were left out."""
    lines = F.split(text, "\r?\n")
    note = F.concat(F.lit("\n... truncated "), (F.size(lines) - n).cast("string"), F.lit(" lines"))
    return F.when(F.size(lines) <= n, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), note))


def first_words(text: Column, n: Column | int) -> Column:
    """At most n words; a note where words were left out."""
    found, n = word_list(text), F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(found) <= n, text).otherwise(F.concat(F.array_join(F.slice(found, F.lit(1), n.cast("int")), " "), F.lit(" ... [compressed]")))


def content_type(text: Column) -> Column:
    """json if it parses as an object or array, code if its beginning has code's keywords, else text."""
    head = F.ltrim(F.substring(text, 1, 300))
    is_json = head.rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull()
    return F.when(is_json, "json").when(head.rlike(r"\b(function|class|const|import|export|interface|return)\b.*[({;=]"), "code").otherwise("text")


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def hash32(text: Column) -> Column:
    """The first four bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def rolling_hash31(text: Column) -> Column:
    """hash * 31 + code of every character, as a 32-bit number, in hexadecimal."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.hex(total))


# What changes from run to run, masked once a pattern.
DYNAMIC = [
    r"(?i)/[A-Za-z]:\\",
    r"(?i)/home/\w+",
    r"(?i)/Users/\w+",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"(?i)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b",
    r"(?i)indexed_at",
    r"(?i)session[_:]\s*\w+",
    r"\b\d+\.\d+\.\d+\b",
]


def masked(text: Column) -> Column:
    """The first match of each DYNAMIC pattern as [DYNAMIC]."""
    for pattern in DYNAMIC:
        # anchored at the start, so that only the first match is replaced
        flag, rest = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
        text = F.regexp_replace(text, f"{flag}^(.*?)(?:{rest})", "$1[DYNAMIC]")
    return text


# Names of properties that change from run to run, and the share of prompts that a cache can serve at most.
DYNAMIC_LABELS = ["file_path", "file", "project", "cwd", "working_directory", "indexed_at", "session", "version", "timestamp"]
BEST_HIT_RATE = 0.95


def dynamic_patterns(text: Column) -> Column:
    """How many of the DYNAMIC patterns a text holds, each looked for in what masking those before it left."""
    total = F.lit(0)
    for pattern in DYNAMIC:
        total = total + text.rlike(pattern).cast("int")
    return total


def is_dynamic_label(name: Column) -> Column:
    return F.lower(name).isin(DYNAMIC_LABELS)


def cache_hit_rate(dynamic_fields: Column, tools: Column) -> Column:
    """Expected hits of a prompt cache: fewer, the more fields of the tools change."""
    rate = F.least(F.lit(BEST_HIT_RATE), 1 - dynamic_fields / F.greatest(F.lit(1), tools * 3))
    return F.when(dynamic_fields > 0, F.greatest(F.lit(0.0), rate)).otherwise(BEST_HIT_RATE)


# Names whose values are secrets.
_SECRET = r"api[_-]?key|access[_-]?token|secret|password|passwd|authorization|token|credential"
LONGEST_LOG = 8192


def redacted(text: Column) -> Column:
    """Bearer tokens and values of secret names replaced; long texts cut."""
    text = F.regexp_replace(text, r"(?i)\b(Bearer\s+)[A-Za-z0-9._-]+", "$1[REDACTED]")
    text = F.regexp_replace(text, rf"""(?i)({_SECRET})\s*[:=]\s*[^\s,;`"'()\[\]{{}}]{{4,}}""", "$1=[REDACTED]")
    return F.when(F.length(text) <= LONGEST_LOG, text).otherwise(F.concat(F.substring(text, 1, LONGEST_LOG), F.lit("..."), (F.length(text) - LONGEST_LOG).cast("string")))


# Endings of files that a log mentions, and what may stand around a mention.
FILE_ENDINGS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "json", "md", "py", "rs", "go", "java", "kt", "c", "cc", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "yaml", "yml", "toml"]
_BEFORE, _AFTER = r"""(?:^|[\s"'`(])""", r"""(?:$|[\s"'`):,])"""


def mentioned_files(text: Column) -> Column:
    """Distinct names of source and document files that stand alone, between spaces, quotes or brackets; sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{_BEFORE}([\w./-]+\.(?:{'|'.join(FILE_ENDINGS)})){_AFTER}"), 1)))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains anywhere."""
    return sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0)).cast("bigint")
