"""Pieces of DuckDB SQL that several queries' oracles share."""

from __future__ import annotations


def normalized(x: str) -> str:
    camel = rf"regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    acronym = rf"regexp_replace({camel}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return rf"""lower(regexp_replace({acronym}, '[_\-./:(){{}}\[\],;<>+=!?''"`|\\]+', ' ', 'g'))"""


def words(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_split_to_array({normalized(x)}, '\s+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\d+'))))"


def stems(x: str) -> str:
    """All stems of a list of tokens."""
    parts = [f"CASE WHEN suffix(t, '{e}') AND length(t) > {len(e) + 2} THEN left(t, length(t) - {len(e)}) END" for e in ("ation", "ing", "ed", "es", "s")]
    parts.append("CASE WHEN suffix(t, 'ation') AND length(t) > 7 THEN left(t, length(t) - 5) || 'e' END")
    parts.append("CASE WHEN suffix(t, 'ing') AND length(t) > 5 THEN CASE WHEN substr(t, length(t) - 3, 1) = substr(t, length(t) - 4, 1) THEN left(t, length(t) - 4) ELSE left(t, length(t) - 3) END END")
    return f"list_filter(flatten(list_transform({x}, lambda t: [{', '.join(parts)}])), lambda s: s IS NOT NULL AND length(s) >= 2)"


def tokens(x: str) -> str:
    base = words(x)
    return f"list_sort(list_distinct(list_concat({base}, {stems(base)})))"


def word_list(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def token_estimate(x: str) -> str:
    return f"greatest(1, len({word_list(x)}))"


def joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


def is_symbol(x: str) -> str:
    return f"(regexp_full_match(trim({x}), '[A-Za-z_$][A-Za-z0-9_$]*') AND (regexp_matches(trim({x}), '[a-z0-9][A-Z]') OR regexp_matches(trim({x}), '^[A-Z]') OR contains({x}, '_')))"


def is_path(x: str) -> str:
    return rf"(regexp_matches({x}, '[\\/]') OR contains({x}, '::') OR regexp_matches({x}, '\.[A-Za-z0-9]{{1,8}}\b'))"


def reference_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def in_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"
