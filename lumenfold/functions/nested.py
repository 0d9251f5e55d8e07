"""Walks through nested JSON of logs: secrets out, failures told. A small helper a value; Arrow carries the batches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.operators.compression import FAILURES

# How deep logs are walked, names whose values are secrets, the longest text, and states of an index behind its source.
REDACT_DEPTH, COLLECT_DEPTH, LONGEST = 8, 6, 8192
SENSITIVE = r"api[_-]?key|access[_-]?token|secret|password|passwd|authorization|bearer|credential"
IN_TEXT = r"api[_-]?key|access[_-]?token|secret|password|passwd|authorization|token|credential"
BEHIND, BEHIND_FILES = ("stale", "out-of-date", "pending"), ("stale", "non-fresh")
COMPRESSING = r"retrieve|compression|compressed"


def redacted(text: Column) -> Column:
    """A log's text without secrets: JSON is walked and written again, values under sensitive names are replaced, and so are
    bearer tokens and `name = value` forms in every text; what lies deeper than eight levels, and more than 8192
    characters of a text, is cut. Null stays null; what is no JSON is a text."""
    sensitive, in_text, depth_limit, longest = SENSITIVE, IN_TEXT, REDACT_DEPTH, LONGEST

    def run(texts: pd.Series) -> pd.Series:
        import json
        import re

        key = re.compile(f"(?:{sensitive})", re.I)
        bearer = re.compile(r"\b(Bearer\s+)[A-Za-z0-9._-]+", re.I | re.A)
        quoted = re.compile(rf"""(["'`]?)({in_text})\1\s*[:=]\s*(["'`])([^'"`]{{4,}})\3""", re.I)
        plain = re.compile(rf"""(["'`]?)({in_text})\1\s*[:=]\s*(?!['"`])([^\s,;`"'(){{}}\[\]]{{4,}})""", re.I)

        def walk(value, depth):
            if depth > depth_limit:
                return "[truncated]"
            if isinstance(value, str):
                return clean(value)
            if isinstance(value, list):
                return [walk(x, depth + 1) for x in value]
            if isinstance(value, dict):
                return {k: "[REDACTED]" if key.search(k) else walk(x, depth + 1) for k, x in value.items()}
            return value

        def clean(said):
            if said is None or said != said:
                return None
            if said.strip()[:1] in ("{", "["):
                try:
                    said = json.dumps(walk(json.loads(said), 0), separators=(",", ":"), ensure_ascii=False)
                except (ValueError, RecursionError):
                    pass
            said = plain.sub(r"\2=[REDACTED]", quoted.sub(r"\2=[REDACTED]", bearer.sub(r"\1[REDACTED]", said)))
            return said if len(said) <= longest else f"{said[:longest]}…<truncated {len(said) - longest} chars>"

        return texts.map(clean)

    return F.pandas_udf(run, "string")(text)


def failures(tool: Column, *parts: Column, review_tools: Sequence[str] = ("review", "audit"), search_tools: Sequence[str] = ("search", "explore"), retrieve_tools: Sequence[str] = ("retrieve",)) -> Column:
    """Types of failure that a log entry shows, sorted: its tool and texts, of which JSON is walked six levels deep, texts in
    it included. Complaints about findings count for review tools only, empty results for search tools only, and
    over-compression for retrieval or where compression is spoken of; a stale index is anyone's."""
    patterns, compressing, limit, behind, behind_files = dict(FAILURES), COMPRESSING, COLLECT_DEPTH, BEHIND, BEHIND_FILES
    reviews, searches, retrieves = set(review_tools), set(search_tools), set(retrieve_tools)

    def run(tools: pd.Series, *columns: pd.Series) -> pd.Series:
        import json
        import re

        found = {k: re.compile(p, re.A) for k, p in patterns.items()}
        about = re.compile(compressing)

        def collect(value, depth, out):
            if depth > limit:
                return
            out.append(value)
            if isinstance(value, str):
                if value.strip()[:1] in ("{", "["):
                    try:
                        inner = json.loads(value)
                    except (ValueError, RecursionError):
                        return
                    collect(inner, depth + 1, out)
            elif isinstance(value, (list, dict)):
                for x in value.values() if isinstance(value, dict) else value:
                    collect(x, depth + 1, out)

        def told(row):
            name, values = row[0], []
            for part in row:
                collect("" if part is None or part != part else part, 0, values)
            text = "\n".join(v for v in values if isinstance(v, str)).lower()
            records = [v for v in values if isinstance(v, dict)]
            empty = any(v.get(k) == [] for v in records for k in ("nodes", "documents"))
            late = any((isinstance(v.get("freshness"), dict) and v["freshness"].get("isFresh") is False) or v.get("freshnessState") in behind_files or v.get("state") in behind for v in records)
            hit = {k: bool(p.search(text)) for k, p in found.items()}
            flags = {
                "review-false-positive": name in reviews and hit["review-false-positive"],
                "compression-over-aggressive": (name in retrieves or bool(about.search(text))) and hit["compression-over-aggressive"],
                "empty-search": name in searches and (empty or hit["empty-search"]),
                "stale-index": late or hit["stale-index"],
            }
            return sorted(k for k, v in flags.items() if v)

        return pd.Series([told(row) for row in zip(tools, *columns, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<string>")(tool, *parts)
