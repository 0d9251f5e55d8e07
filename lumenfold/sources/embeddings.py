"""Embeddings from a service: texts go in batches through a function that calls it, responses come back as vectors.

The function is the caller's, and nothing here opens a connection; what is here is how a table's texts
reach it, how a failed call is tried again, and what its answers may look like."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a request, and how often a request is made at most.
BATCH, TRIES = 64, 2


def payload_vectors(payload: Column) -> Column:
    """The vectors (array of arrays) of a response: an array of them, {"embeddings": [..]}, {"data": [{"embedding"}]},
    {"output": {"embeddings": [..]}} or {"embedding"} alone; null for anything else."""
    value = F.try_parse_json(payload)
    at = lambda path, kind: F.try_variant_get(value, path, kind)
    rows, one = "array<array<double>>", at("$.embedding", "array<double>")
    data = F.transform(at("$.data", "array<struct<embedding: array<double>>>"), lambda x: x["embedding"])
    found = [at("$", rows), at("$.embeddings", rows), data, at("$.output.embeddings", rows), F.when(one.isNotNull(), F.array(one))]
    return F.coalesce(*found)


def is_sound(vectors: Column, count: Column | int) -> Column:
    """As many vectors as texts, all of one dimension, and no component missing."""
    first = F.size(F.try_element_at(vectors, F.lit(1)))
    whole = F.forall(vectors, lambda v: v.isNotNull() & (F.size(v) == first) & F.forall(v, lambda x: x.isNotNull()))
    return F.coalesce((F.size(vectors) == count) & whole, F.lit(False))


def embedded(texts: DataFrame, key: str, text: str, call: Callable[[list[str]], list[list[float]]], batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """key and embedding of every text, `batch` of them a call; a call that fails is made again, `tries` times in all.

    A null text has no embedding. An answer with another number of vectors, or of different dimensions, is a failure."""

    def one(part: list[str]) -> list[list[float]]:
        for left in range(tries - 1, -1, -1):
            try:
                found = call(part)
                if len(found) != len(part) or len({len(v) for v in found}) > 1:
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts, or of different dimensions")
                return found
            except Exception:
                if not left:
                    raise
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = [None] * len(frame)
            some = [i for i, x in enumerate(frame[text]) if x is not None]
            for i in range(0, len(some), batch):
                part = some[i : i + batch]
                for j, vector in zip(part, one([frame[text].iloc[j] for j in part]), strict=True):
                    out[j] = [float(x) for x in vector]
            yield pd.DataFrame({key: frame[key], "embedding": out})

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<double>")
