"""Similarities of dense and sparse vectors as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def whole(a: Column) -> Column:
    """Whether a vector is there with all its components; `cosine` is 0 without."""
    return F.coalesce(F.forall(a, lambda x: x.isNotNull()), F.lit(False))


def best_cosines(k: int):
    """A function for tasks: of ids and vectors, those given targets with the k largest cosines of each, by matrix products.

    It takes ids of targets, targets, ids, vectors (arrays, None for one that is not `whole`), a least score or None and whether
    equal ids are left out; it returns places of targets, places of vectors and scores as `cosine` has them, the
    best by nine decimals and then the smallest id."""
    import numpy as np

    cells = 1 << 22  # scores held at once

    def by_size(rows):
        sizes = np.array([-1 if r is None else len(r) for r in rows])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            made = np.array([rows[i] for i in at], float) if n > 0 else np.zeros((len(at), 0))
            yield n, at, made, np.sqrt((made * made).sum(axis=1))

    def run(asked, targets, ids, vectors, least=None, others=False):
        asked, ids = np.asarray(asked), np.asarray(ids)
        out = [[np.zeros(0, int), np.zeros(0, int), np.zeros(0)]]
        of_vectors = list(by_size(vectors))
        with np.errstate(all="ignore"):
            for n, q_at, q, q_size in by_size(targets):
                for m, v_at, v, v_size in of_vectors:
                    step = max(1, cells // max(1, len(v_at)))
                    for b in range(0, len(q_at), step):
                        mine = q_at[b : b + step]
                        if n == m and n > 0:
                            size = q_size[b : b + step, None] * v_size[None, :]
                            score = np.where(size > 0, q[b : b + step] @ v.T / size, np.where(np.isnan(size), np.nan, 0.0))
                        else:
                            score = np.zeros((len(mine), len(v_at)))
                        order = np.where(np.isnan(score), np.inf, np.round(score, 9))
                        if others:
                            order[asked[mine][:, None] == ids[v_at][None, :]] = -np.inf
                        if least is not None:
                            order[~(np.isnan(score) | (score >= least))] = -np.inf
                        if len(v_at) > k:
                            kth = np.partition(order, len(v_at) - k, axis=1)[:, len(v_at) - k]
                            i, j = np.nonzero((order >= kth[:, None]) & (order > -np.inf))
                        else:
                            i, j = np.nonzero(order > -np.inf)
                        o = np.lexsort((ids[v_at[j]], -order[i, j], i))
                        i, j = i[o], j[o]
                        first = np.searchsorted(i, i)
                        keep = np.arange(len(i)) - first < k
                        i, j = i[keep], j[keep]
                        out.append([mine[i], v_at[j], score[i, j]])
        i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
        o = np.lexsort((ids[j], -np.where(np.isnan(score), np.inf, np.round(score, 9)), i))
        i, j, score = i[o], j[o], score[o]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], j[keep], score[keep]

    return run


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of distinct token lists."""
    size = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(0.0)


def conservative_similarity(a: Column, b: Column) -> Column:
    """Mean of coverage and precision of shared tokens, at most 1."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    parts = (F.coalesce(F.try_divide(shared, F.size(a)), F.lit(0.0)) + F.coalesce(F.try_divide(shared, F.size(b)), F.lit(0.0))) / 2
    return F.least(F.lit(1.0), parts)


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of maps from index to weight."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def sparse_cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(sparse_dot(a, a)) * F.sqrt(sparse_dot(b, b))
    return F.when(size > 0, sparse_dot(a, b) / size).otherwise(0.0)
