import numpy as np
import pytest

from lumenfold.llm.metric_join import near_duplicates

COLUMNS = "vec_id long, label int, embedding array<double>, rep int, cell string"


def rows(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_odd_vectors(spark):
    """Any magnitude counts alike; null, zero and non-finite vectors and null labels link with nothing; other columns' names don't matter."""
    given = [
        (1, 1, [1e-200, 0.0]),
        (2, 1, [1e200, 0.0]),
        (3, 1, [1.0, 0.0]),
        (4, 1, [0.0, 1.0]),
        (5, 1, None),
        (6, None, [1.0, 0.0]),
        (7, 1, [float("nan"), 1.0]),
        (8, 2, [1.0, 0.0, 0.0]),
        (10, 1, [0.0, 0.0]),
        (11, 1, []),
        (12, 1, [None, 1.0]),
        (None, 1, [1.0, 0.0]),
    ]
    got = rows(near_duplicates(spark.createDataFrame([(*r, 5, "x") for r in given], COLUMNS)))
    assert {k: got[k] for k in (1, 2, 3)} == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)}
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 10, 11, 12)) and len(got) == 11


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.parametrize("block", [8, 16, 2048])
def test_brute_force(spark, block):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 6))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.12 for _ in range(10)] + [base])
    label = np.arange(len(x)) % 2
    df = spark.createDataFrame([(i, int(label[i]), v.tolist(), 0, "") for i, v in enumerate(x)], COLUMNS)
    got = rows(near_duplicates(df, block=block))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    while not np.array_equal(new := np.minimum(component, np.where(near, component[None, :], len(x)).min(axis=1)), component):
        component = new
    assert got == {i: (int(near[i].sum()), int(component[i]), component[i] == i) for i in range(len(x))}
