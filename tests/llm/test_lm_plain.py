"""The network's scores against loops over tokens and ids."""

import numpy as np
import pytest

from lumenfold.llm import lm_score as M


def probability(network, ids, place, wanted):
    """P(wanted at place | both sides), digit by digit, from the parameters alone."""
    hidden = network.p["bias"].astype(float).copy()
    for o in range(2 * M.SIDE + 1):
        if o != M.SIDE:
            hidden += network.p["embedding"][ids[place + o - M.SIDE]].astype(float) * network.p["offset"][o]
    hidden, base, out = np.tanh(hidden), network.base, 1.0
    for k in range(M.LEVELS):
        prefix, digit = divmod(wanted // base ** (M.LEVELS - 1 - k), base)
        z = network.p[f"out{k}_bias"][prefix] + network.p[f"out{k}"][prefix] @ hidden
        z = np.exp(z - z.max())
        out *= z[digit] / z.sum()
    return out


@pytest.fixture
def network():
    rng = np.random.default_rng(4)
    made = M.Network(base=4)
    for k, v in made.p.items():
        made.p[k] = rng.normal(0, 0.7, v.shape).astype(np.float32)
    made.p["embedding"][-1] = 0
    made.p["offset"][M.SIDE] = 0
    return made


def test_scores_are_sums_of_a_plain_loop(network):
    rng = np.random.default_rng(5)
    vocabulary = M.Vocabulary(np.arange(40, dtype=np.uint64), base=4)
    counts = np.array([7, 0, 1, 12])
    ids, at = vocabulary.padded(rng.integers(0, vocabulary.PAD, counts.sum()), counts)
    got = network.log_probabilities(ids, at)
    want = [np.log(probability(network, ids, p, ids[p])) for p in at.tolist()]
    assert np.allclose(got, want, atol=1e-4)
    ends = np.cumsum(counts)
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        assert abs(got[end - n : end].sum() - sum(want[end - n : end])) < 1e-3


def test_probabilities_of_all_ids_are_one(network):
    vocabulary = M.Vocabulary(np.arange(40, dtype=np.uint64), base=4)
    ids, at = vocabulary.padded(np.array([3, 9, 27]), np.array([3]))
    assert abs(sum(probability(network, ids, int(at[1]), x) for x in range(vocabulary.PAD)) - 1) < 1e-5


def test_a_token_never_sees_itself_or_another_document(network):
    vocabulary = M.Vocabulary(np.arange(40, dtype=np.uint64), base=4)
    one, at = vocabulary.padded(np.array([3, 9, 27, 5, 6]), np.array([3, 2]))
    other, _ = vocabulary.padded(np.array([3, 9, 27, 50, 60]), np.array([3, 2]))
    assert np.allclose(network.log_probabilities(one, at)[:3], network.log_probabilities(other, at)[:3])
    for wanted in (9, 30):
        changed = one.copy()
        changed[at[1]] = wanted
        assert abs(network.log_probabilities(changed, at)[1] - np.log(probability(network, one, int(at[1]), wanted))) < 1e-4
