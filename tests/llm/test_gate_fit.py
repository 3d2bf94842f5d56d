"""A round of training against Adam written out plainly, weight by weight."""

import numpy as np
import pytest

from veilscan.llm import lm_score as L


def plain(gate, ids, goal, valid, rate, seed):
    w = {k: x.copy() for k, x in gate.w.items()}
    m1, m2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order, steps = np.random.default_rng(seed).permutation(len(ids)), -(-len(ids) // L.BATCH)
    for step in range(1, steps + 1):
        at = order[(step - 1) * L.BATCH : step * L.BATCH]
        _, g = L.Gate(w).gradients(ids[at], np.repeat(goal[at], L.SCORED), valid[at])
        for k, x in g.items():
            rows, x = x if k == "e" else (slice(None), x)
            m1[k][rows] = 0.9 * m1[k][rows] + 0.1 * x
            m2[k][rows] = 0.98 * m2[k][rows] + 0.02 * x * x
            w[k][rows] -= rate * (1 - 0.9 * step / steps) * (m1[k][rows] / (1 - 0.9**step)) / (np.sqrt(m2[k][rows] / (1 - 0.98**step)) + 1e-4)
    return w


@pytest.mark.parametrize("size", [300, 70_000])
def test_fit_is_adam(size):
    rng = np.random.default_rng(2)
    n = 400 if size == 300 else 2400  # windows: the last batch is not full, or more tokens than 16 bits tell apart
    ids = rng.integers(0, size, (n, L.SPAN)) if size == 300 else np.arange(n * L.SPAN).reshape(n, L.SPAN) % size
    goal, valid = rng.integers(0, 5, n), rng.random((n, L.SCORED)) > 0.2
    gate = L.Gate.start(rng.integers(0, 50, (size, 5)))
    before = {k: x.copy() for k, x in gate.w.items()}
    got, want = gate.fit(ids, goal, valid, 0.02, 3).w, plain(gate, ids, goal, valid, 0.02, 3)
    assert all((gate.w[k] == before[k]).all() for k in before)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].shape == want[k].shape and np.allclose(got[k], want[k], atol=2e-3)
        assert not np.allclose(got[k], before[k], atol=1e-3)
