"""A training step of the language model: its derivatives, and the memory that it reuses."""

import os
import pickle
import subprocess
import sys

import numpy as np

from lodestar.llm import attention


def _model(rows: int = 64):
    rng = np.random.default_rng(2)
    model = attention.Attention(rng.random(3000) * 9, rng.random(3000) < 0.5)
    model.count(rng.integers(0, 9, (len(model.p["table"]), model.classes)))
    n = rng.integers(1, 120, rows)
    target = rng.integers(0, 3000, int(n.sum()))
    return model, list(model.windows(target, np.cumsum(n) - n, rng.permutation))


def test_step_follows_the_derivative_of_its_loss():
    model, (one, *_) = _model()
    for large in (False, True):
        for name in model.moments:
            copy = model.copy()
            copy.train(*one, 0.0)
            grad = 10 * copy.moments[name][0]
            norm = float((grad.astype(np.float64) ** 2).sum())
            losses = []
            for sign in (1, -1):
                moved = model.copy()
                moved.p[name] = moved.p[name] + np.float32(sign * 0.001 / norm) * grad
                moved._bound = lambda tables, to=moved, at=large: setattr(to, "large", at)
                losses.append(moved.train(*one, 0.0))
            assert abs(losses[0] - losses[1] - 0.002) < 0.0001, name


FRESH = """
import pickle, resource, sys
from lodestar.llm import common
model, steps = pickle.load(open(sys.argv[1], "rb"))
def run(_):
    for i, step in enumerate(steps[:8]):
        if i == 4:
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        model.train(*step, 0.001)
    yield resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before
print(*common.kept(run)(iter(())))
"""


def test_steps_of_a_fresh_worker_reuse_their_memory(tmp_path):
    model, steps = _model(5000)
    assert len(steps[7][0]) == attention.LEARN
    (tmp_path / "model").write_bytes(pickle.dumps((model, steps[:8])))
    said = subprocess.run([sys.executable, "-c", FRESH, str(tmp_path / "model")], capture_output=True, text=True, check=True, timeout=100, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert int(said.stdout) < 4 * 1000  # page faults of four steps
