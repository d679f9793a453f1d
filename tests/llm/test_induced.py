import random

import numpy as np
import pytest

from tapeloom.llm.induced import range_minima, suffixes


def common(a, b, cap):
    n = 0
    while n < cap and n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("base", [1 << 20, 3])
@pytest.mark.parametrize("budget", [1 << 20, 64])
@pytest.mark.parametrize("kind", ["few", "text", "runs", "copies"])
def test_order_and_prefixes(tmp_path, base, budget, kind):
    rnd = random.Random(hash((base, kind)) % 1000)
    for _ in range(12):
        n = rnd.randrange(1, 300)
        if kind == "few":
            t = [rnd.randrange(3) for _ in range(n)]
        elif kind == "text":
            t = [rnd.randrange(30) for _ in range(n)]
        elif kind == "runs":
            t = [x for _ in range(8) for x in [rnd.randrange(3)] * rnd.randrange(40)]
        else:
            part = [rnd.randrange(1, 20) for _ in range(60)]
            t = [*part, 0, *part[5:50], 0, *part, 7, *part[:30]]
        t = [x + 1 for x in t]
        text, cap = np.array([*t, 0], np.uint16), 20
        got, before = [], None
        for positions, prefix in suffixes(text, cap, base, str(tmp_path), budget):
            for p, c in zip(positions.tolist(), prefix.tolist(), strict=True):
                if before is not None and p != len(text) - 1:
                    assert c == common(t[before:] + [0], t[p:] + [0], cap), (before, p)
                got.append(p)
                before = p
        assert sorted(got) == list(range(len(text)))
        keys = [tuple(([*t, 0] + [-1] * cap)[p : p + cap]) for p in got]
        assert all(x >= y or common(x, y, cap) >= cap for x, y in zip(keys, keys[1:], strict=False))


def test_range_minima():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500).astype(np.uint8)
    a = rng.integers(0, 500, 900)
    b = np.minimum(499, a + rng.integers(0, 500, 900))
    assert range_minima(v, a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]
