"""EM and the choice of languages against loops."""
import itertools
import math
import random
from collections import Counter

import numpy as np

from quorum.llm import language_mix as L


def model(seed, n=3):
    rng = np.random.default_rng(seed)
    counts = np.zeros((n, L.BUCKETS))
    for i in range(n):
        counts[i, rng.integers(0, L.BUCKETS, 4000)] += rng.integers(1, 60, 4000)
    return L.Model([f"l{i}" for i in range(n)], counts)


def plain_fit(m, counts, langs):
    """Shares by EM and the log-likelihood, one n-gram and language at a time."""
    total = sum(counts.values()) / L.TOKENS
    shares = {k: 1 / len(langs) for k in langs}
    for _ in range(L.STEPS if len(langs) > 1 else 0):
        new = dict.fromkeys(langs, 0.0)
        for b, n in counts.items():
            whole = sum(shares[k] * float(m.prob[k, b]) for k in langs)
            for k in langs:
                new[k] += n / L.TOKENS * shares[k] * float(m.prob[k, b]) / whole
        shares = {k: v / total for k, v in new.items()}
    value = sum(n / L.TOKENS * math.log(sum(shares[k] * float(m.prob[k, b]) for k in langs)) for b, n in counts.items())
    return shares, value


def plain_mixture(m, text):
    at, n = L.grams(text)
    counts = dict(zip(at.tolist(), n.tolist()))
    total = sum(counts.values()) / L.TOKENS
    everyone, _ = plain_fit(m, counts, range(len(m.langs)))
    order = sorted(everyone, key=lambda k: -everyone[k])
    best = None
    for k in range(1, len(order) + 1):                     # nested sets, as long as the penalised likelihood grows
        shares, value = plain_fit(m, counts, order[:k])
        value -= L.PENALTY * (k - 1) * math.log(max(total, 2.0)) * 2
        if best and value <= best[0]:
            break
        best = value, shares
    return sorted(((m.langs[k], s) for k, s in best[1].items()), key=lambda x: (-x[1], x[0]))


def test_mixtures_by_loops():
    rng = random.Random(1)
    for seed in range(6):
        m = model(seed)
        text = " ".join("".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([3, 40, 120])))
        got, want = m.mixture(text), plain_mixture(m, text)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))


def test_grams_by_loops():
    for text in ("Ab c1d é", "x", "a-b " * 50):
        points = [ord(c) for c in " " + L._OTHER.sub(" ", text.lower()) + " "]
        want, mask = Counter(), (1 << 64) - 1
        for start, order in itertools.product(range(len(points)), range(1, L.MAX_ORDER + 1)):
            if start + order <= len(points):
                mixed = 0
                for p in points[start:start + order]:
                    mixed = (mixed * int(L._MIX) + p + 1) & mask
                want[(mixed * int(L._MIX) & mask) >> int(L._SHIFT)] += 1
        at, n = L.grams(text)
        assert dict(zip(at.tolist(), n.tolist())) == dict(want)
