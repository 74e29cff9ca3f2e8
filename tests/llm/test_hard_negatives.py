"""Hard negatives against a plain version."""
import math
import random

import numpy as np
import pytest

from quorum.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block string, q int"


def plain(rows):
    seen = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        seen[i, label, q] = True
    found, out = list(seen), []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda s, i: (-s, i is None, i or 0)
    for a in found:
        if a[0] is None or a[0] % 100:
            continue
        same = sorted(((score(a[2], r[2]), r[0]) for r in found if r is not a and r[1] == a[1]), key=lambda x: order(*x))[:5]
        other = sorted(((score(a[2], r[2]), r[0]) for r in found if r[1] != a[1]), key=lambda x: order(*x))
        for p, positive in same:
            inside = [x for x in other if 30 * p <= 100 * x[0] <= 90 * p][:10]
            out += [(a[0], positive, n, i, p, s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hard_negatives.mine(df).collect()), key=str)


def table(n, width=12, seed=3, spread=0.3, labels=10):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(labels)]
    drawn = [rng.randrange(labels) for _ in range(n)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[label]], label) for i, label in enumerate(drawn)]


@pytest.mark.parametrize("block, chunk, depth", [(8192, 2048, 64), (64, 2, 1), (100, 1, 7)])
def test_plain(spark, monkeypatch, block, chunk, depth):
    rows = table(700)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "DEPTH", depth)
    assert run(spark, rows) == plain(rows)


def test_ties(spark):
    rows = [(i, [float(x) / 256 for x in (i % 3, (i // 3) % 2, 2)], i % 4) for i in range(320)]
    assert run(spark, rows) == plain(rows)


def test_defined_cases(spark):
    rows = table(230, labels=3)
    rows += [rows[100], rows[100], rows[5]]                                    # repeated rows are one row
    rows += [(None, rows[0][1], 1), (None, rows[1][1], 2), (None, None, None), (900, None, 1), (901, rows[3][1], None)]
    rows += [(902, [float("nan")] + rows[0][1][1:], 1), (903, [float("inf")] + rows[0][1][1:], 1), (904, [None] + rows[0][1][1:], 1)]
    rows += [(905, [], 1), (1000, [], 2), (906, rows[4][1][:5], 1), (1100, [0.0] * 12, 1), (1200, [-x for x in rows[0][1]], 1)]
    rows += [(-100, rows[7][1], 2), (-7, rows[8][1], 9)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1)]) == [] and run(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []


def test_large_components(spark):
    rows = [(i, [(i * 37 % 101 - 50) * 20_000.0, (i * 53 % 89) * 11_000.0], i % 2) for i in range(210)]
    assert run(spark, rows) == plain(rows)


def test_reading_stops(monkeypatch):
    """On rows with one outstanding dimension the threshold ends the reading early."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    q = rng.integers(-5, 6, (4000, 8))
    q[:, 0] = rng.integers(-200, 200, 4000)
    block = hard_negatives.Lists(pa.table({"id": pa.array(range(4000), pa.int64()), "tie": pa.array(range(4000), pa.int64()),
                                           "label": pa.array([1] * 4000, pa.int64()), "q": pa.array(q.tolist(), pa.list_(pa.int32()))}), 8)
    met = []
    flat = np.flatnonzero
    monkeypatch.setattr(hard_negatives.np, "flatnonzero", lambda x: met.append(len(y := flat(x))) or y)
    a = np.array([100, 0, 0, 0, 0, 0, 0, 1])
    (rows, scores), = block.best(a, np.ones(4000, bool), hard_negatives.ALL, 5)
    assert sum(met[1:]) < 1000
    assert scores.tolist() == sorted((q @ a).tolist(), reverse=True)[:5]
