"""The lower bound with all draws against a brute force of the same uniforms, and against NumPy's sampler."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import bounds as B


def uniform(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32


def emd(x, y, o):
    order = np.argsort(o, kind="stable")
    x, y, o = x[order] / x.sum(), y[order] / y.sum(), np.array(o, float)[order]
    return (np.abs(np.cumsum(x) - np.cumsum(y))[:-1] * np.diff(o)).sum() / (o[-1] - o[0])


ROWS = [(3, [0.5, 0.25, 0.25], [1.0, 2.0, 3.0]), (17, [0.1, 0.0, 0.2, 0.7], [1.0, 2.0, 2.0, 4.0]), (5, [1e-9, 1.0], [1.0, 2.0]), (8, [0.0, 0.0], [1.0, 2.0])]
SCHEMA = "row_idx long, gold array<double>, ordinal array<double>"


def plain(key, gold, ordinal, n, repeats):
    shift, cdf, out = uniform(f"42:{key}"), np.cumsum(gold) / np.sum(gold), []
    for b in range(1, repeats + 1):
        counts = []
        for side in (1, 2):
            turned = [(uniform(f"42:{b}:{side}:{i}") + shift) % 1 for i in range(1, n + 1)]
            counts.append(np.bincount([min(int((cdf <= x).sum()), len(gold) - 1) for x in turned], minlength=len(gold)).astype(float))
        out.append(emd(*counts, ordinal))
    return np.mean(out)


def test_against_written_out_draws(spark):
    got = {r.row_idx: r.wd_lower_bootstrap_mean for r in B.wd_lower_bootstrap(spark.createDataFrame(ROWS, SCHEMA), 40, 12).collect()}
    assert got[8] is None and len(got) == 4
    for key, gold, ordinal in ROWS[:3]:
        assert got[key] == pytest.approx(plain(key, gold, ordinal, 40, 12), abs=1e-9)


def test_same_law_as_a_multinomial_sampler(spark):
    got = {r.row_idx: r.wd_lower_bootstrap_mean for r in B.wd_lower_bootstrap(spark.createDataFrame(ROWS[:2], SCHEMA)).collect()}
    rng = np.random.default_rng(1)
    for key, gold, ordinal in ROWS[:2]:
        x, y = (rng.multinomial(500, np.array(gold) / sum(gold), 4000).astype(float) for _ in range(2))
        means = [emd(a, b, ordinal) for a, b in zip(x, y)]
        assert abs(got[key] - np.mean(means)) < 5 * np.std(means) / np.sqrt(500)


def test_count_below(spark):
    df = spark.createDataFrame([([0.1, 0.1, 0.4, 0.9], x) for x in (0.0, 0.1, 0.2, 0.4, 0.95)], "u array<double>, x double")
    assert [r[0] for r in df.select(B.count_below(F.col("u"), F.col("x"), 4)).collect()] == [0, 0, 2, 2, 4]


def test_counts_of_all_arrays_at_once():
    """Every count is what a search in that array alone gives, on ties and at the ends, too."""
    rng = np.random.default_rng(3)
    u = np.sort(rng.integers(0, 400, (30, 90)) / 400, axis=1)
    x = np.concatenate([[0.0, 1.0, 2.0, u[4, 7], u[9, 89]], rng.random(40)])
    held = B.Uniforms(u)
    assert len(held.merged) > held.step  # more than one mark
    assert (held.below(x) == [[np.searchsorted(a, y) for a in u] for y in x]).all()


ODD = [(1, [0.5, 0.25, 0.25], [1.0, 2.0, -1.0]), (1, [0.2, 0.3, 0.5], [1.0, 2.0, -1.0]), (2, [0.0, 0.0, 1.0], [1.0, 2.0, -1.0]),
       (3, [0.5, 0.5], [-2.0, -1.0]), (4, [0.5, 0.5], [2.0, 2.0]), (5, None, None), (6, [0.5, None], [1.0, 2.0]), (None, [0.5, 0.5], [1.0, 3.0]),
       (7, [0.0, 0.0], [1.0, 2.0])]


def test_samples_are_measured_as_emd_does(spark):
    """Both samplers, a repeat at a time through the column expression ``metrics.emd``."""
    from quorum.functions.metrics import emd as column
    df = spark.createDataFrame(ODD, SCHEMA)
    n, repeats = 7, 9
    draws = {r.row_idx: r.wd_lower for r in B.wd_lower_draws(df, n, repeats).collect()}
    whole = {r.row_idx: r.wd_lower_bootstrap_mean for r in B.wd_lower_bootstrap(df, n, repeats).collect()}
    samples = []
    for key, gold, ordinal in ODD:
        for b in range(1, repeats + 1):
            if gold is None or None in gold:
                continue
            cdf = np.cumsum(gold) / np.sum(gold) if sum(gold) else np.zeros(0)
            begin, shift = "42" if key is None else f"42:{key}", uniform("42" if key is None else f"42:{key}")
            pick = lambda x: min(int((cdf <= x).sum()), len(gold) - 1)
            plainly = [[pick(uniform(f"{begin}:{b}:{side}:{i}")) for i in range(1, n + 1)] for side in (1, 2)]
            turned = [[pick((uniform(f"42:{b}:{side}:{i}") + shift) % 1) for i in range(1, n + 1)] for side in (1, 2)]
            for kind, (p, q) in (("draws", plainly), ("whole", turned)):
                if kind == "draws" or sum(gold):
                    samples.append((kind, key, *[[float(x.count(k)) for k in range(len(gold))] for x in (p, q)], ordinal))
    rows = spark.createDataFrame(samples, "kind string, k long, p array<double>, q array<double>, o array<double>")
    want = {(r.kind, r.k): r.m for r in rows.groupBy("kind", "k").agg(F.avg(column("p", "q", "o")).alias("m")).collect()}
    for kind, got in (("draws", draws), ("whole", whole)):
        assert set(got) == {1, 2, 3, 4, 5, 6, 7, None}
        for key, value in got.items():
            if kind == "draws" and key == 6:  # a null share: no distribution function, every draw the first option
                assert value == 0.0
            elif want.get((kind, key)) is None:
                assert value is None
            else:
                assert value == pytest.approx(want[kind, key], abs=1e-12)
