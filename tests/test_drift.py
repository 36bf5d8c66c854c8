"""Drift over seeded random pairs: the pairs themselves, the estimate against all pairs, and odd tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators.drift import paired, sampled_drift


def circle(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("rows, partners, block", [(25, 3, 4), (24, 4, 4), (9, 3, 8), (8, 8, 8), (3, 5, 8), (2, 1, 4), (1, 2, 4), (0, 2, 4)])
def test_partners_follow_in_the_circle(spark, rows, partners, block):
    df = spark.createDataFrame([(i, float(i)) for i in range(rows)], "vec_id long, x double")
    got = {r.vec_id: [p.vec_id for p in r.partners] for r in paired(df, partners, 7, block).collect()}
    order = circle(range(rows), 7)
    reach = min(partners, max(rows - 1, 0))
    assert got == {v: [order[(n + o) % rows] for o in range(1, reach + 1)] for n, v in enumerate(order)}


def tables(spark, vectors, cut):
    before = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    return before, before.withColumn("vector", F.slice("vector", 1, cut))


def test_estimate_against_all_pairs(spark):
    vectors = np.random.default_rng(2).normal(size=(600, 12)) + np.linspace(0, 1, 12)
    before, after = tables(spark, vectors, 5)

    def cosines(x):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return unit @ unit.T

    upper = np.triu_indices(600, 1)
    truth = np.abs(cosines(vectors) - cosines(vectors[:, :5]))[upper].mean()
    drifts = [sampled_drift(before, after, partners=8, seed=s).first() for s in range(3)]
    assert len({r.drift for r in drifts}) == 3
    for r in drifts:
        assert r.pairs == 4800 and 0 < r.error < 0.1 * truth
        assert abs(r.drift - truth) < 2 * r.error


def test_missing_and_zero_vectors_and_small_tables(spark):
    before, after = tables(spark, [[1, 2, 3], None, [0, 0, 0], [3, 1, 2]], 2)
    row = sampled_drift(before, after, partners=3).first()
    change = abs(11 / 14 - 5 / np.sqrt(50))
    assert row.pairs == 2 and row.drift == pytest.approx(change)
    for n in (0, 1):
        row = sampled_drift(before.where(F.col("vec_id") < n), after, partners=2).first()
        assert row.pairs == 0 and row.drift is None and row.error is None
    with pytest.raises(ValueError):
        sampled_drift(before, after, partners=0)
