"""Pairs of documents that share a list: each once, also in long lists, and compared in tiles instead of row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import near


@pytest.mark.parametrize("block", [3, 1024])
def test_pairs_in_lists(spark, monkeypatch, block):
    monkeypatch.setattr(near, "LIST_BLOCK", block)
    monkeypatch.setattr(near, "PAIRS_AT_ONCE", 7)
    draw = random.Random(3)
    base = near._stream(1, 200)
    documents = {}
    for rep in range(-4, 40):
        shared = np.array(draw.sample(base.tolist(), draw.randint(150, 200)), np.uint64)
        own = np.unique(np.concatenate([shared, near._stream(rep + 50, draw.choice([0, 10, 60]))]))
        values = near.Coordinates()(own)
        low = ((values & 255).reshape(-1, near.PER_LONG) << (np.arange(near.PER_LONG) * 8)).sum(axis=1)
        packed = [int(x) for x in [*low, *near.parities(own)]]
        documents[rep] = (rep // 2 * 2, len(own), packed, sorted(draw.sample(range(8), draw.randint(1, 5))))
    rows = [
        (k, rep, label, n, keys[:at], *packed)
        for rep, (label, n, packed, keys) in documents.items()
        for at, k in enumerate(keys)
    ]
    fields = ", ".join(f"{c} long" for c in near.SKETCH)
    listed = spark.createDataFrame(rows, f"key long, rep long, label long, n long, earlier array<long>, {fields}")
    listed = listed.join(listed.groupBy("key").agg(F.count("*").alias("size")), "key")

    a, b = listed.alias("a"), listed.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.label") != F.col("b.label"))
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * 80
    few = near.unlike("a", "b") * 180 <= (F.col("a.n") + F.col("b.n")) * 20
    close = sizes & few & (near.matching("a", "b") >= near.ALIKE)
    want = sorted({tuple(r) for r in a.join(b, apart & close).select("a.rep", "b.rep").collect()})
    met = {tuple(r) for r in a.join(b, apart).select("a.rep", "b.rep").collect()}
    assert 0 < len(want) < len(met)

    assert sorted(tuple(r) for r in near.pairs_in_lists(listed, 80).collect()) == want
    assert near.pairs_in_lists(listed.limit(0), 80).collect() == []


def test_lists_are_compared_without_a_join_of_rows(spark):
    """Row by row, a pair of one list cost about 30 microseconds of a task."""
    fields = ", ".join(f"{c} long" for c in near.SKETCH)
    listed = spark.createDataFrame([], f"key long, size long, rep long, label long, n long, earlier array<long>, {fields}")
    assert "Join" not in near.pairs_in_lists(listed, 80)._jdf.queryExecution().toString()
