"""Pairs that are settled in tiles: right, and without a call for each tile."""

import random

import numpy as np

from docweave.llm.near import confirmed_in_tiles


def test_tiles_are_read_as_a_stream(spark):
    draw = random.Random(5)
    sets = {-3 + i: np.array(sorted(draw.sample(range(12), draw.randint(1, 12))), np.uint64) for i in range(40)}
    pairs = sorted({tuple(sorted(draw.sample(sorted(sets), 2))) for _ in range(300)})
    held = spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in sets.items()], "doc_id long, hashes binary")
    asked = spark.createDataFrame(pairs, "a long, b long")
    want = []
    for a, b in pairs:
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if 100 * len(x & y) >= 60 * len(x | y):
            want.append((a, b))
    for blocks in (1, 7):
        got = confirmed_in_tiles(asked, held, blocks, 60)
        assert sorted(tuple(r) for r in got.collect()) == want and 0 < len(want) < len(pairs)
        assert "CoGroups" not in got._jdf.queryExecution().toString()
    assert confirmed_in_tiles(asked.limit(0), held, 1, 60).collect() == []
