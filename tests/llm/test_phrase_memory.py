"""What a task of phrase mining holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docweave.llm import phrases


class All:
    value = property(lambda self: self)

    def passes(self, prints):
        return np.ones(len(prints), bool)


def peak_of(rows) -> float:
    """MB that Python and NumPy held at the most while the rows were made."""
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_counting():
    ids = np.random.default_rng(1).integers(1, 1 << 60, 3 << 18).astype(np.uint64)
    rows = pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])
    phrases.powers(phrases.BASE), phrases.powers(phrases.BASE_INVERSE)
    assert peak_of(phrases._count_windows(2, All())(iter([rows]))) < 50


def test_memory_of_cutting():
    text = " ".join(f"w{i % 5000}" for i in range(2000))
    rows = pa.RecordBatch.from_pydict({"lang": ["en"] * 500, "text": [text] * 500})
    assert peak_of(phrases._texts_to_ids(0)(iter([rows]))) < 35
