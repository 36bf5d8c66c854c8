"""Blocks of windows, which are counted one after the other, make up all windows."""

import numpy as np
import pyarrow as pa

from docweave.llm import phrases


class All:
    class value:  # noqa: N801
        @staticmethod
        def passes(prints):
            return np.ones(len(prints), bool)


def test_blocks_make_up_all_windows():
    ids = np.random.default_rng(5).integers(0, 40, 5000).astype(np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])

    def rows(*block):
        return [tuple(r.values()) for b in phrases._count_windows(2, All, *block)(iter([batch])) for r in b.to_pylist()]

    blocks = [rows(b) for b in range(phrases.WINDOW_BLOCKS)]
    assert len(blocks) > 1 and all(blocks)
    assert sorted(sum(blocks, [])) == sorted(rows())
