"""Tokens and contexts of op10, made for whole columns, against one text at a time."""

import numpy as np
import pyarrow as pa
from tests.llm.test_word_runs import TEXTS, hashes_of

from docweave.llm.lm import BUCKET_BITS, ODDS, Tokens, contexts
from docweave.llm.near import RegionHash


def one_by_one(hashes):
    before = [0, 0, 0, *map(int, hashes)]
    out = []
    for i in range(len(hashes)):
        three, two, one = before[i : i + 3]
        a, b, c, d, e = map(int, ODDS)
        mixed = [one * a, two * b, three * c, (one * d % 2**64) ^ ((two + 1) * e % 2**64)]
        mixed = [x % 2**64 for x in mixed]
        out.append([((x ^ (x >> 29)) * a % 2**64) >> (64 - BUCKET_BITS) for x in mixed])
    return out


def test_tokens_and_contexts():
    end = RegionHash()(b"\n", np.array([0]), np.array([1]))[0]
    want = [[*hashes_of(t), end] for t in TEXTS]
    for hashes, sizes in Tokens()(pa.array(TEXTS)):
        assert sizes.tolist() == [len(x) for x in want]
        assert hashes.tolist() == [h for x in want for h in x]
        assert contexts(hashes, sizes).T.tolist() == [c for x in want for c in one_by_one(x)]
