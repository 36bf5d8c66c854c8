"""Words of many texts at once, found and hashed in the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docweave.llm.near import LONG_WORD, RegionHash

# ASCII white space parts words.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Bytes that are hashed at a time; a slice ends at white space or goes on.
SLICE = 1 << 18


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins and the last one ends; nulls are empty."""
    held = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2] or b"", np.uint8), offsets


def runs(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of parts, given by where each begins and the last one ends, with about as many bytes as a slice."""
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
        yield at, min(end, len(bounds) - 1)
        at = end


class WordHashes:
    """Hashes of the words of one byte string, as `words` and `RegionHash` give them; A-Z are folded if asked."""

    def __init__(self, fold: bool):
        self.fold, self.plain, self.region = fold, RegionHash(), RegionHash()
        if fold:
            self.region.letters = self.region.letters[np.frombuffer(bytes(range(256)).lower(), np.uint8)]

    def _long(self, word: bytes) -> np.uint64:
        digest = b"\0" + hashlib.blake2b(word.lower() if self.fold else word).digest()
        return self.plain(digest, np.array([0]), np.array([len(digest)]))[0]

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the words in order; a word also ends at each of the bounds, which ascend."""
        hashes, places, at = [], [], 0
        while at < len(data):
            end = self._cut(data, at)
            own, inner = data[at:end], np.unique(bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end)]) - at
            space = SPACES[own]
            first = ~space
            last = first.copy()
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            first[inner], last[inner - 1] = ~space[inner], ~space[inner - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            found = self.region(own, starts, ends)
            for i in np.flatnonzero(ends - starts > LONG_WORD):
                found[i] = self._long(own[starts[i] : ends[i]].tobytes())
            hashes.append(found)
            places.append(starts + at)
            at = end
        return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(places or [np.zeros(0, np.int64)])

    @staticmethod
    def _cut(data: np.ndarray, at: int) -> int:
        end = at + SLICE
        while end < len(data):
            space = SPACES[data[end : end + LONG_WORD]]
            if space.any():
                return end + int(space.argmax())
            end += LONG_WORD
        return len(data)
