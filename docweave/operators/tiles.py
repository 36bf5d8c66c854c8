"""Square tiles of a document's similarity matrix, worked through one after another inside tasks.

Rows are sentences with the weights of their words (doc_id, pos, tok, w: two arrays, the weights scaled to length 1) or with
dense vectors (doc_id, pos, vector).  They are sent to the tiles their sentence belongs to and sorted by tile; a task then reads its tiles as a stream and holds one at
a time, so many small documents cost no per-group overhead and a large one spreads over as many tasks as it has tiles.
doc_id is of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences per side of a tile.
TILE = 512
# Words that are multiplied at once, so that a tile of many different words is no large matrix.
WORDS = 4096
KEYS = ["doc_id", "ti", "tj"]
SPARSE, DENSE = ["tok", "w"], ["vector"]


def _place(role: Column, block: Column, other: Column) -> Column:
    """Tile of a row that is on the row side (0) or on the column side (1)."""
    return F.struct(
        role.alias("role"),
        F.when(role == 0, block).otherwise(other).alias("ti"),
        F.when(role == 0, other).otherwise(block).alias("tj"),
    )


def all_pairs_places(pos: Column, n: Column) -> Column:
    """Tiles (i <= j) that cover each pair of sentences once; a diagonal tile gets its rows once."""
    block, last = F.floor(pos / TILE).cast("int"), F.floor((n - 1) / TILE).cast("int")
    as_row = F.transform(F.sequence(block, last), lambda j: _place(F.lit(0), block, j))
    as_col = F.transform(
        F.filter(F.sequence(F.lit(0), block), lambda i: i < block), lambda i: _place(F.lit(1), block, i)
    )
    return F.concat(as_row, as_col)


def two_sided_places(pos: Column, n: Column, role: Column) -> Column:
    """Tiles that pair every role-0 sentence with every role-1 sentence."""
    block, last = F.floor(pos / TILE).cast("int"), F.floor((n - 1) / TILE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda o: _place(role, block, o))


class Words(NamedTuple):
    """Weights of numbered words, scaled to length 1 a sentence; ``row`` numbers the sentences."""

    row: np.ndarray
    word: np.ndarray
    w: np.ndarray


class Side(NamedTuple):
    """Sentences on one side of a tile: positions, numbers of copies and vectors of length 1 (dense, or words)."""

    pos: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray | Words


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row, or one that is not finite, is zero and so unlike everything."""
    vectors[~np.isfinite(vectors).all(axis=1)] = 0.0
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=vectors, where=length > 0)


def dense_vectors(held: np.ndarray, width: int = 0) -> np.ndarray:
    """A missing vector counts as zero, a shorter one as filled up with zeros."""
    width = max(width, 1, max((len(v) for v in held if v is not None), default=0))
    vectors = np.zeros((len(held), width))
    for at, v in enumerate(held):
        if v is not None:
            vectors[at, : len(v)] = v
    return _unit(vectors)


def similarities(row: Side, col: Side) -> np.ndarray:
    """The similarity of each sentence of one side to each of the other."""
    if not isinstance(row.vectors, Words):
        return row.vectors @ col.vectors.T
    sims = np.zeros((len(row.pos), len(col.pos)))
    top = min(side.vectors.word.max(initial=-1) for side in (row, col))
    for start in range(0, int(top) + 1, WORDS):
        stop = min(start + WORDS, int(top) + 1)
        left = _block(row, start, stop)
        sims += left @ (left if row is col else _block(col, start, stop)).T
    return sims


def _block(side: Side, start: int, stop: int) -> np.ndarray:
    """The weights of the words start:stop as a matrix."""
    row, word, w = side.vectors
    inside = (word >= start) & (word < stop)
    out = np.zeros((len(side.pos), stop - start))
    out[row[inside], word[inside] - start] = w[inside]
    return out


def _two_sides(part: dict[str, np.ndarray], diagonal: bool) -> tuple[Side, Side]:
    """Both sides of a tile; on the diagonal they are the same."""
    left = part["role"] == 0
    order = [np.flatnonzero(side)[np.argsort(part["pos"][side], kind="stable")] for side in ((left,) if diagonal else (left, ~left))]
    if "vector" in part:
        width = max((len(v) for v in part["vector"] if v is not None), default=0)
        made = [dense_vectors(part["vector"][at], width) for at in order]
    else:
        held = [(part["tok"][at], part["w"][at]) for at in order]
        _, word = np.unique(np.concatenate([t for tok, _ in held for t in tok] or [[]]), return_inverse=True)
        made, used = [], 0
        for tok, w in held:
            sizes = np.fromiter(map(len, tok), int, len(tok))
            own = word[used : used + sizes.sum()]
            made.append(Words(np.repeat(np.arange(len(tok)), sizes), own, np.concatenate([*w, []])))
            used += sizes.sum()
    sides = [Side(part["pos"][at], part["copies"][at], vectors) for at, vectors in zip(order, made)]
    return sides[0], sides[-1]


def spanning_pairs(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of pairs that connect the same rows and columns as all pairs of a tile that are close; a forest, so
    fewer of them than rows and columns together."""
    open_row, open_col = close.any(axis=1), np.ones(close.shape[1], bool)
    found = []
    for start in np.flatnonzero(open_row):
        if not open_row[start]:
            continue
        open_row[start] = False
        waiting = [(True, start)]
        while waiting:
            is_row, at = waiting.pop()
            new = np.flatnonzero(close[at] & open_col if is_row else close[:, at] & open_row)
            (open_col if is_row else open_row)[new] = False
            found += [(at, x) if is_row else (x, at) for x in new]
            waiting += [(not is_row, x) for x in new]
    pairs = np.array(found, int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def lowest_linked(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links the lowest row that it is connected with, itself included."""
    lowest, waiting = np.arange(len(close)), close.any(axis=1)
    for start in np.flatnonzero(waiting):
        if waiting[start]:
            waiting[start] = False
            reached = np.array([start])
            while len(reached):
                reached = np.flatnonzero(close[reached].any(axis=0) & waiting)
                waiting[reached] = False
                lowest[reached] = start
    return lowest


def _tiles(batches: Iterator[pd.DataFrame], held: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Cut a sorted stream of batches where the tile changes."""
    rest = None
    for batch in batches:
        cols = {c: batch[c].to_numpy() for c in KEYS + held}
        if rest is not None:
            cols = {c: np.concatenate([rest[c], cols[c]]) for c in cols}
        change = np.zeros(len(cols["pos"]), bool)
        for c in KEYS:
            change[1:] |= cols[c][1:] != cols[c][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        for a, b in zip(starts[:-1], starts[1:]):
            yield tuple(cols[k][a] for k in KEYS), {c: cols[c][a:b] for c in held}
        rest = {c: v[starts[-1] :] for c, v in cols.items()}
    if rest is not None and len(rest["pos"]):
        yield tuple(rest[k][0] for k in KEYS), {c: rest[c] for c in held}


def map_tiles(rows: DataFrame, places: Column, symmetric: bool, reduce_tile: Callable, schema: str) -> DataFrame:
    """Run ``reduce_tile(row, col, sims) -> dict of columns`` on every tile that has both sides; doc_id comes before them.

    ``rows`` holds (doc_id, pos, copies, tok, w) or (doc_id, pos, copies, vector) and whatever ``places`` needs.
    """
    values = DENSE if "vector" in rows.columns else SPARSE
    held = ["role", "pos", *values, "copies"]
    numbered = rows.withColumn("pos", F.col("pos").cast("long"))
    sent = numbered.select("doc_id", "pos", *values, "copies", F.explode(places).alias("at")).select(
        "doc_id", F.col("at.ti").alias("ti"), F.col("at.tj").alias("tj"), F.col("at.role").alias("role"), "pos", *values, "copies"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for key, part in _tiles(batches, held):
            row, col = _two_sides(part, symmetric and key[1] == key[2])
            if len(row.pos) and len(col.pos):
                made = pd.DataFrame(reduce_tile(row, col, similarities(row, col)))
                made.insert(0, "doc_id", pd.Series([key[0]] * len(made), dtype=object))
                out.append(made)
                size += len(made)
            if size > 50_000:
                yield pd.concat(out, ignore_index=True)
                out, size = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    doc_id = rows.schema["doc_id"].dataType.simpleString()
    return sent.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(run, f"doc_id {doc_id}, {schema}")
