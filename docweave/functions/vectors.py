"""Column functions on dense vectors (ARRAY<DOUBLE>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.common import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL when a vector is missing or zero, which callers read as distance 1."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance, where a missing distance counts as 1."""
    return F.lit(1.0) - F.coalesce(cosine_distance(a, b), F.lit(1.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    )


def _to_norm(v: Column, target: Column) -> Column:
    """Scale ``v`` to length ``target``; a zero vector stays as it is."""
    return let(
        F.struct(v.alias("v"), norm(v).alias("own"), target.alias("target")),
        lambda s: F.when(s["own"] > 0, F.transform(s["v"], lambda x: x * (s["target"] / s["own"]))).otherwise(s["v"]),
    )


def resize_truncate(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def resize_pad(v: Column, n: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(v), F.lit(0))))


def resize_redistribute(v: Column, n: int) -> Column:
    """Repeat the vector with weight 0.5, 0.25, 0.5/3 ... behind itself, then restore its length."""

    def grow(x):
        d = F.size(x)
        tail = F.transform(
            F.sequence(F.lit(0), F.lit(n) - d - 1),
            lambda i: F.get(x, i % d) * F.lit(0.5) / (F.lit(1) + F.floor(i / d)),
        )
        return _to_norm(F.concat(x, tail), norm(x))

    return let(v, grow)


def _dct_basis(n: int) -> np.ndarray:
    """Orthonormal cosine basis: row k holds basis vector k on n points."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.sqrt(2.0 / n) * np.cos(np.pi * (2 * i + 1) * k / (2.0 * n))
    basis[0] /= np.sqrt(2.0)
    return basis


def _dct_map(d: int, n: int) -> np.ndarray:
    return _dct_basis(d).T @ _dct_basis(n)[:d]


def _gaussian_map(d: int, n: int, seed: int = 42) -> np.ndarray:
    """Fixed-seed N(0, 1/sqrt(d)) matrix with ones on the diagonal (not orthogonal)."""
    out = np.random.RandomState(seed).normal(0, 1 / np.sqrt(d), (d, n))
    np.fill_diagonal(out, 1.0)
    return out


def _orthogonal_map(d: int, n: int, seed: int = 42) -> np.ndarray:
    """d x n with orthonormal rows when growing and orthonormal columns when shrinking."""
    q, _ = np.linalg.qr(np.random.RandomState(seed).standard_normal((max(d, n), min(d, n))))
    return q.T if n >= d else q


def linear_map(v: Column, make, n: int, keep_norm: bool) -> Column:
    """Multiply every vector with the matrix ``make(d, n)``: one BLAS call per Arrow batch and source size."""

    @F.pandas_udf("array<double>")
    def multiply(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        sizes = batch.map(len, na_action="ignore")
        for d in sizes.dropna().unique():
            rows = batch[sizes == d]
            before = np.stack(rows.to_numpy()).astype("float64")
            after = before @ make(int(d), n)
            if keep_norm:
                old, new = np.linalg.norm(before, axis=1), np.linalg.norm(after, axis=1)
                after *= np.divide(old, new, out=np.zeros_like(old), where=new > 0)[:, None]
            out[rows.index] = pd.Series(list(after), index=rows.index, dtype=object)
        return out

    return multiply(v)


def resize_dct(v: Column, n: int) -> Column:
    """Orthonormal cosine transform, zero-padded, read back on ``n`` points, length restored."""
    return linear_map(v, _dct_map, n, keep_norm=True)


def resize_linear(v: Column, n: int) -> Column:
    return linear_map(v, _gaussian_map, n, keep_norm=True)


def project_orthogonal(v: Column, n: int) -> Column:
    return linear_map(v, _orthogonal_map, n, keep_norm=False)


def resize_decay(v: Column, n: int, alpha: float = 0.5) -> Column:
    """Blocks ``alpha**t * v`` side by side, cut at ``n`` and scaled to length 1."""

    def grow(x):
        d = F.size(x)
        return F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.get(x, i % d) * F.pow(F.lit(float(alpha)), F.floor(i / d)),
        )

    return _to_norm(let(v, grow), F.lit(1.0))


# Name -> function for vectors that must grow.  Vectors that must shrink are cut; equal sizes pass through.
GROW = {
    "pad": resize_pad,
    "redistribute": resize_redistribute,
    "dct": resize_dct,
    "linear": resize_linear,
    "decay": resize_decay,
}


def resize(v: Column, n: int, method: str = "dct") -> Column:
    if method not in GROW:
        raise ValueError(f"unknown resize method {method!r}; known: {sorted(GROW)}")
    size = F.size(v)
    grown = GROW[method](F.when(size < n, v), n)
    return F.when(size == n, v).when(size > n, resize_truncate(v, n)).otherwise(grown)
