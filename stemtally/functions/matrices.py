"""Small numeric helpers used inside tasks, on one matrix or one batch of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(m: np.ndarray) -> np.ndarray:
    """Symmetric matrix -> upper triangle, row-major."""
    return m[np.triu_indices(m.shape[0])]


def packed_order(size: int) -> int:
    n = int(round(((1 + 8 * size) ** 0.5 - 1) / 2))
    if n * (n + 1) // 2 != size:
        raise ValueError(f"{size} values are not the upper triangle of a square matrix")
    return n


def unpack(v: np.ndarray) -> np.ndarray:
    """Upper triangle, row-major -> symmetric matrix. Any infinite diagonal means all of it."""
    v = np.asarray(v, dtype=float)
    n = packed_order(v.size)
    m = np.zeros((n, n))
    iu = np.triu_indices(n)
    m[iu] = v
    open_ = np.isinf(m.diagonal())
    if open_.any():
        if not open_.all():
            raise ValueError("a covariance diagonal must be infinite everywhere or nowhere")
        return np.diag(np.full(n, np.inf))
    m.T[iu] = v
    return m


def spd_inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive definite matrix, exactly symmetric."""
    try:
        half = np.linalg.inv(np.linalg.cholesky(m))
    except np.linalg.LinAlgError as e:
        raise ValueError("the measurements of a unit do not determine all of its cells") from e
    return half.T @ half


def spd_inverses(m: np.ndarray) -> np.ndarray:
    """:func:`spd_inverse` of each matrix of (units, n, n)."""
    try:
        half = np.linalg.inv(np.linalg.cholesky(m))
    except np.linalg.LinAlgError as e:
        raise ValueError("the measurements of a unit do not determine all of its cells") from e
    return np.swapaxes(half, 1, 2) @ half


def pack_many(m: np.ndarray) -> np.ndarray:
    """(units, n, n) -> (units, packed)."""
    return m[:, *np.triu_indices(m.shape[1])]


def unpack_many(v: np.ndarray) -> np.ndarray:
    """(units, packed) -> (units, n, n); infinite entries stay where they are."""
    n = packed_order(v.shape[1])
    iu = np.triu_indices(n)
    m = np.zeros((len(v), n, n))
    m[:, *iu] = v
    m[:, iu[1], iu[0]] = v
    return m


# ---- the same codecs as column expressions -------------------------------------------------


def pack_expr(square: Column, n: int) -> Column:
    """Row-major n*n array -> packed upper triangle."""
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(square, i * n + i + 1, F.lit(n) - i)
    )
    return F.flatten(rows)


def unpack_expr(packed: Column, n: int) -> Column:
    """Packed upper triangle -> row-major n*n array."""

    def at(k: Column) -> Column:
        r, c = F.floor(k / n).cast("int"), (k % n).cast("int")
        i, j = F.least(r, c), F.greatest(r, c)
        return F.get(packed, (i * n - (i * (i - 1) / 2).cast("int") + j - i).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), at)


def packed_order_expr(packed: Column) -> Column:
    return F.round((F.sqrt(1 + 8 * F.size(packed)) - 1) / 2).cast("int")
