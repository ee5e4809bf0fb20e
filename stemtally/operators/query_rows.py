"""Rows of linear queries over a histogram's cells, made dense only a tile at a time and only where they are used."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np

from stemtally.operators.tabulate import Factor, LinearQuery


def factor_matrix(f: Factor) -> np.ndarray:
    out = np.zeros((f.rows, f.size))
    for r, i, c in f.entries:
        out[r, i] += c
    return out


@dataclass(frozen=True)
class QueryRows:
    """``count`` rows over ``cells`` cells; :meth:`block` makes rows a..b dense."""

    @property
    def count(self) -> int:
        raise NotImplementedError

    @property
    def cells(self) -> int:
        raise NotImplementedError

    def block(self, a: int, b: int) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class DenseRows(QueryRows):
    matrix: np.ndarray

    @property
    def count(self) -> int:
        return self.matrix.shape[0]

    @property
    def cells(self) -> int:
        return self.matrix.shape[1]

    def block(self, a: int, b: int) -> np.ndarray:
        return self.matrix[a:b]


@dataclass(frozen=True)
class FactorRows(QueryRows):
    """A Kronecker query: one small matrix per attribute, never their product."""

    query: LinearQuery

    @property
    def count(self) -> int:
        return self.query.num_rows

    @property
    def cells(self) -> int:
        return self.query.domain_size

    def block(self, a: int, b: int) -> np.ndarray:
        parts = [factor_matrix(f) for f in self.query.factors]
        places = np.unravel_index(np.arange(a, min(b, self.count)), self.query.row_shape)
        rows = np.ones((len(places[0]), 1))
        for m, at in zip(parts, places, strict=True):
            rows = (rows[:, :, None] * m[at][:, None, :]).reshape(len(rows), -1)
        return rows


@dataclass(frozen=True)
class StackedRows(QueryRows):
    parts: tuple[QueryRows, ...]

    @property
    def count(self) -> int:
        return sum(p.count for p in self.parts)

    @property
    def cells(self) -> int:
        return self.parts[0].cells

    def block(self, a: int, b: int) -> np.ndarray:
        out, at = [], 0
        for p in self.parts:
            lo, hi = max(a - at, 0), min(b - at, p.count)
            if lo < hi:
                out.append(p.block(lo, hi))
            at += p.count
        return np.vstack(out) if out else np.zeros((0, self.cells))


def as_rows(q: QueryRows | LinearQuery | np.ndarray | Sequence[QueryRows]) -> QueryRows:
    if isinstance(q, QueryRows):
        return q
    if isinstance(q, LinearQuery):
        return FactorRows(q)
    return DenseRows(q) if isinstance(q, np.ndarray) else StackedRows(tuple(map(as_rows, q)))


@dataclass(frozen=True)
class Tiles:
    """Rows cut into tiles of at most ``width``."""

    rows: QueryRows
    width: int

    @cached_property
    def number(self) -> int:
        return max(-(-self.rows.count // self.width), 1)

    def tile(self, t: int) -> np.ndarray:
        return self.rows.block(t * self.width, min((t + 1) * self.width, self.rows.count))


def contract(factors: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """(units, rows) of a Kronecker query on (units, cells), one attribute after the other: the product is never formed."""
    units = len(x)
    y = x.reshape(units, *[f.shape[1] for f in factors])
    for axis, f in enumerate(factors):
        y = np.moveaxis(np.tensordot(y, f, axes=(axis + 1, 1)), -1, axis + 1)
    return y.reshape(units, reduce(lambda a, f: a * f.shape[0], factors, 1))
