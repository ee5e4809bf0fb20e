"""Random trees and the brute-force least-squares answer they must match."""

from __future__ import annotations

import itertools

import numpy as np

from stemtally.functions.keys import Spine

DESIGN = {"detailed": [[1.0, 0.0], [0.0, 1.0]], "total": [[1.0, 1.0]]}


def random_tree(rng, depth: int, low: int = 1, high: int = 3):
    """Geocodes per level; one digit per level below the root ''."""
    levels = [[""]]
    for _ in range(depth):
        levels.append([p + str(i) for p in levels[-1] for i in range(int(rng.integers(low, high + 1)))])
    return Spine(tuple(f"L{i}" for i in range(depth + 1)), tuple(range(depth + 1))), levels


def leaves_of(node: str, leaves: list[str]) -> list[int]:
    return [i for i, x in enumerate(leaves) if x.startswith(node)]


def brute_force(levels, rows, n: int):
    """rows: {geocode: [(coefs over cells, value, variance), ...]}; returns mean and covariance of leaf cells.

    Unknown directions get a huge but finite prior so that what is determined can be compared.
    """
    leaves = levels[-1]
    size = len(leaves) * n
    p, r = np.zeros((size, size)), np.zeros(size)
    for level in levels:
        for g in level:
            for coefs, y, v in rows.get(g, []):
                if not np.isfinite(v):
                    continue
                a = np.zeros(size)
                for i in leaves_of(g, leaves):
                    a[i * n : (i + 1) * n] += coefs
                p += np.outer(a, a) / v
                r += a * y / v
    cov = np.linalg.inv(p)
    return cov @ r, cov


def node_selector(node: str, leaves: list[str], n: int) -> np.ndarray:
    s = np.zeros((n, len(leaves) * n))
    for i in leaves_of(node, leaves):
        s[:, i * n : (i + 1) * n] = np.eye(n)
    return s


def only_children(levels) -> set[str]:
    kids = levels[-1]
    return {g for p, grp in itertools.groupby(kids, key=lambda x: x[:-1]) for g in [list(grp)] if len(g) == 1 for g in g}
