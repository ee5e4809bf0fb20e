"""Column expressions on geocodes: fixed-width keys whose prefix is the parent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TAB_GEOCODE_WIDTH = 16  # fixed value: the published geocode is the last 16 characters


@dataclass(frozen=True)
class Spine:
    """Levels of a tree, root first, each with its fixed geocode width."""

    names: tuple[str, ...]
    widths: tuple[int, ...]

    def __post_init__(self):
        if len(self.names) != len(self.widths) or list(self.widths) != sorted(set(self.widths)):
            raise ValueError("a spine needs one strictly growing width per level, root first")

    @property
    def depth(self) -> int:
        return len(self.names) - 1

    @property
    def leaf_width(self) -> int:
        return self.widths[-1]

    def width_of(self, name: str) -> int:
        return self.widths[self.names.index(name)]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix(geocode: str | Column, width: int) -> Column:
    """First ``width`` characters; width 0 is the root key ''."""
    return F.lit("") if width == 0 else F.substring(_col(geocode), 1, width)


def tabulation_code(geocode: str | Column) -> Column:
    """Published geocode of a spine geocode: its last 16 characters."""
    return F.right(_col(geocode), F.lit(TAB_GEOCODE_WIDTH))


def ancestor_array(geocode: str | Column, widths: Sequence[int]) -> Column:
    """Array of (depth, width, geocode) for the node and everything above it."""
    steps = [
        F.struct(F.lit(d).alias("depth"), F.lit(w).alias("width"), prefix(geocode, w).alias("node"))
        for d, w in enumerate(widths)
    ]
    return F.filter(F.array(*steps), lambda s: s["width"] <= F.length(_col(geocode)))


def common_width(a: Column, b: Column, widths: Sequence[int]) -> Column:
    """Width of the lowest common ancestor of two geocodes."""
    out = F.lit(widths[0])
    for w in widths[1:]:
        same = (F.length(a) >= w) & (F.length(b) >= w) & (prefix(a, w) == prefix(b, w))
        out = F.when(same, F.lit(w)).otherwise(out)
    return out
