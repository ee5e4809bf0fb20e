"""Least squares over the tree when every cell is measured only by itself.

All quantities are scalars per (geocode, cell). Information is carried as
precision, so a unit without measurement is precision 0 and NULL variance and
no infinity ever enters an expression.

Columns: ``estimate``/``variance`` of a unit alone; ``up_estimate``/
``up_variance`` given its subtree; ``final_estimate``/``final_variance`` given
everything. ``variance`` NULL means no information.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine, prefix
from stemtally.functions.lineage import keep_lazy, look_up

SOFT_VARIANCE = 1 / 2**14  # fixed value: variance of a constraint entered as a measurement

Cut = Callable[[DataFrame, str], DataFrame]


def _finite(v):
    """NULL for an infinite variance."""
    return F.when(v != F.lit(float("inf")), v)


def own_estimate(cells: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """Combine the measurements of each cell of each unit.

    ``cells``: (geocode, cell, value, variance), several rows per cell
    allowed. ``masked``: (geocode, cell) held at zero by a soft measurement,
    which counts only for units that measured something.
    """
    w = 1 / _finite(F.col("variance"))
    rows = cells.select("geocode", "cell", w.alias("w"), (w * F.col("value")).alias("wy"))
    if masked is not None:
        soft = masked.select("geocode", "cell", F.lit(1 / SOFT_VARIANCE).alias("w"), F.lit(0.0).alias("wy"))
        measured = cells.filter("variance < double('infinity')").select("geocode").distinct()
        rows = rows.unionByName(soft.join(measured, "geocode", "left_semi"))
    s = rows.groupBy("geocode", "cell").agg(F.sum("w").alias("p"), F.sum("wy").alias("py"))
    return s.select(
        "geocode", "cell",
        F.coalesce(F.col("py") / F.col("p"), F.lit(0.0)).alias("estimate"),
        (1 / F.col("p")).alias("variance"),
    )


def single_estimate(cells: DataFrame) -> DataFrame:
    """:func:`own_estimate` where every cell has exactly one row: a projection, no shuffle."""
    v = _finite(F.col("variance"))
    return cells.select(
        "geocode", "cell", F.when(v.isNull(), F.lit(0.0)).otherwise(F.col("value")).alias("estimate"), v.alias("variance")
    )


def leaf_start(leaf: DataFrame) -> DataFrame:
    """Leaves know only themselves: up = own."""
    return leaf.select("geocode", "cell", F.col("estimate").alias("up_estimate"), F.col("variance").alias("up_variance"))


def child_sums(up: DataFrame, parent_width: int, leaf_level: bool) -> DataFrame:
    """Per (parent, cell): sums over the informed children and how many are not.

    At leaf level an only child is treated as carrying no information: such a
    leaf repeats its parent. ``known_*`` cover the informed children only.
    """
    informed = F.col("up_variance").isNotNull()
    s = up.groupBy(prefix("geocode", parent_width).alias("parent"), "cell").agg(
        F.count(F.lit(1)).alias("num_siblings"),
        F.count(F.when(~informed, 1)).alias("uninformed"),
        F.coalesce(F.sum(F.when(informed, F.col("up_estimate"))), F.lit(0.0)).alias("known_estimate"),
        F.coalesce(F.sum("up_variance"), F.lit(0.0)).alias("known_variance"),
    )
    if leaf_level:
        lone = F.col("num_siblings") == 1
        s = s.withColumn("uninformed", F.when(lone, F.lit(1)).otherwise(F.col("uninformed")).cast("bigint"))
        for c in ("known_estimate", "known_variance"):
            s = s.withColumn(c, F.when(lone, F.lit(0.0)).otherwise(F.col(c)))
    return s


def bottom_up(own: DataFrame, sums: DataFrame) -> DataFrame:
    """Combine a level with the sums over its children."""
    s = sums.withColumnRenamed("parent", "geocode")
    p = F.coalesce(1 / F.col("variance"), F.lit(0.0))
    j = F.coalesce(F.when(F.col("uninformed") == 0, 1 / F.col("known_variance")), F.lit(0.0))
    both = look_up(own, s, ["geocode", "cell"], "left", of=sums).select(
        "geocode", "cell", p.alias("p"), j.alias("j"), "estimate", "known_estimate"
    )
    info = F.col("p") + F.col("j")
    got = F.col("p") * F.col("estimate") + F.col("j") * F.coalesce("known_estimate", F.lit(0.0))
    return both.select(
        "geocode", "cell",
        F.when(info > 0, got / info).otherwise(0.0).alias("up_estimate"),
        F.when(info > 0, 1 / info).alias("up_variance"),
    )


def root_start(up: DataFrame) -> DataFrame:
    return up.select(
        "geocode", "cell", F.col("up_estimate").alias("final_estimate"), F.col("up_variance").alias("final_variance")
    )


def top_down(up: DataFrame, sums: DataFrame, parent_final: DataFrame, parent_width: int, cut: Cut = keep_lazy) -> DataFrame:
    """Hand the parent's final estimate down; ``cut`` writes what is handed, so that its size is known.

    Informed siblings share the residual in proportion to their variance;
    as soon as some sibling is uninformed, those take all of it, and only a
    single one of them gets a finite variance.
    """
    p = parent_final.select(F.col("geocode").alias("parent"), "cell", "final_estimate", "final_variance")
    above = sums.join(p, ["parent", "cell"]).select(
        "parent", "cell", "num_siblings", "uninformed", "known_variance",
        (F.col("final_estimate") - F.col("known_estimate")).alias("residual"),
        F.col("final_variance").alias("parent_variance"),
    )
    kids = look_up(up.withColumn("parent", prefix("geocode", parent_width)), cut(above, "above"), ["parent", "cell"])
    v, k = F.col("up_variance"), F.col("uninformed")
    lone_leaf = (F.col("num_siblings") == 1) & (k == 1)
    takes_rest = v.isNull() | lone_leaf
    share = (
        F.when(lone_leaf, F.lit(1.0)).when(k == 0, v / F.col("known_variance"))
        .when(v.isNull(), 1 / k).otherwise(F.lit(0.0))
    )
    base = F.when(takes_rest, F.lit(0.0)).otherwise(F.col("up_estimate"))
    new_v = (
        F.when(takes_rest, F.when(k == 1, F.col("parent_variance") + F.col("known_variance")))
        .when(k == 0, v + F.col("share") * F.col("share") * F.col("parent_variance") - F.col("share") * v)
        .otherwise(v)
    )
    return kids.withColumn("share", share).select(
        "geocode", "cell", (base + F.col("share") * F.col("residual")).alias("final_estimate"),
        new_v.alias("final_variance"), "share", "num_siblings",
    )


def leaf_top_down(up: DataFrame, sums: DataFrame, parent_final: DataFrame, parent_width: int, cut: Cut = keep_lazy) -> DataFrame:
    """Leaves with one common variance: b + (parent - sum) / n and C(1 - 1/n) + parent variance / n^2."""
    p = parent_final.select(F.col("geocode").alias("parent"), "cell", "final_estimate", "final_variance")
    above = sums.join(p, ["parent", "cell"]).select(
        "parent", "cell", F.col("num_siblings").alias("n"), "known_estimate", "final_estimate", "final_variance"
    )
    kids = look_up(up.withColumn("parent", prefix("geocode", parent_width)), cut(above, "above"), ["parent", "cell"])
    n = F.col("n")
    shift = F.when(n == 1, F.col("final_estimate") - F.col("up_estimate")).otherwise(
        (F.col("final_estimate") - F.col("known_estimate")) / n
    )
    return kids.select(
        "geocode", "cell", (F.col("up_estimate") + shift).alias("final_estimate"),
        F.when(n == 1, F.col("final_variance")).otherwise(
            F.col("up_variance") * (1 - 1 / n) + F.col("final_variance") / (n * n)
        ).alias("final_variance"),
    )


class DiagonalPasses:
    """Both passes, level by level; every level's tables stay reachable by depth.

    ``own`` should rest on stored measurements: the leaf level is read several
    times rather than copied.
    """

    def __init__(self, spine: Spine, own: Sequence[DataFrame], cut: Cut = keep_lazy):
        self.spine, self.cut = spine, cut
        d = spine.depth
        self.up: list[DataFrame] = [None] * (d + 1)
        self.sums: list[DataFrame] = [None] * (d + 1)  # sums[k]: over the children of depth k
        self.final: list[DataFrame] = [None] * (d + 1)
        self.up[d] = leaf_start(own[d])
        for k in range(d - 1, -1, -1):
            self.sums[k] = cut(child_sums(self.up[k + 1], spine.widths[k], leaf_level=k + 1 == d), f"sums_{k}")
            self.up[k] = cut(bottom_up(own[k], self.sums[k]), f"up_{k}")

    def run_down(self, cut: Cut = keep_lazy) -> "DiagonalPasses":
        """Top-down pass. The inputs are already cut, so results stay lazy unless asked otherwise."""
        self.final[0] = root_start(self.up[0])
        for k in range(1, self.spine.depth + 1):
            self.final[k] = cut(
                top_down(self.up[k], self.sums[k - 1], self.final[k - 1], self.spine.widths[k - 1], self.cut), f"final_{k}"
            )
        return self

    def estimates(self) -> DataFrame:
        """All levels: (depth, geocode, cell, final_estimate, final_variance)."""
        out = None
        for k, f in enumerate(self.final):
            part = f.select(F.lit(k).alias("depth"), "geocode", "cell", "final_estimate", "final_variance")
            out = part if out is None else out.unionByName(part)
        return out


def children_sum_check(final: Sequence[DataFrame], spine: Spine) -> DataFrame:
    """(depth, parent, cell, gap): parent minus the sum of its children; zero up to rounding."""
    out = None
    for k in range(spine.depth):
        kids = final[k + 1].groupBy(prefix("geocode", spine.widths[k]).alias("parent"), "cell").agg(
            F.sum("final_estimate").alias("total")
        )
        part = final[k].withColumnRenamed("geocode", "parent").join(kids, ["parent", "cell"]).select(
            F.lit(k).alias("depth"), "parent", "cell", (F.col("final_estimate") - F.col("total")).alias("gap")
        )
        out = part if out is None else out.unionByName(part)
    return out
