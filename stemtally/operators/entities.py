"""Estimates and variances of entities made of several nodes, diagonal tier.

The variance of any sum over a cover is found in one aggregation per level:
each node carries the weight ``g`` its estimate has in the entity, and the part
``r`` of the variance already settled below it. No pair of nodes is formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine, common_width, prefix
from stemtally.functions.lineage import look_up, meet
from stemtally.operators.gls_diagonal import DiagonalPasses

SPREAD = 1e-15  # rounding of a sum of k equal terms stays below this times k; weights that differ stay above


def entity_estimate(cover: DataFrame, final: DataFrame) -> DataFrame:
    """(entity, cell, estimate): sum of the cover's final estimates."""
    return meet(cover, final.select("geocode", "cell", "final_estimate"), "geocode").groupBy("entity", "cell").agg(
        F.sum("final_estimate").alias("estimate")
    )


def _lift(parts: DataFrame, sums: DataFrame) -> DataFrame:
    """One level up: parts (entity, parent, cell, uninformed/known sums) -> (entity, geocode, cell, g, r)."""
    j = look_up(parts, sums.select("parent", "cell", "num_siblings", "uninformed", "known_variance"), ["parent", "cell"], of=sums)
    k = F.col("uninformed")
    # all informed: g = sum(C g) / sum(C); some uninformed: the mean weight of those
    g = F.when(k == 0, F.col("vg") / F.col("known_variance")).otherwise(F.col("free_g") / k)
    settled = F.when(k == 0, F.col("vgg") - F.col("vg") * F.col("vg") / F.col("known_variance")).otherwise(
        F.col("vgg") - 2 * F.col("g") * F.col("vg") + F.col("g") * F.col("g") * F.col("known_variance")
    )
    # unequal weights on several uninformed siblings leave the variance infinite
    spread = (k > 1) & (F.abs(F.col("free_gg") - F.col("free_g") * F.col("free_g") / k) > SPREAD * k * F.col("free_gg"))
    return j.withColumn("g", g).select(
        "entity", "top", F.col("parent").alias("geocode"), "cell", "g",
        F.when(spread, F.lit(float("inf"))).otherwise(F.col("r") + settled).alias("r"),
    )


def cover_tops(cover: DataFrame, spine: Spine) -> DataFrame:
    """(entity, top): depth of the lowest node that holds the whole cover."""
    b = cover.groupBy("entity").agg(F.min("geocode").alias("lo"), F.max("geocode").alias("hi"))
    width = common_width(F.col("lo"), F.col("hi"), spine.widths)
    return b.select("entity", (F.array_position(F.array(*[F.lit(w) for w in spine.widths]), width) - 1).cast("int").alias("top"))


def entity_variance(cover: DataFrame, passes: DiagonalPasses) -> DataFrame:
    """(entity, cell, variance) of the sum over each cover; infinite where the data leave it open.

    ``cover``: (entity, depth, geocode). An entity climbs only to the lowest
    node that holds all of it.
    """
    spine: Spine = passes.spine
    cover = passes.cut(cover.join(cover_tops(cover, spine), "entity").select("entity", "depth", "geocode", "top"), "cover")
    carried, done = None, []
    cols = ["entity", "top", "geocode", "cell", "g", "r"]
    zero = F.lit(0.0)
    for d in range(spine.depth, -1, -1):
        here = look_up(cover.filter(F.col("depth") == d), passes.up[d].select("geocode", "cell"), "geocode", of=passes.up[d]).select(
            "entity", "top", "geocode", "cell", F.lit(1.0).alias("g"), zero.alias("r")
        )
        rows = here if carried is None else here.unionByName(carried.select(cols))
        done.append(
            rows.filter(F.col("top") == d).join(passes.final[d].select("geocode", "cell", "final_variance"), ["geocode", "cell"])
        )
        if d == 0:
            break
        keyed = look_up(rows.filter(F.col("top") < d), passes.up[d].select("geocode", "cell", "up_variance"), ["geocode", "cell"], of=passes.up[d])
        keyed = keyed.withColumn("parent", prefix("geocode", spine.widths[d - 1]))
        v, g = F.col("up_variance"), F.col("g")
        if d == spine.depth:  # an only leaf repeats its parent: treat it as uninformed
            only = passes.sums[d - 1].filter("num_siblings = 1").select("parent").distinct().withColumn("only", F.lit(True))
            keyed = look_up(keyed, only, "parent", "left", of=passes.sums[d - 1]).withColumn("up_variance", F.when(F.col("only").isNull(), v))
        parts = keyed.groupBy("entity", "top", "parent", "cell").agg(
            F.coalesce(F.sum(v * g), zero).alias("vg"),
            F.coalesce(F.sum(v * g * g), zero).alias("vgg"),
            F.coalesce(F.sum(F.when(v.isNull(), g)), zero).alias("free_g"),
            F.coalesce(F.sum(F.when(v.isNull(), g * g)), zero).alias("free_gg"),
            F.sum("r").alias("r"),
        )
        carried = passes.cut(_lift(parts, passes.sums[d - 1]), f"entity_{d}")
    v, g, r = F.col("final_variance"), F.col("g"), F.col("r")
    total = F.when(g == 0, r).otherwise(r + g * g * v)
    return reduce(DataFrame.unionByName, done).groupBy("entity", "cell").agg(
        F.first(F.coalesce(total, F.lit(float("inf")))).alias("variance")
    )


# ---- covariances between single nodes, for reporting and checks ----------------------------


def ancestor_covariance(passes: DiagonalPasses, depth: int, top: int) -> DataFrame:
    """(node, ancestor, cell, covariance) between each node of ``depth`` and its ancestor at depth ``top``."""
    rows = passes.final[depth].select(F.col("geocode").alias("node"), "cell", F.col("share").alias("chain"))
    for d in range(depth - 1, top, -1):
        above = passes.final[d].select(F.col("geocode").alias("p"), "cell", "share")
        rows = rows.withColumn("p", prefix("node", passes.spine.widths[d])).join(above, ["p", "cell"]).select(
            "node", "cell", (F.col("chain") * F.col("share")).alias("chain")
        )
    a = passes.final[top].select(F.col("geocode").alias("ancestor"), "cell", "final_variance")
    return rows.withColumn("ancestor", prefix("node", passes.spine.widths[top])).join(a, ["ancestor", "cell"]).select(
        "node", "ancestor", "cell", (F.col("chain") * F.col("final_variance")).alias("covariance")
    )


def _between_siblings(rows: DataFrame, passes: DiagonalPasses, depth: int) -> DataFrame:
    """Rows (x, y, cell ...) of sibling nodes at ``depth`` -> the same with ``cov``."""
    f, w = passes.final[depth], passes.spine.widths[depth - 1]
    one = f.select(F.col("geocode").alias("x"), "cell", F.col("share").alias("sx"))
    two = f.select(F.col("geocode").alias("y"), "cell", F.col("share").alias("sy"))
    vy = passes.up[depth].select(F.col("geocode").alias("y"), "cell", "up_variance")
    top = passes.final[depth - 1].select(F.col("geocode").alias("p"), "cell", F.col("final_variance").alias("pv"))
    out = rows.join(one, ["x", "cell"]).join(two, ["y", "cell"]).join(vy, ["y", "cell"]).withColumn("p", prefix("x", w)).join(top, ["p", "cell"])
    return out.withColumn("cov", F.col("sx") * F.col("sy") * F.col("pv") - F.col("sx") * F.col("up_variance")).drop(
        "sx", "sy", "up_variance", "pv", "p"
    )


def sibling_covariance(passes: DiagonalPasses, pairs: DataFrame, depth: int) -> DataFrame:
    """(a, b, cell, covariance) for given pairs (a, b) of different nodes under one parent."""
    rows = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).join(
        passes.final[depth].select(F.col("geocode").alias("x"), "cell"), "x"
    )
    return _between_siblings(rows, passes, depth).select(F.col("x").alias("a"), F.col("y").alias("b"), "cell", F.col("cov").alias("covariance"))


def cousin_covariance(passes: DiagonalPasses, pairs: DataFrame, depth: int, meet: int) -> DataFrame:
    """(a, b, cell, covariance) for given pairs at ``depth`` whose ancestors at ``meet`` are different siblings."""
    w = passes.spine.widths
    rows = pairs.select("a", "b").join(passes.final[depth].select(F.col("geocode").alias("a"), "cell"), "a").withColumn("chain", F.lit(1.0))
    for d in range(depth, meet, -1):
        f = passes.final[d]
        for side in ("a", "b"):
            step = f.select(F.col("geocode").alias("q"), "cell", "share")
            rows = rows.withColumn("q", prefix(side, w[d])).join(step, ["q", "cell"]).withColumn(
                "chain", F.col("chain") * F.col("share")
            ).drop("q", "share")
    rows = rows.withColumn("x", prefix("a", w[meet])).withColumn("y", prefix("b", w[meet]))
    return _between_siblings(rows, passes, meet).select("a", "b", "cell", (F.col("chain") * F.col("cov")).alias("covariance"))
