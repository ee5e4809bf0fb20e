"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first())


def _to_min(near: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours. The minimum is combined before the shuffle; the join of a hot u is split by AQE."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Large star: each node links its larger neighbours to its smallest one.
    Small star: each node links its smaller neighbours and itself to the
    smallest. Both keep connectivity; the edge table never grows past its
    first size, and ends as one star per component after a logarithmic number
    of rounds. Edges stay in written tables; the driver sees three numbers a
    round. Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, old = cut_lineage(e, "edges"), None
    mark = _mark(e)
    while mark[0] and mark != old:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        large = _to_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _to_min(large)
        small = low.select("u", F.col("m").alias("v")).union(low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        nxt = cut_lineage(small, "edges")
        release(e)
        e, old, mark = nxt, mark, _mark(nxt)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
