"""Entities that are not nodes: crosswalks, coarsest covers, paths and remaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine, ancestor_array, common_width, prefix, tabulation_code

OUTSIDE = "99999"  # fixed value: place code of a leaf outside every entity


def tabulation_crosswalk(leaves: DataFrame, tab_widths: dict[str, int]) -> DataFrame:
    """(leaf, entity_level, entity): the published code cut at each tabulation width."""
    parts = [
        F.struct(F.lit(name).alias("entity_level"), prefix(tabulation_code("geocode"), w).alias("entity"))
        for name, w in tab_widths.items()
    ]
    return leaves.select("geocode").distinct().select(
        F.col("geocode").alias("leaf"), F.inline(F.array(*parts))
    )


def entity_crosswalk(leaves: DataFrame, entity_of_leaf: DataFrame, sentinel: str = OUTSIDE) -> DataFrame:
    """(leaf, entity) from a user table (leaf, entity); leaves outside get the sentinel."""
    return leaves.select(F.col("geocode").alias("leaf")).distinct().join(
        entity_of_leaf.select("leaf", "entity"), "leaf", "left"
    ).select("leaf", F.coalesce("entity", F.lit(sentinel)).alias("entity"))


def coarsest_cover(crosswalk: DataFrame, spine: Spine, sentinel: str | None = None) -> DataFrame:
    """(entity, depth, geocode): the largest nodes whose leaves all lie in one entity.

    Per node the smallest and largest entity of its leaves; a node belongs to
    the cover when they agree and those of its parent do not. Each level is
    aggregated from the one below, so every shuffle is combined map-side.
    """
    level = crosswalk.groupBy(F.col("leaf").alias("geocode")).agg(
        F.min("entity").alias("lo"), F.max("entity").alias("hi")
    )
    found = []
    for depth in range(spine.depth, -1, -1):
        if depth == 0:
            pure = level.filter("lo = hi")
        else:
            up = level.groupBy(prefix("geocode", spine.widths[depth - 1]).alias("parent")).agg(
                F.min("lo").alias("lo"), F.max("hi").alias("hi")
            )
            split = up.filter("lo <> hi").select("parent")
            pure = (
                level.filter("lo = hi").withColumn("parent", prefix("geocode", spine.widths[depth - 1]))
                .join(split, "parent", "left_semi")
            )
            next_level = up.withColumnRenamed("parent", "geocode")
        found.append(pure.select(F.col("lo").alias("entity"), F.lit(depth).alias("depth"), "geocode"))
        level = next_level if depth else level
    cover = reduce(DataFrame.unionByName, found)
    return cover if sentinel is None else cover.filter(F.col("entity") != sentinel)


def custom_cover(nodes: DataFrame, kind: str) -> DataFrame:
    """Closed-form covers: 'leaf' (published code), 'root' (one row) or 'flagged' (drop a flag character)."""
    codes = nodes.select("geocode").distinct()
    if kind == "leaf":
        return codes.select(tabulation_code("geocode").alias("entity"), "geocode")
    if kind == "flagged":
        return codes.select(F.expr("substring(geocode, 2)").alias("entity"), "geocode")
    if kind == "root":
        one = codes.agg(F.count(F.lit(1)).alias("n"), F.max("geocode").alias("geocode"))
        ok = F.assert_true(F.col("n") == 1, F.lit("the root level must hold exactly one node"))
        return one.select(F.coalesce(ok.cast("string"), F.lit("")).alias("entity"), "geocode")
    raise ValueError(f"unknown cover kind {kind!r}")


def shortest_path(pairs: DataFrame, spine: Spine, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes from ``a`` up to the lowest common ancestor and down to ``b``, as array ``path``."""
    top = common_width(F.col(a), F.col(b), spine.widths)

    def chain(c: str, strictly: bool) -> Column:
        kept = F.filter(
            ancestor_array(c, spine.widths),
            lambda s: (s["width"] > F.col("top")) if strictly else (s["width"] >= F.col("top")),
        )
        return F.transform(kept, lambda s: s["node"])

    return pairs.withColumn("top", top).withColumn(
        "path", F.concat(F.reverse(chain(a, False)), chain(b, True))
    ).drop("top")


def path_closure(cover: DataFrame, spine: Spine) -> DataFrame:
    """(entity, geocode, in_cover): all nodes on paths between two nodes of a cover.

    They are the ancestors of the cover nodes up to the entity's lowest common
    ancestor, which the smallest and largest geocode already determine; no
    pair is formed.
    """
    bounds = cover.groupBy("entity").agg(
        F.min("geocode").alias("lo"), F.max("geocode").alias("hi"), F.min(F.length("geocode")).alias("shortest")
    )
    top = F.least(common_width(F.col("lo"), F.col("hi"), spine.widths), F.col("shortest"))
    up = cover.join(bounds.select("entity", top.alias("top")), "entity").select(
        "entity", "top", F.col("geocode").alias("member"), F.inline(ancestor_array("geocode", spine.widths))
    )
    return (
        up.filter(F.col("width") >= F.col("top"))
        .groupBy("entity", F.col("node").alias("geocode"))
        .agg(F.max(F.col("node") == F.col("member")).alias("in_cover"))
    )


def remap(df: DataFrame, mapping: DataFrame, column: str = "geocode") -> DataFrame:
    """Replace codes by the short (old, new) table; codes not listed stay."""
    return df.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(
        column, F.coalesce("new", column)
    ).drop("new")
