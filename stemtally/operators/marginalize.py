"""Coarsenings: bringing a query and a marginal histogram to their common rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.components import connected_components
from stemtally.functions.lineage import cut_lineage
from stemtally.operators.tabulate import Factor, LinearQuery, int_array, levels_of, ravel


def common_groups(first: Sequence[Sequence[int]], second: Sequence[Sequence[int]]) -> list[list[int]]:
    """Finest grouping whose groups are unions of groups of both sides (one attribute).

    Groups that share a level are joined; levels that only the second side
    has follow as further groups. At most a few hundred levels.
    """
    owner: dict[int, int] = {}
    merged: dict[int, list[int]] = {}
    for number, group in enumerate([*first, *second]):
        level_new = [i for i in group if i not in owner]
        hit = sorted({owner[i] for i in group if i in owner})
        home = hit[0] if hit else number
        merged.setdefault(home, [])
        for h in hit[1:]:
            merged[home] += merged.pop(h)
        merged[home] += level_new
        for i in merged[home]:
            owner[i] = home
    return [sorted(g) for _, g in sorted(merged.items()) if g]


def common_coarsening(query: LinearQuery, other: LinearQuery) -> LinearQuery:
    """Attribute-wise :func:`common_groups`; a query without factors takes the other side's."""
    if not query.factors:
        return other
    return LinearQuery(
        f"{query.name} & {other.name}",
        tuple(
            Factor.groups(f.size, common_groups(f.row_levels(), g.row_levels()))
            for f, g in zip(query.factors, other.factors, strict=True)
        ),
    )


def _row_map(fine: Factor, coarse: Factor) -> list[int | None]:
    """Coarse row of each fine row, through any shared level."""
    of_level = {i: r for r, i, _ in coarse.entries}
    return [next((of_level[i] for i in lv if i in of_level), None) for lv in fine.row_levels()]


def coarse_row(row_ix: Column, fine: LinearQuery, coarse: LinearQuery) -> Column:
    """Expression: row of the coarsening that contains a row of ``fine``."""
    levels = []
    for f, c, r in zip(fine.factors, coarse.factors, levels_of(row_ix, fine.row_shape)):
        m = _row_map(f, c)
        if c.rows == 1 and all(x == 0 for x in m):
            levels.append(F.lit(0))
        elif m == list(range(f.rows)):
            levels.append(r)
        else:
            levels.append(F.get(int_array(m), r))
    return ravel(levels, coarse.row_shape)


def marginalise(measurements: DataFrame, query: LinearQuery, marginal: LinearQuery) -> DataFrame:
    """Measured arrays of ``query`` -> (geocode, query_name, row_ix, value, variance) on the common rows.

    Summed rows add their variances. One projection and one aggregation that
    combines before the shuffle.
    """
    coarse = common_coarsening(query, marginal)
    rows = measurements.select("geocode", "query_name", "variance", F.posexplode("value").alias("_r", "_y"))
    return rows.groupBy("geocode", "query_name", coarse_row(F.col("_r"), query, coarse).alias("row_ix")).agg(
        F.sum("_y").alias("value"), F.sum("variance").alias("variance")
    )


def projection(spark: SparkSession, fine: LinearQuery, coarse: LinearQuery) -> DataFrame:
    """(coarse_row, row_ix): 0/1 matrix from rows of ``fine`` to rows of a coarsening."""
    r = spark.range(fine.num_rows).withColumnRenamed("id", "row_ix")
    return r.select(coarse_row(F.col("row_ix"), fine, coarse).alias("coarse_row"), "row_ix").filter("coarse_row is not null")


def marginal_design(spark: SparkSession, query: LinearQuery, marginal: LinearQuery) -> DataFrame:
    """(query_name, row_ix, cell, coef, mult): design of the marginalised query over the marginal's cells.

    ``mult`` is how many measured rows were summed into each design row.
    """
    coarse = common_coarsening(query, marginal)
    summed = projection(spark, query, coarse).groupBy("coarse_row").agg(F.count(F.lit(1)).cast("double").alias("mult"))
    cells = projection(spark, marginal, coarse).select("coarse_row", F.col("row_ix").alias("cell"))
    return cells.join(summed, "coarse_row").select(
        F.lit(query.name).alias("query_name"), F.col("coarse_row").cast("int").alias("row_ix"),
        F.col("cell").cast("int").alias("cell"), F.lit(1.0).alias("coef"), "mult",
    )


def marginalised_arrays(measurements: DataFrame, query: LinearQuery, marginal: LinearQuery) -> DataFrame:
    """As :func:`marginalise`, back in array form with the variance of a single measured row.

    Arrays are summed where they are; one aggregation over rows, not over
    their cells, adds up answers that come several times.
    """
    coarse = common_coarsening(query, marginal)
    places = np.unravel_index(np.arange(query.num_rows), query.row_shape)
    home, outside = np.zeros(query.num_rows, dtype=int), np.zeros(query.num_rows, dtype=bool)
    for f, c, at in zip(query.factors, coarse.factors, places, strict=True):
        to = np.array([-1 if x is None else x for x in _row_map(f, c)])[at]
        home, outside = home * c.rows + to, outside | (to < 0)
    if outside.any():
        raise ValueError(f"{query.name!r} has rows outside of {marginal.name!r}")
    n, size = coarse.num_rows, query.num_rows
    item = lambda i: F.coalesce(F.get("value", i), F.lit(0.0))
    turns = F.sequence(F.lit(0), F.floor((F.size("value") - 1) / size).cast("int"))  # as for marginalise, positions behind the last row begin anew
    y = lambda i: F.when(F.size("value") <= size, item(i)).otherwise(F.aggregate(turns, F.lit(0.0), lambda s, t: s + item(t * size + i)))
    if n == query.num_rows and (home == np.arange(n)).all():
        summed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), y)
    else:
        order = np.argsort(home, kind="stable")
        members, ends = int_array([int(i) for i in order]), np.cumsum(np.bincount(home, minlength=n))
        bounds = int_array([0, *map(int, ends)])
        of_row = lambda r: F.slice(members, F.get(bounds, r) + 1, F.get(bounds, r + 1) - F.get(bounds, r))
        summed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.aggregate(of_row(r), F.lit(0.0), lambda s, i: s + y(i)))
    zero = F.array_repeat(F.lit(0.0), n)
    met = F.col("geocode").isNotNull() & F.col("query_name").isNotNull() & F.col("value").isNotNull()
    rows = measurements.select("geocode", "query_name", F.when(met, summed).otherwise(zero).alias("value"), "variance")
    same = rows.groupBy("geocode", "query_name").agg(F.collect_list(F.struct("value", "variance")).alias("s"))
    both = F.aggregate("s", zero, lambda a, x: F.zip_with(a, x["value"], lambda p, q: p + q))
    value = F.when(F.size("s") == 1, F.get("s", F.lit(0))["value"]).otherwise(both)
    return same.select("geocode", "query_name", value.alias("value"), F.explode(F.transform("s", lambda x: x["variance"])).alias("variance"))


def refinement(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Which rows of ``fine`` make up each row of ``coarse``: (coarse_row, row_ix, exact).

    Both are 0/1 relations (row_ix, cell). A fine row counts when it lies
    inside the coarse row; ``exact`` says whether those rows partition it.
    """
    f = fine.select(F.col("row_ix").alias("fine_row"), "cell")
    c = coarse.select(F.col("row_ix").alias("coarse_row"), "cell")
    size = f.groupBy("fine_row").agg(F.count(F.lit(1)).alias("size"))
    want = c.groupBy("coarse_row").agg(F.count(F.lit(1)).alias("want"))
    inside = (
        f.join(c, "cell").groupBy("coarse_row", "fine_row").agg(F.count(F.lit(1)).alias("shared"))
        .join(size, "fine_row").filter("shared = size")
    )
    got = inside.join(f, "fine_row").groupBy("coarse_row").agg(
        F.count(F.lit(1)).alias("got"), F.countDistinct("cell").alias("covered")
    )
    verdict = want.join(got, "coarse_row", "left").select(
        "coarse_row", ((F.coalesce("got", F.lit(0)) == F.col("want")) & (F.coalesce("covered", F.lit(0)) == F.col("want"))).alias("exact")
    )
    return verdict.join(inside.select("coarse_row", F.col("fine_row").alias("row_ix")), "coarse_row", "left").select(
        "coarse_row", "row_ix", "exact"
    )


def merge_overlapping(groups: DataFrame) -> DataFrame:
    """(grp, member) -> (member, component): groups sharing members, merged until stable; component is the smallest member.

    The rows meet their groups' smallest members once. Only members that stand
    in groups with different smallest members join anything, so the rounds run
    on links between those alone. A null group is none, and a null member joins
    no groups.
    """
    edges = cut_lineage(groups.filter("grp is not null").select("grp", "member").distinct(), "edges")
    first = edges.groupBy("grp").agg(F.min("member").alias("label")).filter("label is not null")
    own = cut_lineage(edges.join(first, "grp").select("member", "label"), "labels")
    low = cut_lineage(own.filter("member is not null").groupBy("member").agg(F.min("label").alias("low"), F.max("label").alias("high")), "lowest")
    links = own.join(low.filter("low < high"), "member").filter("label > low").select(F.col("label").alias("u"), F.col("low").alias("v"))
    found = connected_components(links).withColumnRenamed("node", "label")
    merged = lambda df: df.join(found, "label", "left").withColumn("component", F.coalesce("component", "label"))
    lost = merged(own.filter("member is null").distinct()).groupBy("member").agg(F.min("component").alias("component"))
    return merged(low.withColumnRenamed("low", "label")).select("member", "component").unionByName(lost)


TENURE = ("tenvacgq", "hhtenshort_3lev")  # fixed values: tenure as measured inside the unit attribute, and the query that it stands for


def tenure_rows(measurements: DataFrame) -> DataFrame:
    """Measured arrays with the 4-level tenure part of the unit query as a 3-level tenure: with mortgage, free, and the sum of the two rented rows."""
    v = F.col("value")
    three = F.when(v.isNotNull(), F.array(F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.get(v, F.lit(2)) + F.get(v, F.lit(3))))
    is_unit = F.col("query_name") == TENURE[0]
    return measurements.withColumn("value", F.when(is_unit, three).otherwise(v)).withColumn("query_name", F.when(is_unit, TENURE[1]).otherwise(F.col("query_name")))


def tenure_design(design: DataFrame, kept: bool) -> DataFrame:
    """The design of the 3-level tenure: the sum of two rented rows has twice the variance; where tenure is summed out, the excess is spread evenly."""
    scale = F.when(F.col("row_ix") % 3 == 2, 2.0).otherwise(1.0) if kept else F.lit(4.0 / 3)
    return design.withColumn("mult", F.col("mult") * scale)


def rows_on_marginal(query: LinearQuery, marginal: LinearQuery) -> LinearQuery:
    """A query restated over the marginal's cells; it must be a union of them."""
    factors = []
    for f, m in zip(query.factors, marginal.factors, strict=True):
        home = {i: r for r, i, _ in m.entries}
        size = [len(x) for x in m.row_levels()]
        rows = []
        for levels in f.row_levels():
            hit = sorted({home[i] for i in levels if i in home})
            if any(i not in home for i in levels) or sum(size[h] for h in hit) != len(levels):
                raise ValueError(f"{query.name!r} is finer than the marginal {marginal.name!r}")
            rows.append(hit)
        factors.append(Factor.groups(m.rows, rows))
    assert prod(f.size for f in factors) == marginal.num_rows
    return LinearQuery(query.name, tuple(factors))
