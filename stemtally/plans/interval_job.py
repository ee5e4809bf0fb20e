"""The interval job: estimates and margins of error for entities of every kind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.catalog.schemas import Schema, schema
from stemtally.functions.lineage import cut_lineage
from stemtally.operators import covers, fuse, intervals, marginalize as mg
from stemtally.operators.entities_dense import entity_covariance, entity_variances, tile_width, variance_intervals
from stemtally.operators.gls_dense import DensePasses
from stemtally.operators.query_rows import DenseRows, QueryRows, as_rows
from stemtally.operators.tabulate import Factor, LinearQuery
from stemtally.plans.stored_run import load
from stemtally.sources import results as res

Rows = QueryRows | LinearQuery | np.ndarray | Sequence

def projection_query(schema_name: Schema | str, mapping: str, marginal: str) -> LinearQuery:
    """The rows of the common coarsening with ``mapping``, over the cells of a marginal: one 0/1 factor per attribute."""
    s = schema(schema_name) if isinstance(schema_name, str) else schema_name
    fine, asked = s.query(marginal), s.query(mapping)
    coarse = mg.common_coarsening(asked, fine)
    factors = []
    for f, c in zip(fine.factors, coarse.factors, strict=True):
        rows = [[] for _ in range(c.rows)]
        for i, r in enumerate(mg._row_map(f, c)):
            if r is not None:
                rows[r].append(i)
        factors.append(Factor.groups(f.rows, rows))
    return LinearQuery(mapping, tuple(factors))


def entity_covers(leaves: DataFrame, passes: DensePasses, tab_widths: Mapping[str, int], levels: Sequence[str]) -> dict[str, DataFrame]:
    """(entity, depth, geocode) per entity level; closed forms where the tree itself has them."""
    spine, out = passes.spine, {}
    names = dict(zip(("root", "leaf"), (spine.names[0], spine.names[-1])))
    for level in levels:
        if level == names["root"]:
            cover = covers.custom_cover(passes.nodes[0], "root").withColumn("depth", F.lit(0))
        elif level == names["leaf"]:
            cover = covers.custom_cover(passes.nodes[spine.depth], "leaf").withColumn("depth", F.lit(spine.depth))
        elif level == "State":
            d = spine.names.index("State")
            cover = covers.custom_cover(passes.nodes[d], "flagged").withColumn("depth", F.lit(d))
        else:
            walk = covers.tabulation_crosswalk(leaves, {level: tab_widths[level]}).select("leaf", "entity")
            cover = covers.coarsest_cover(walk, spine)
        out[level] = cover.select("entity", "depth", "geocode")
    return out


def estimate_intervals(
    covers_of: Mapping[str, DataFrame], passes: DensePasses, queries: Rows, names: Sequence[str], alphas: Sequence[float], out: str,
    second: DensePasses | None = None, second_covers: Mapping[str, DataFrame] | None = None, first_map: Rows | None = None, second_map: Rows | None = None,
) -> dict[str, DataFrame]:
    """Intervals per entity level, written under ``<out>/intervals``; estimates and variances before that under ``<out>/entities``.

    ``queries`` and the maps are rows over the cells: linear queries (kept as
    factors), arrays, or lists of these. With a second run (all four of its
    arguments, or none), both are fused on common entities: ``first_map`` and
    ``second_map`` bring both histograms to the same answers. Any passes will
    do, those just made or those :func:`load` opened.
    """
    extra = [second, second_covers, first_map, second_map]
    if any(x is None for x in extra) and any(x is not None for x in extra):
        raise ValueError("give all arguments of the second run or none")
    done, base, asked = {}, out.rstrip("/"), as_rows(queries)
    for level, cover in covers_of.items():
        if second is None:
            width = tile_width(passes, asked)
            found = entity_variances(cover, passes, asked, width)
        else:
            shared, other = as_rows(first_map), entity_covariance(second_covers[level], second, second_map)
            other, width = cut_lineage(other, "second"), max(shared.count, 1)
            parts = []
            for t in range(0, asked.count, width):
                own = entity_covariance(cover, passes, [DenseRows(asked.block(t, t + width)), shared])
                parts.append(fuse.fuse_answers(own, other, min(width, asked.count - t)).select("entity", F.lit(t // width).alias("tile"), "estimate", F.col("variance").alias("v")))
            found = reduce(DataFrame.unionByName, parts)
        found = res.write_table(found, f"{base}/entities/{level}")
        rows = intervals.with_moe(variance_intervals(found, list(names), width), alphas).withColumnRenamed("entity", "geocode")
        done[level] = res.write_intervals(rows, f"{base}/intervals/{level}")
    return done


def stored_intervals(
    spark: SparkSession, run: str, covers_of: Mapping[str, DataFrame], queries: Rows, names: Sequence[str], alphas: Sequence[float], out: str,
    second_run: str | None = None, second_covers: Mapping[str, DataFrame] | None = None, first_map: Rows | None = None, second_map: Rows | None = None,
) -> dict[str, DataFrame]:
    """:func:`estimate_intervals` from finished runs in files, by their paths alone."""
    second = load(spark, second_run) if second_run else None
    return estimate_intervals(covers_of, load(spark, run), queries, names, alphas, out, second, second_covers, first_map, second_map)
