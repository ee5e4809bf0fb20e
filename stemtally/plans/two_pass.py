"""The estimation job: stored measurements and constraints in, stored estimates out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.catalog.schemas import Schema, schema as schema_by_name
from stemtally.functions.keys import Spine
from stemtally.functions.lineage import cut_lineage
from stemtally.operators import constraints as ct, marginalize as mg
from stemtally.operators.gls_dense import DensePasses, dense_own
from stemtally.operators.spine import level_inventory
from stemtally.operators.tabulate import query_cell
from stemtally.plans.stored_run import Stopped, StoredRun
from stemtally.sources import measurements as src, results as res

TENURE_SCHEMA = "DHCH_SCHEMA_TEN_3LEV"  # fixed value: schema whose tenure is measured inside the unit attribute


def prepare(
    spark: SparkSession, root: str, spine: Spine, histogram: Schema, marginal: str | None = None, total_levels: tuple[str, ...] = (),
    household_root: str | None = None, suffix_len: int = 4, overwrite: bool = True, cut: Callable[..., DataFrame] = cut_lineage, **dirs,
) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Measurements over the marginal, their design, masked cells, and the number of cells.

    Total constraints become almost exact measurements; with ``overwrite`` they
    replace a measured total. Zero constraints count above the leaves only.
    ``household_root`` adds households known to be absent in another run.
    """
    target = histogram.query(marginal or "detailed")
    rows = src.read_levels(spark, root, spine, suffix_len=suffix_len, **dirs)
    names = [r.query_name for r in rows.select("query_name").distinct().collect()]  # as many as the catalog has queries
    if histogram.name == TENURE_SCHEMA and mg.TENURE[0] in names:
        rows = mg.tenure_rows(rows)
        names = [n for n in names if n != mg.TENURE[0]] + [mg.TENURE[1]]
    zeros, totals = None, None
    for level in spine.names[:-1]:
        c = ct.interpret(src.read_constraints(spark, root, level, dirs.get("constraint_directory", src.CONSTRAINT_DIR)), level in total_levels)
        z = c.filter("kind = 'zero'")
        zeros = z if zeros is None else zeros.unionByName(z)
        if level in total_levels:
            x = c.filter("kind = 'total'")
            totals = x if totals is None else totals.unionByName(x)
    if household_root is not None:
        leaf = src.read_constraints(spark, household_root, spine.names[-1])
        own = level_inventory(src.read_constraints(spark, root, spine.names[-1], dirs.get("constraint_directory", src.CONSTRAINT_DIR)))
        extra = ct.household_zeros(leaf, spine, own).drop("depth")
        zeros = extra if zeros is None else zeros.unionByName(extra)
    if totals is not None:
        t = totals.select("geocode", "query_name", F.array("value").alias("value"), "variance")
        depth = res.level_of_geocode(t, spine).select("depth", "geocode", "query_name", "value", "variance")
        if overwrite:
            rows = rows.join(depth.select("geocode", "query_name"), ["geocode", "query_name"], "left_anti")
        else:
            depth = depth.withColumn("query_name", F.lit("total constraint"))
        rows = rows.select("depth", "geocode", "query_name", "value", "variance").unionByName(depth)
        names = sorted(set(names) | {"total"})
    parts, designs = [], []
    for n in names:
        q = histogram.query(n)
        m = rows.filter(F.col("query_name") == n)
        arrays = m.select("geocode", "query_name", "value", "variance")
        if marginal is not None:
            arrays = mg.marginalised_arrays(arrays, q, target)
        design = mg.marginal_design(spark, q, target)
        if n == mg.TENURE[1] and histogram.name == TENURE_SCHEMA:
            design = mg.tenure_design(design, target.factors[histogram.dims.index(n)].rows == 3)
        parts.append(res.level_of_geocode(arrays, spine))
        designs.append(design)
    masked = None
    if zeros is not None:
        masked = _masked_cells(spark, zeros, histogram, marginal)
    return (
        cut(reduce(DataFrame.unionByName, parts), "measurements", by=["depth"]),
        cut(reduce(DataFrame.unionByName, designs), "design"),
        masked, target.num_rows,
    )


def _masked_cells(spark: SparkSession, zeros: DataFrame, histogram: Schema, marginal: str | None) -> DataFrame:
    names = [r.query_name for r in zeros.select("query_name").distinct().collect()]  # catalog-sized
    known = [n for n in names if n and histogram.knows(n)]
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"constraints name queries the schema {histogram.name} does not have: {unknown}")
    if not known:
        return zeros.select("geocode", F.lit(0).alias("cell")).limit(0)
    matrix = reduce(DataFrame.unionByName, [query_cell(spark, histogram.query(n)) for n in known])
    if marginal is None:
        return ct.zero_mask(zeros, matrix).select("geocode", F.col("cell").cast("int").alias("cell"))
    target = histogram.query(marginal)
    home = mg.coarse_row(F.col("cell"), histogram.query("detailed"), target).cast("int")
    return ct.marginal_mask(zeros, matrix, home, spark.range(histogram.size).withColumnRenamed("id", "cell"))


def run_two_pass_estimate(
    spark: SparkSession, root: str, spine: Spine, histogram: Schema | str, out: str, marginal: str | None = None,
    total_levels: tuple[str, ...] = (), household_root: str | None = None, suffix_len: int = 4, share: bool = True, until: str | None = None, **dirs,
) -> DensePasses | None:
    """Estimate every cell of every unit and keep all steps under ``out``; see :mod:`stemtally.plans.stored_run`.

    A run that stopped, for whatever reason, goes on behind its last committed
    step; a finished one is only opened. ``until`` names a step to stop after
    (None comes back), such as ``up_2``, the estimates given the subtree of
    level 2.
    """
    histogram = schema_by_name(histogram) if isinstance(histogram, str) else histogram
    n = histogram.query(marginal or "detailed").num_rows
    facts = {"root": root, "histogram": histogram.name, "marginal": marginal, "total_levels": total_levels, "household_root": household_root, "suffix_len": suffix_len, "share": share, "cells": n, **dirs}
    run = StoredRun(spark, out, spine, facts, until)
    try:
        if "precision" in run.done:
            own = run.read("own"), run.read("precision")
        else:
            rows, design, masked, n = prepare(spark, root, spine, histogram, marginal, total_levels, household_root, suffix_len, cut=run.cut, **dirs)
            own = dense_own(rows, design, n, masked, share, run.cut)
        return DensePasses(spine, n, *own, cut=run.cut).run_down()
    except Stopped:
        return None
