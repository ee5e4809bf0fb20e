"""Zero and total constraints: from rows of the constraint table to masked cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine, prefix
from stemtally.operators.gls_diagonal import SOFT_VARIANCE

# fixed values: names of the total constraints, and columns that do not name a query
TOTAL_CONSTRAINTS = ("total_con", "pl94_con")
PLAIN_COLUMNS = ("geocode", "query_name", "sign", "query_shape", "value", "variance", "plb", "State", "County")
HOUSEHOLD_ZERO = "hhgq_total_ub_con"
LEAF_KEY = 16  # fixed value: characters that name a leaf in every tree
HOUSEHOLD_QUERY = "hhinstlevels"


def attribute_columns(constraints: DataFrame) -> list[str]:
    """String columns that carry one attribute's query name each."""
    return [
        f.name for f in constraints.schema.fields
        if f.dataType.typeName() == "string" and f.name not in PLAIN_COLUMNS
    ]


def constraint_name(columns: Sequence[str]) -> Column:
    """Attribute columns joined by ' * '; crossed names and NULLs are skipped."""
    return F.concat_ws(" * ", *[F.when(~F.contains(F.col(c), F.lit("*")), F.col(c)) for c in columns])


def interpret(constraints: DataFrame, total_invariant: bool = False) -> DataFrame:
    """(geocode, query_name, kind, row_ix, value, variance).

    ``kind`` 'total': the population total as an almost exact measurement
    (where totals are invariant). ``kind`` 'zero': one row per query row that
    must be zero. Lower bounds, other totals and positive upper bounds say
    nothing and vanish; an equality with a non-zero side is an error.
    """
    name = constraint_name(attribute_columns(constraints))
    is_total = F.coalesce(F.col("query_name").isin(*TOTAL_CONSTRAINTS), F.lit(False))
    variance = F.lit(SOFT_VARIANCE)
    sign = F.coalesce("sign", F.lit("="))  # anything but a bound is an equality
    rest = constraints.filter(~is_total & (sign != ">="))
    rows = rest.select("geocode", sign.alias("sign"), name.alias("query_name"), F.posexplode("value").alias("row_ix", "bound"))
    bad = F.assert_true(
        (F.col("sign") == "<=") | (F.col("bound") == 0), F.lit("only equalities to zero can be imposed")
    )
    zeros = (
        rows.filter(F.coalesce(bad.cast("boolean"), F.lit(True)) & (F.col("bound") == 0))
        .select("geocode", "query_name", F.lit("zero").alias("kind"), "row_ix", F.lit(0.0).alias("value"), variance.alias("variance"))
    )
    if not total_invariant:
        return zeros
    totals = constraints.filter(is_total).select(
        "geocode", F.lit("total").alias("query_name"), F.lit("total").alias("kind"), F.lit(0).alias("row_ix"),
        F.aggregate("value", F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double").alias("value"), variance.alias("variance"),
    )
    return totals.unionByName(zeros)


def zero_mask(zeros: DataFrame, matrix: DataFrame) -> DataFrame:
    """(geocode, cell): cells touched by a zero row. ``matrix``: (query, row_ix, cell, coef).

    Units with the same zero rows share a pattern; cells are expanded once per
    pattern and only then handed to the units.
    """
    units, patterns = zero_patterns(zeros)
    return units.join(pattern_cells(patterns, matrix), "pattern").select("geocode", "cell")


def zero_patterns(zeros: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(geocode, pattern) and (pattern, query_name, row_ix)."""
    z = zeros.filter("kind = 'zero'").select("geocode", "query_name", "row_ix")
    rows = z.groupBy("geocode").agg(F.array_sort(F.collect_set(F.struct("query_name", "row_ix"))).alias("rows"))
    keyed = rows.withColumn("pattern", F.sha2(F.col("rows").cast("string"), 256))
    lists = keyed.groupBy("pattern").agg(F.min("rows").alias("rows"))
    return keyed.select("geocode", "pattern"), lists.select("pattern", F.inline("rows"))


def pattern_cells(patterns: DataFrame, matrix: DataFrame) -> DataFrame:
    m = matrix.filter("coef <> 0").select(F.col("query").alias("query_name"), "row_ix", "cell")
    return patterns.join(m, ["query_name", "row_ix"]).select("pattern", "cell").distinct()


def marginal_mask(zeros: DataFrame, matrix: DataFrame, coarse_of_cell: Column, cells: DataFrame) -> DataFrame:
    """(geocode, cell): coarse cells all of whose fine cells are masked.

    ``cells``: one row per fine ``cell``; ``coarse_of_cell``: expression on it.
    """
    units, patterns = zero_patterns(zeros)
    hit = pattern_cells(patterns, matrix).groupBy("pattern", coarse_of_cell.alias("coarse")).agg(F.count(F.lit(1)).alias("masked"))
    full = cells.groupBy(coarse_of_cell.alias("coarse")).agg(F.count(F.lit(1)).alias("size"))
    dead = hit.join(full, "coarse").filter("masked = size").select("pattern", F.col("coarse").alias("cell"))
    return units.join(dead, "pattern").select("geocode", "cell")


def roll_up_zeros(leaf_flags: DataFrame, spine: Spine) -> DataFrame:
    """(depth, geocode, is_zero): a parent is zero when all of its children are."""
    level, out = leaf_flags.select("geocode", "is_zero"), None
    for k in range(spine.depth, -1, -1):
        part = level.select(F.lit(k).alias("depth"), "geocode", "is_zero")
        out = part if out is None else out.unionByName(part)
        if k:
            level = level.groupBy(prefix("geocode", spine.widths[k - 1]).alias("geocode")).agg(F.bool_and("is_zero").alias("is_zero"))
    return out


def household_zeros(leaf_constraints: DataFrame, spine: Spine, own_leaves: DataFrame | None = None) -> DataFrame:
    """Zero households at a leaf (bound 0), rolled up; rows like :func:`interpret` for levels above the leaves.

    ``own_leaves`` (geocode): leaves of ``spine`` where the constraints come
    from a run over another tree. Both name a leaf by its last LEAF_KEY
    characters; leaves that this tree does not have vanish.
    """
    flags = leaf_constraints.filter(F.col("query_name") == HOUSEHOLD_ZERO).select(
        "geocode", (F.get("value", F.lit(0)) == 0).alias("is_zero")
    )
    if own_leaves is not None:
        theirs = flags.select(F.right("geocode", F.lit(LEAF_KEY)).alias("_leaf"), "is_zero")
        flags = own_leaves.select("geocode", F.right("geocode", F.lit(LEAF_KEY)).alias("_leaf")).join(theirs, "_leaf").drop("_leaf")
    return roll_up_zeros(flags, spine).filter((F.col("depth") < spine.depth) & F.col("is_zero")).select(
        "depth", "geocode", F.lit(HOUSEHOLD_QUERY).alias("query_name"), F.lit("zero").alias("kind"), F.lit(0).alias("row_ix"),
        F.lit(0.0).alias("value"), F.lit(SOFT_VARIANCE).alias("variance"),
    )
