"""Nodes of the tree: inventories, completion, fan-out, ranks and hierarchical joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtally.functions.keys import prefix
from stemtally.functions.lineage import cut_lineage

BYPASSED_QUERY = "detailed"  # fixed value: query name given to a unit without own measurement


def level_inventory(constraints: DataFrame) -> DataFrame:
    """Every geocode of a level. Constraints are complete where measurements are not."""
    return constraints.select("geocode").distinct()


def bypassed_measurements(nodes: DataFrame, suffix_len: int = 0) -> DataFrame:
    """One 'detailed' measurement without value and with infinite variance per node."""
    return nodes.select(
        "geocode",
        F.lit(BYPASSED_QUERY + "_" * suffix_len).alias("query_name"),
        F.lit(None).cast("array<double>").alias("value"),
        F.lit(float("inf")).alias("variance"),
    )


def complete_nodes(measurements: DataFrame, inventory: DataFrame) -> DataFrame:
    """Append a bypassed row for every node of the inventory that was not measured."""
    missing = inventory.join(measurements.select("geocode").distinct(), "geocode", "left_anti")
    cols = [F.col(c) for c in ("geocode", "query_name", "value", "variance")]
    return measurements.select(*cols).unionByName(bypassed_measurements(missing))


def strip_suffix(query_name: str | Column, length: int) -> Column:
    c = F.col(query_name) if isinstance(query_name, str) else query_name
    return F.left(c, F.length(c) - F.lit(length)) if length else c


def one_measurement_per_query(measurements: DataFrame) -> DataFrame:
    """Resolve repeated (geocode, query_name): smallest variance, then smallest value, wins.

    An aggregate instead of a window: it combines before the shuffle, so a
    hot key is never gathered in one task.
    """
    pick = F.min(F.struct("variance", "value")).alias("m")
    return (
        measurements.groupBy("geocode", "query_name").agg(pick)
        .select("geocode", "query_name", F.col("m.value").alias("value"), F.col("m.variance").alias("variance"))
    )


def attach_constraints(measurements: DataFrame, constraints: DataFrame, overwrite: bool = True) -> DataFrame:
    """Rows of both relations for nodes present in both, tagged by ``kind``.

    With ``overwrite`` a constraint replaces the measurement of the same
    query name; without it both rows stay, told apart by ``kind``.
    """
    cols = ["geocode", "query_name", "value", "variance"]
    m = measurements.select(*cols, F.lit("measurement").alias("kind"))
    c = constraints.select(*cols, F.lit("constraint").alias("kind"))
    in_both = m.select("geocode").intersect(c.select("geocode"))
    if overwrite:
        m = m.join(c.select("geocode", "query_name"), ["geocode", "query_name"], "left_anti")
    return m.unionByName(c).join(in_both, "geocode", "left_semi")


def fan_out(children: DataFrame, parent_width: int) -> DataFrame:
    """Number of children per parent."""
    return children.groupBy(prefix("geocode", parent_width).alias("parent")).agg(
        F.count(F.lit(1)).alias("num_siblings")
    )


def with_num_siblings(children: DataFrame, parent_width: int) -> DataFrame:
    """Attach the fan-out of its parent to each node (aggregate plus join, no window on a hot parent)."""
    keyed = children.withColumn("parent", prefix("geocode", parent_width))
    return keyed.join(fan_out(children, parent_width), "parent")


def representative_leaf(leaves: DataFrame, parent_width: int) -> DataFrame:
    """First leaf in geocode order that follows a leaf of the same parent (no row if there is none).

    It is the second child of the first parent that has two, so two small
    aggregates and a two-row top-k do, without ordering the level.
    """
    keyed = leaves.select("geocode", prefix("geocode", parent_width).alias("parent")).distinct()
    first = (
        keyed.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .agg(F.min("parent").alias("parent"))
    )
    two = keyed.join(first, "parent").orderBy("geocode").limit(2)
    return two.agg(F.max("geocode").alias("geocode")).filter(F.col("geocode").isNotNull())


def surrogate_rank(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Zero-based rank of each distinct geocode in sorted order.

    Range partitions are ranked apart and shifted by the rows before them,
    so no task sees the whole level.
    """
    n = partitions or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        nodes.select("geocode").distinct().repartitionByRange(n, "geocode").withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("part").orderBy("geocode")
    return ranged.withColumn("r", F.row_number().over(within)).join(F.broadcast(shift), "part").select(
        "geocode", (F.col("r") - 1 + F.col("shift")).cast("bigint").alias("rank")
    )


def even_partitions(df: DataFrame, rows_per_partition: int, least: int = 64) -> DataFrame:
    """Contiguous geocode ranges of about equal size."""
    n = df.count()
    parts = max(-(-n // rows_per_partition), min(least, n), 1)
    return df.repartitionByRange(parts, "geocode")


def hierarchical_join(parents: DataFrame, children: DataFrame, parent_width: int, child_width: int) -> DataFrame:
    """Join children to their parent on a prefix half-way between both widths.

    Parents with many children are spread over several keys: a parent row is
    repeated once per distinct half-way prefix, never once per child.
    ``parents`` must have ``geocode``; its other columns must not clash.
    """
    mid = (parent_width + child_width) // 2
    kids = children.withColumn("join_code", prefix("geocode", mid))
    codes = kids.select("join_code").distinct().withColumn("parent", prefix("join_code", parent_width))
    spread = parents.withColumnRenamed("geocode", "parent").join(codes, "parent")
    return kids.join(spread, "join_code").drop("join_code")


def ancestors(nodes: DataFrame, widths: list[int]) -> DataFrame:
    """(geocode, depth, ancestor) for each node, itself included."""
    from stemtally.functions.keys import ancestor_array

    return nodes.select("geocode", F.inline(ancestor_array("geocode", widths))).select(
        "geocode", "depth", F.col("node").alias("ancestor")
    )
