"""Readers of measurements, constraints and side tables.

Layout: ``<root>/<Level>.parquet/<directory>``, one directory for measurements
and one for constraints per level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine
from stemtally.operators.spine import bypassed_measurements, complete_nodes, level_inventory, one_measurement_per_query, strip_suffix

# fixed values: directories and formats of the published files
MEASUREMENT_DIR = "DPQuery"
CONSTRAINT_DIR = "Constraint"
REFERENCE_COLUMNS = ("TABBLKST", "TABBLKCOU", "TABTRACTCE", "TABBLKGRPCE", "TABBLK", "PLACEFP")


def level_path(root: str, level: str, directory: str) -> str:
    return f"{root.rstrip('/')}/{level}.parquet/{directory}"


def read_constraints(spark: SparkSession, root: str, level: str, directory: str = CONSTRAINT_DIR) -> DataFrame:
    return spark.read.parquet(level_path(root, level, directory))


def read_level(
    spark: SparkSession, root: str, level: str, suffix_len: int = 4, directory: str = MEASUREMENT_DIR,
    constraint_directory: str = CONSTRAINT_DIR, on_missing_level: str = "error",
) -> DataFrame:
    """(geocode, query_name, value, variance) of one level, names without suffix, nodes complete.

    Of repeated names of a unit the most precise counts. With
    ``on_missing_level='bypass'`` an absent level becomes one bypassed
    measurement for each node its constraints name.
    """
    inventory = level_inventory(read_constraints(spark, root, level, constraint_directory))
    try:
        raw = spark.read.parquet(level_path(root, level, directory))
    except AnalysisException as e:  # anything but an absent folder is an error
        if on_missing_level != "bypass" or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return bypassed_measurements(inventory)
    rows = raw.select(
        "geocode", strip_suffix("query_name", suffix_len).alias("query_name"), F.col("value").cast("array<double>").alias("value"),
        F.col("variance").cast("double").alias("variance"),
    )
    return complete_nodes(one_measurement_per_query(rows), inventory)


def read_levels(spark: SparkSession, root: str, spine: Spine, **kw) -> DataFrame:
    """All levels of a tree with their ``depth``."""
    parts = [read_level(spark, root, n, **kw).select(F.lit(d).alias("depth"), "*") for d, n in enumerate(spine.names)]
    return reduce(DataFrame.unionByName, parts)


def read_reference_file(spark: SparkSession, path: str) -> DataFrame:
    """(leaf, place): pipe-separated reference file, leaf code put together from its parts."""
    ddl = ", ".join(f"{c} string" for c in REFERENCE_COLUMNS)
    raw = spark.read.schema(ddl).csv(path, sep="|", header=True)
    return raw.select(F.concat(*REFERENCE_COLUMNS[:5]).alias("leaf"), F.col("PLACEFP").alias("place"))


def write_widths(spark: SparkSession, spine: Spine, path: str) -> None:
    """Widths of the levels as JSON, written by the estimation and read by the interval job."""
    rows = list(zip(spine.widths, spine.names))
    spark.createDataFrame(rows, "width int, level string").coalesce(1).write.mode("overwrite").json(path)


def read_widths(spark: SparkSession, path: str) -> Spine:
    rows = sorted(spark.read.schema("width int, level string").json(path).collect())  # at most a dozen levels
    return Spine(tuple(r.level for r in rows), tuple(r.width for r in rows))


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("TABLE string, QUERY string, LEVEL string, col_index int, row_num int").csv(path, sep="|", header=True)


def write_workload(rows: DataFrame, path: str) -> None:
    """One pipe-separated file with header; refuses to overwrite."""
    cols = ["TABLE", "QUERY", "LEVEL", "col_index", "row_num"]
    rows.select(*cols).coalesce(1).write.mode("error").csv(path, sep="|", header=True)
