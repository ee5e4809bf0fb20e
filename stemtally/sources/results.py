"""Stored state of the passes, entity estimates, intervals and the published layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine
from stemtally.functions.lineage import cut_lineage

FILE_ROWS = 2_000_000  # rows of a published file, about 150 MB as text

INTERVAL_DDL = "geocode string, query string, alpha double, estimate double, std_dev double, moe double"


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Parquet, zstd; returns the table as read back, so the plan starts anew."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_state(spark: SparkSession, paths: str | Sequence[str], keep: DataFrame | None = None, on: str = "geocode", partitions: int | None = None) -> DataFrame:
    """Stored nodes; ``keep`` restricts them by an inner join before anything wide is read further."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if keep is not None:
        df = df.join(keep, on)
    return df if partitions is None else df.repartition(partitions, on)


def write_intervals(intervals: DataFrame, path: str, as_csv: bool = True, csv_files: int | None = None) -> DataFrame:
    """Interval rows as parquet and, for people, as CSV with header; ``csv_files`` bounds the number of CSV files."""
    rows = intervals.select("geocode", "query", "alpha", "estimate", "std_dev", "moe")
    out = write_table(rows, f"{path}.parquet")
    if as_csv:
        (out.coalesce(csv_files) if csv_files else out).write.mode("overwrite").csv(f"{path}.csv", header=True)
    return out


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERVAL_DDL).parquet(f"{path}.parquet")


def publish(rows: DataFrame, path: str, levels: dict[str, tuple[int, int]], rows_per_file: int = FILE_ROWS) -> None:
    """Published layout: directories per level code, pipe-separated rows, one file per directory up to ``rows_per_file`` rows.

    ``rows``: (geocode, query, estimate, std_dev, query_description);
    ``levels``: directory name -> (start, length) inside the geocode. Rows are
    dealt by directory before they are written; a directory of more rows goes
    to as many tasks as it has files, by the hash of its rows' geocodes.
    """
    parts = {n: F.substring("geocode", s, k) for n, (s, k) in levels.items()}
    keyed = cut_lineage(rows.select("geocode", "query", "estimate", "std_dev", "query_description", *[c.alias(n) for n, c in parts.items()]), "published")
    files = keyed.groupBy(*parts).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files")).filter("_files > 1")
    part = F.pmod(F.xxhash64("geocode", "query"), F.coalesce("_files", F.lit(1)))
    dealt = keyed.join(cut_lineage(files, "files"), [*parts], "left").repartition(*parts, part).drop("_files")
    dealt.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").partitionBy(*parts).csv(path, sep="|", header=True)


def read_published(spark: SparkSession, path: str, levels: Sequence[str]) -> DataFrame:
    ddl = "geocode string, query string, estimate double, std_dev double, query_description string, "
    return spark.read.schema(ddl + ", ".join(f"{n} string" for n in levels)).csv(path, sep="|", header=True)


def level_of_geocode(df: DataFrame, spine: Spine) -> DataFrame:
    """Add ``depth`` from the length of the geocode."""
    out = F.lit(0)
    for d, w in enumerate(spine.widths):
        out = F.when(F.length("geocode") == w, d).otherwise(out)
    return df.withColumn("depth", out)
