"""Cutting lineage: a written table in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """This application's part of the folder that ``spark.checkpoint.dir`` names.

    Every executor must see it, so there is no default: a session without the
    setting raises. The part is removed when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; written stages go there")
    root = f"{root.rstrip('/')}/stages/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return root


def cut_lineage(df: DataFrame, name: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and go on from the files, so a lost executor never replays the past.

    Parquet rather than ``DataFrame.checkpoint``: later steps read only the
    columns they use, and file sizes give the optimizer real statistics.
    ``by``: a few values each, whose files a task writes side by side; rows
    are not sorted for them first.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    conf, clean, open_files = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters"
    before = {k: conf.get(k) for k in (clean, open_files)}
    conf.set(clean, "true")  # once the table is written nothing reads its shuffle files
    if by:
        conf.set(open_files, "16")
    try:
        df.write.mode("error").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def meet(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the units, never through the driver.

    Written tables compress up to a hundredfold, so files below the broadcast
    limit may hold more rows than the driver does.
    """
    return left.join(right.hint("merge"), on, how)


def few(df: DataFrame) -> bool:
    """Whether a table written by :func:`cut_lineage` is small enough to be broadcast: its rows count, at the size of their types, never its files."""
    if not hasattr(df, "_stage_path"):
        return False
    if not hasattr(df, "_stage_rows"):
        df._stage_rows = df.count()
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._stage_rows * df._jdf.schema().defaultSize() <= limit


def look_up(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", of: DataFrame | None = None) -> DataFrame:
    """Join of rows that grow with the units with a table of a level above them, which is broadcast if it is :func:`few`; the rows never are.

    ``of``: the written table whose rows ``right`` selects from; else ``right`` itself.
    """
    return left.join(F.broadcast(right) if few(right if of is None else of) else right.hint("merge"), on, how)


def release(*stages: DataFrame) -> None:
    """Delete tables written by :func:`cut_lineage` that no later plan reads; other frames are left alone."""
    for df in stages:
        if path := getattr(df, "_stage_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table written by :func:`cut_lineage`."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(p).getLength()


def keep_lazy(df: DataFrame, name: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Drop-in for :func:`cut_lineage` where the plan is short enough to stay whole."""
    return df
