"""From estimate and standard deviation to margins of error and integer intervals."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_quantile(alpha: float) -> float:
    """Two-sided standard normal quantile for coverage 1 - alpha."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(1 - alpha / 2)


def query_answers(cells: DataFrame, query_cell: DataFrame) -> DataFrame:
    """(entity, query, estimate, std_dev) when cells are independent.

    ``cells``: (entity, cell, estimate, variance); ``query_cell``: (query, cell, coef).
    """
    q = query_cell.groupBy("query", "cell").agg(F.sum("coef").alias("coef"))
    c = F.col("coef")
    return (
        cells.join(q, "cell").groupBy("entity", "query")
        .agg(F.sum(c * F.col("estimate")).alias("estimate"), F.sqrt(F.sum(c * c * F.col("variance"))).alias("std_dev"))
    )


def with_moe(answers: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """One row per answer and alpha, with ``moe`` = std_dev times the normal quantile."""
    zs = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(normal_quantile(a)).alias("z")) for a in alphas])
    return answers.select("*", F.inline(zs)).withColumn("moe", F.col("std_dev") * F.col("z")).drop("z")


def integer_interval(intervals: DataFrame) -> DataFrame:
    """Whole, non-negative bounds: ceil of the lower end, floor of the upper."""
    lo = F.greatest(F.ceil(F.col("estimate") - F.col("moe")), F.lit(0))
    hi = F.greatest(F.floor(F.col("estimate") + F.col("moe")), F.lit(0))
    return intervals.select("*", lo.cast("bigint").alias("lower"), hi.cast("bigint").alias("upper"))
