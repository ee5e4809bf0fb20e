"""Fusing two independent estimates of the same population."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.grouped import stack
from stemtally.functions.matrices import pack_many, unpack_many


def fuse_scalars(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-variance weighting of (keys, estimate, variance) on common keys."""
    x = a.select(*keys, F.col("estimate").alias("e1"), F.col("variance").alias("v1"))
    y = b.select(*keys, F.col("estimate").alias("e2"), F.col("variance").alias("v2"))
    p = 1 / F.col("v1") + 1 / F.col("v2")
    return x.join(y, keys).select(
        *keys, ((F.col("e1") / F.col("v1") + F.col("e2") / F.col("v2")) / p).alias("estimate"), (1 / p).alias("variance")
    )


def fuse_answers(first: DataFrame, second: DataFrame, asked: int) -> DataFrame:
    """(entity, estimate, variance) of the asked answers of the first run, improved by the second.

    ``first`` (entity, estimate, covariance): ``asked`` answers, then p answers
    that the second run knows as well; ``second``: those p. Covariances are
    packed. Conditioning needs these answers alone, a matrix of p x p per
    entity, never one over all cells. A second run that leaves an entity
    undetermined says nothing about it; where the first does, it stays so.
    """

    def run(batches):
        for pdf in batches:
            e1, e2, v, w = stack(pdf["e1"]), stack(pdf["e2"]), unpack_many(stack(pdf["v1"])), unpack_many(stack(pdf["v2"]))
            use = np.isfinite(v).all(axis=(1, 2)) & np.isfinite(w).all(axis=(1, 2))
            est, var = e1[:, :asked].copy(), np.diagonal(v, axis1=1, axis2=2)[:, :asked].copy()
            cross, shared = v[use, :asked, asked:], v[use, asked:, asked:]
            gain = np.swapaxes(np.linalg.solve(shared + w[use], np.swapaxes(cross, 1, 2)), 1, 2)
            est[use] += (gain @ (e2[use] - e1[use][:, asked:])[..., None])[..., 0]
            var[use] -= (gain * cross).sum(axis=2)
            yield pd.DataFrame({"entity": pdf["entity"], "estimate": list(est), "variance": list(var)})

    x = first.select("entity", F.col("estimate").alias("e1"), F.col("covariance").alias("v1"))
    y = second.select("entity", F.col("estimate").alias("e2"), F.col("covariance").alias("v2"))
    return x.join(y, "entity").mapInPandas(run, "entity string, estimate array<double>, variance array<double>")


def fuse_matrices(first: DataFrame, second: DataFrame, q1: np.ndarray) -> DataFrame:
    """(entity, estimate, covariance) of the first histogram, improved by the second.

    ``first``: estimate b1 and packed covariance V1 of all its cells;
    ``second``: the mapped answers y = Q2 b2 with packed covariance W = Q2 V2 Q2'.
    ``q1`` maps the first histogram to the same answers. The update is
    written as a gain on the first estimate, so V1 needs no inverse.
    """

    def run(batches):
        for pdf in batches:
            b1, y, v1, w = stack(pdf["b1"]), stack(pdf["y"]), unpack_many(stack(pdf["v1"])), unpack_many(stack(pdf["w"]))
            vq = v1 @ q1.T
            gain = np.swapaxes(np.linalg.solve(q1 @ vq + w, np.swapaxes(vq, 1, 2)), 1, 2)
            est = b1 + (gain @ (y - b1 @ q1.T)[..., None])[..., 0]
            v = v1 - gain @ np.swapaxes(vq, 1, 2)
            cov = pack_many((v + np.swapaxes(v, 1, 2)) / 2)
            yield pd.DataFrame({"entity": pdf["entity"], "estimate": list(est), "covariance": list(cov)})

    joined = first.select("entity", F.col("estimate").alias("b1"), F.col("covariance").alias("v1")).join(
        second.select("entity", F.col("estimate").alias("y"), F.col("covariance").alias("w")), "entity"
    )
    return joined.mapInPandas(run, "entity string, estimate array<double>, covariance array<double>")
