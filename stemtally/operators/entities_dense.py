"""Estimate and covariance of entities with full matrices, in tiles of queries.

The same climb as in the diagonal tier: each node carries the weights ``g`` its
cells have in the asked queries and the part ``r`` of the variance already
settled below it. Nodes that start with the same weights are counted per
signature, so a cover of many like leaves costs one product.

The queries are cut into tiles of columns, and a row is one node and one tile:
(cells x tile) weights and either a (tile x tile) covariance or, where only
deviations are asked, the tile's variances. All tiles climb together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.grouped import apply_by_signature, sum_arrays, sum_vectors
from stemtally.functions.keys import prefix
from stemtally.functions.lineage import cut_lineage, meet
from stemtally.functions.matrices import pack, unpack
from stemtally.operators.entities import SPREAD, cover_tops
from stemtally.operators.gls_dense import NO_OWN, DensePasses, _some
from stemtally.operators.query_rows import QueryRows, Tiles, as_rows

TILE_BYTES = 1 << 20  # weights of one node and tile


def _lone_parents(p: DensePasses) -> DataFrame:
    d = p.spine.depth
    one = p.mats[d - 1].filter("num_siblings = 1").select("sig")
    return p.nodes[d - 1].select("geocode", "sig").join(one, "sig", "left_semi").select(F.col("geocode").alias("parent"), F.lit(True).alias("lone"))


def _cube(arrays: pd.Series, *shape: int) -> np.ndarray:
    """One array per row, nulls as zeros."""
    out = np.zeros((len(arrays), int(np.prod(shape))))
    for k, a in enumerate(arrays):
        if _some(a):
            out[k] = a
    return out.reshape(len(arrays), *shape)


def _split(cube: np.ndarray) -> list[np.ndarray]:
    return list(cube.reshape(len(cube), -1))


def entity_moments(cover: DataFrame, passes: DensePasses, q: QueryRows, diagonal: bool, width: int) -> DataFrame:
    """(entity, tile, estimate, v) of the queries ``q`` for each cover: v holds the tile's variances, or its packed covariance.

    ``cover``: (entity, depth, geocode). An undetermined variance is infinite.
    With ``diagonal=False`` covariances between tiles are not formed.
    """
    spine, n = passes.spine, passes.n
    if q.cells != n:
        raise ValueError("queries and histogram differ in size")
    tiles = Tiles(q, width)
    cover = cover.join(cover_tops(cover, spine), "entity").select("entity", "depth", "geocode", "top")
    cover = cut_lineage(cover, "cover")
    m, size = width, width if diagonal else width * width
    numbers = F.explode(F.sequence(F.lit(0), F.lit(tiles.number - 1))).alias("tile")

    def weights(t: int) -> np.ndarray:
        """(cells, width), zeros behind the last query."""
        out = np.zeros((n, m))
        rows = tiles.tile(t)
        out[:, : len(rows)] = rows.T
        return out

    def quad(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * b).sum(axis=-2) if diagonal else np.swapaxes(a, -1, -2) @ b

    def twice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 2 * quad(a, b) if diagonal else quad(a, b) + quad(b, a)

    def settled(rows: pd.Series) -> np.ndarray:
        return _cube(rows, m) if diagonal else _cube(rows, m, m)

    def open_up(v: np.ndarray, spread: np.ndarray) -> None:
        """Infinite variances where ``spread`` (rows, width) holds."""
        if diagonal:
            v[spread] = np.inf
        else:
            v[np.einsum("ki,ij->kij", spread, np.eye(m)).astype(bool)] = np.inf

    def start_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, r, known = [], [], {}
            for c, t in zip(pdf["c"], pdf["tile"], strict=True):
                if not _some(c):
                    h.append(None), r.append(None)
                    continue
                if t not in known:
                    known = {t: weights(int(t))}
                cq = unpack(c) @ known[t]
                h.append(cq.ravel()), r.append(quad(known[t], cq).ravel())
            yield pd.DataFrame({"sig": pdf["sig"], "tile": pdf["tile"], "h": pd.Series(h, dtype=object), "r": pd.Series(r, dtype=object)})

    def carried_terms(rows: pd.DataFrame, mat: dict) -> pd.DataFrame:
        out = rows[["entity", "top", "tile", "parent"]].copy()
        g, r, none = _cube(rows["g"], n, m), settled(rows["r"]), [None] * len(rows)
        if _some(mat.get("c")):
            cg = unpack(mat["c"]) @ g
            cols = _split(cg), _split(r + quad(g, cg)), none, none
        else:
            cols = none, _split(r), _split(g), _split((g * g).sum(axis=1))
        for name, col in zip(("h", "r", "fg", "fgg"), cols, strict=True):
            out[name] = pd.Series(col, index=rows.index, dtype=object)
        return out

    def lift(rows: pd.DataFrame, mat: dict) -> pd.DataFrame:
        k, h, r = int(mat["free"]), _cube(rows["h"], n, m), settled(rows["r"])
        if k == 0:
            g = unpack(mat["j"]) @ h
            r = r - quad(h, g)
        else:
            units = rows["units"].to_numpy(np.float64)
            total, squares = _cube(rows["fg"], n, m), _cube(rows["fgg"], m)
            for t in rows["tile"].unique():
                at = np.flatnonzero((rows["tile"] == t) & (units > 0))
                w = weights(int(t))
                total[at] += units[at, None, None] * w
                squares[at] += units[at, None] * (w * w).sum(axis=0)
            g = total / k
            r = r - twice(g, h) + (quad(g, unpack(mat["f"]) @ g) if _some(mat.get("f")) else 0.0)
            if k > 1:
                open_up(r, squares - k * (g * g).sum(axis=1) > SPREAD * k * squares)
        out = rows[["entity", "top", "tile", "geocode"]].copy()
        out["g"], out["r"] = pd.Series(_split(g), index=rows.index, dtype=object), pd.Series(_split(r), index=rows.index, dtype=object)
        return out

    def close(rows: pd.DataFrame, mat: dict) -> pd.DataFrame:
        g, v = _cube(rows["g"], n, m), settled(rows["r"])
        for t in rows["tile"].unique():
            at = np.flatnonzero((rows["tile"] == t) & rows["g"].isna())
            if len(at):
                g[at] = weights(int(t))
        if _some(mat.get("ct")):
            v = v + quad(g, unpack(mat["ct"]) @ g)
        else:
            open_up(v, (g != 0).any(axis=1))
        out = [x if diagonal else pack((x + x.T) / 2) for x in v]
        return pd.DataFrame({"entity": rows["entity"], "tile": rows["tile"], "v": pd.Series(out, index=rows.index, dtype=object)})

    none, carried, done = F.lit(None).cast("array<double>"), None, None
    keys = ["entity", "top", "tile", "parent"]
    row = 8 * (3 * n * m + size)
    for d in range(spine.depth, -1, -1):
        here = cover.filter(F.col("depth") == d)
        ends = here.filter(F.col("top") == d).select("entity", numbers, "geocode", none.alias("g"), none.alias("r"))
        if carried is not None:
            ends = ends.unionByName(carried.filter(F.col("top") == d).select("entity", "tile", "geocode", "g", "r"))
        at_end = meet(ends, passes.down[d].select("geocode", "dsig"), "geocode")
        part = apply_by_signature(at_end, passes.down_matrices(d).select("dsig", "ct"), "dsig", close, "entity string, tile int, v array<double>", row_bytes=row, spread="entity")
        done = part if done is None else done.unionByName(part)
        if d == 0:
            break
        w = spine.widths[d - 1]
        start = meet(here.filter(F.col("top") < d), passes.nodes[d].select("geocode", "sig"), "geocode").withColumn("parent", prefix("geocode", w))
        if d == spine.depth:
            start = start.join(_lone_parents(passes), "parent", "left").withColumn("sig", F.when(F.col("lone"), F.lit(NO_OWN)).otherwise(F.col("sig")))
        counted = start.groupBy("entity", "top", "parent", "sig").agg(F.count(F.lit(1)).alias("cnt"))
        counted = cut_lineage(counted, "start")
        terms = counted.select("sig").distinct().join(passes.mats[d].select("sig", "c"), "sig", "left").select("sig", "c", numbers).mapInPandas(
            start_terms, "sig string, tile int, h array<double>, r array<double>"
        )
        scaled = lambda c: F.transform(c, lambda x: x * F.col("cnt"))
        rows = counted.join(terms, "sig").select(
            *keys, scaled("h").alias("h"), scaled("r").alias("r"), none.alias("fg"), none.alias("fgg"), F.when(F.col("h").isNull(), F.col("cnt")).otherwise(0).alias("units"),
        )
        if carried is not None:
            up = meet(carried.filter(F.col("top") < d), passes.nodes[d].select("geocode", "sig"), "geocode").withColumn("parent", prefix("geocode", w))
            moved = apply_by_signature(
                up, passes.mats[d].select("sig", "c"), "sig", carried_terms,
                "entity string, top int, tile int, parent string, h array<double>, r array<double>, fg array<double>, fgg array<double>", row_bytes=row, spread="entity",
            )
            rows = rows.unionByName(moved.withColumn("units", F.lit(0).cast("bigint")))
        rows = cut_lineage(rows, "terms")
        sums = sum_arrays(rows, keys, ["h", "r", "fg", "fgg"])  # partial sums are formed in each task before the shuffle
        units = rows.groupBy(*keys).agg(F.sum("units").alias("units"))
        ready = meet(meet(sums, units, keys).withColumnRenamed("parent", "geocode"), passes.nodes[d - 1].select("geocode", "sig"), "geocode")
        lifted = apply_by_signature(
            ready, passes.mats[d - 1].select("sig", "j", "f", "free"), "sig", lift, "entity string, top int, tile int, geocode string, g array<double>, r array<double>", row_bytes=row, spread="entity",
        )
        carried = cut_lineage(lifted, "lifted")

    totals = None
    for d in range(spine.depth + 1):
        part = meet(cover.filter(F.col("depth") == d), passes.down[d].select("geocode", "estimate"), "geocode").select("entity", "estimate")
        totals = part if totals is None else totals.unionByName(part)
    totals = sum_vectors(totals, ["entity"], "estimate")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _cube(pdf["estimate"], n)
            for t in range(tiles.number):
                yield pd.DataFrame({"entity": pdf["entity"], "tile": t, "estimate": list(x @ tiles.tile(t).T)})

    return totals.mapInPandas(ask, "entity string, tile int, estimate array<double>").join(done, ["entity", "tile"])


def tile_width(passes: DensePasses, q: QueryRows) -> int:
    return max(1, min(q.count, TILE_BYTES // (8 * passes.n)))


def entity_variances(cover: DataFrame, passes: DensePasses, q, width: int | None = None) -> DataFrame:
    """(entity, tile, estimate, v): estimates and variances of the queries, a tile of them per row."""
    q = as_rows(q)
    return entity_moments(cover, passes, q, True, width or tile_width(passes, q))


def entity_covariance(cover: DataFrame, passes: DensePasses, q) -> DataFrame:
    """(entity, estimate, covariance) of the queries ``q`` for each cover, all of them against each other, packed.

    For few queries; deviations alone are :func:`entity_variances`.
    """
    q = as_rows(q)
    return entity_moments(cover, passes, q, False, q.count).select("entity", "estimate", F.col("v").alias("covariance"))


def variance_intervals(entities: DataFrame, queries: list[str], width: int) -> DataFrame:
    """(entity, query, estimate, std_dev) from :func:`entity_variances`; ``queries`` names all rows in order."""
    names = F.slice(F.array(*[F.lit(x) for x in queries]), F.col("tile") * width + 1, F.lit(width))
    sd = F.transform(F.slice("v", F.lit(1), F.size("estimate")), lambda x: F.sqrt(x))
    return entities.select("entity", F.inline(F.arrays_zip(names.alias("query"), F.col("estimate"), sd.alias("std_dev")))).toDF("entity", "query", "estimate", "std_dev")


def covariance_intervals(entities: DataFrame, queries: list[str]) -> DataFrame:
    """(entity, query, estimate, std_dev) from packed covariances; ``queries`` names the rows in order."""
    m = len(queries)
    at = F.array(*[F.lit(i * m - i * (i - 1) // 2) for i in range(m)])
    sd = F.transform(at, lambda a: F.sqrt(F.get("covariance", a)))
    names = F.array(*[F.lit(x) for x in queries])
    return entities.select("entity", F.inline(F.arrays_zip(names.alias("query"), F.col("estimate"), sd.alias("std_dev")))).toDF(
        "entity", "query", "estimate", "std_dev"
    )
