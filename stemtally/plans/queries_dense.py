"""Queries of the dense estimation tier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions import matrices as mx
from stemtally.functions.lineage import cut_lineage
from stemtally.operators import entities_dense as ed, fuse, gls_dense as gd, gls_residual as gr, marginalize as mg, tabulate as tab
from stemtally.plans.fixtures import CELLS, SHAPE, SPINE, VARIANCE, WIDE, Tables, sql, wide_measurements
from stemtally.plans.queries_estimates import _QC, r, rs
from stemtally.plans.registry import query

DETAILED = tab.tabular_query("detailed", SHAPE)
TOTAL = tab.tabular_query("total", SHAPE, {}, [0, 1])
TWO = tab.tabular_query("two", SHAPE, {0: [[0], [1, 2]]}, [1])


def measurements(t: Tables) -> DataFrame:
    out = None
    for d in range(4):
        out = t.arrays(d) if out is None else out.unionByName(t.arrays(d))
    return cut_lineage(out, "measurements", by=["depth"])


def dense_inputs(t: Tables, marginal=DETAILED, share: bool = True):
    """Measurements brought to a marginal histogram, and their design."""
    rows, design = None, None
    m = measurements(t)
    for q in (DETAILED, TOTAL):
        part = mg.marginalised_arrays(m.filter(F.col("query_name") == q.name), q, marginal)
        d = mg.marginal_design(t.spark, q, marginal)
        rows = part if rows is None else rows.unionByName(part)
        design = d if design is None else design.unionByName(d)
    depth = F.when(F.length("geocode") == 0, 0).when(F.length("geocode") == 1, 1).when(F.length("geocode") == 3, 2).otherwise(3)
    rows = cut_lineage(rows.withColumn("depth", depth), "on_marginal", by=["depth"])
    return gd.dense_own(rows, design, marginal.num_rows, share=share)


def dense_passes(t: Tables, marginal=DETAILED, share: bool = True) -> gd.DensePasses:
    return gd.DensePasses(SPINE, marginal.num_rows, *dense_inputs(t, marginal, share))


# two cells: the same passes with closed-form 2 x 2 inverses
_TWO = []
for _d in (3, 2, 1, 0):
    _v = VARIANCE[_d]
    _TWO.append((f"d{_d}", f"""SELECT geocode, off, 1.0 / {5 * _v} + 1.0 / {2 * _v} AS p11, 1.0 / {2 * _v} AS p12, 1.0 / {10 * _v} + 1.0 / {2 * _v} AS p22, y1 / {5 * _v} + (y1 + y2 + 3) / {2 * _v} AS r1, y2 / {10 * _v} + (y1 + y2 + 3) / {2 * _v} AS r2
      FROM (SELECT t.geocode, any_value(o.v) IS NULL AS off, sum(t.n + (t.key * 31 + t.cell * 17) % 13 - 6) FILTER (WHERE t.cell < 5) AS y1, sum(t.n + (t.key * 31 + t.cell * 17) % 13 - 6) FILTER (WHERE t.cell >= 5) AS y2
      FROM true{_d} t JOIN own{_d} o ON o.geocode = t.geocode AND o.cell = t.cell GROUP BY 1)"""))
_SOLVE = """SELECT geocode, CASE WHEN det > 0 THEN p22 / det END AS c11, CASE WHEN det > 0 THEN -p12 / det END AS c12, CASE WHEN det > 0 THEN p11 / det END AS c22,
  CASE WHEN det > 0 THEN (p22 * r1 - p12 * r2) / det ELSE 0 END AS b1, CASE WHEN det > 0 THEN (p11 * r2 - p12 * r1) / det ELSE 0 END AS b2 FROM (SELECT *, p11 * p22 - p12 * p12 AS det FROM ({}))"""
_ZERO = "CASE WHEN off THEN 0 ELSE {0} END AS {0}"
_TWO.append(("u3", _SOLVE.format("SELECT geocode, " + ", ".join(_ZERO.format(c) for c in ("p11", "p12", "p22", "r1", "r2")) + " FROM d3")))
for _d in (2, 1, 0):
    _w = SPINE.widths[_d]
    _TWO.append((f"s{_d}", f"""SELECT *, CASE WHEN free = 0 THEN k22 / (k11 * k22 - k12 * k12) ELSE 0 END AS j11, CASE WHEN free = 0 THEN -k12 / (k11 * k22 - k12 * k12) ELSE 0 END AS j12, CASE WHEN free = 0 THEN k11 / (k11 * k22 - k12 * k12) ELSE 0 END AS j22
      FROM (SELECT substr(geocode, 1, {_w}) AS parent, count(*) FILTER (WHERE c11 IS NULL) AS free, coalesce(sum(c11), 0) AS k11, coalesce(sum(c12), 0) AS k12, coalesce(sum(c22), 0) AS k22, sum(b1) AS e1, sum(b2) AS e2 FROM u{_d + 1} GROUP BY 1)"""))
    _own = {c: f"CASE WHEN d.off THEN 0 ELSE d.{c} END" for c in ("p11", "p12", "p22", "r1", "r2")}
    _TWO.append((f"u{_d}", _SOLVE.format(f"""SELECT d.geocode, {_own['p11']} + s.j11 AS p11, {_own['p12']} + s.j12 AS p12, {_own['p22']} + s.j22 AS p22, {_own['r1']} + s.j11 * s.e1 + s.j12 * s.e2 AS r1, {_own['r2']} + s.j12 * s.e1 + s.j22 * s.e2 AS r2
      FROM d{_d} d JOIN s{_d} s ON s.parent = d.geocode""")))
_TWO.append(("t0", "SELECT geocode, b1, b2, c11, c12, c22 FROM u0"))
for _d in (1, 2, 3):
    _w = SPINE.widths[_d - 1]
    _TWO.append((f"t{_d}", f"""SELECT geocode, b1 + a11 * x1 + a12 * x2 AS b1, b2 + a21 * x1 + a22 * x2 AS b2,
      CASE WHEN c11 IS NULL THEN CASE WHEN free = 1 THEN q11 + k11 END ELSE c11 + a11 * (a11 * q11 + a12 * q12) + a12 * (a11 * q12 + a12 * q22) - a11 * c11 - a12 * c12 END AS c11,
      CASE WHEN c11 IS NULL THEN CASE WHEN free = 1 THEN q12 + k12 END ELSE c12 + a11 * (a21 * q11 + a22 * q12) + a12 * (a21 * q12 + a22 * q22) - a11 * c12 - a12 * c22 END AS c12,
      CASE WHEN c11 IS NULL THEN CASE WHEN free = 1 THEN q22 + k22 END ELSE c22 + a21 * (a21 * q11 + a22 * q12) + a22 * (a21 * q12 + a22 * q22) - a21 * c12 - a22 * c22 END AS c22
      FROM (SELECT u.*, s.free, s.k11, s.k12, s.k22, t.b1 - s.e1 AS x1, t.b2 - s.e2 AS x2, t.c11 AS q11, t.c12 AS q12, t.c22 AS q22,
        CASE WHEN u.c11 IS NULL THEN 1.0 / s.free WHEN s.free > 0 THEN 0 ELSE u.c11 * s.j11 + u.c12 * s.j12 END AS a11, CASE WHEN u.c11 IS NULL OR s.free > 0 THEN 0 ELSE u.c11 * s.j12 + u.c12 * s.j22 END AS a12,
        CASE WHEN u.c11 IS NULL OR s.free > 0 THEN 0 ELSE u.c12 * s.j11 + u.c22 * s.j12 END AS a21, CASE WHEN u.c11 IS NULL THEN 1.0 / s.free WHEN s.free > 0 THEN 0 ELSE u.c12 * s.j12 + u.c22 * s.j22 END AS a22
        FROM u{_d} u JOIN s{_d - 1} s ON s.parent = substr(u.geocode, 1, {_w}) JOIN t{_d - 1} t ON t.geocode = s.parent)"""))


def _cells(name, prefix):
    return " UNION ALL ".join(
        f"SELECT {d} AS depth, geocode, {c} AS cell, {rs(f'b{c + 1}', 'estimate')}, {rs(f'c{c + 1}{c + 1}', 'variance')} FROM {prefix}{d}" for d in range(4) for c in (0, 1)
    )


def _long(levels, mats, key, vec, mat, n):
    """Estimates and variance diagonals of all levels, long and rounded."""
    at = [i * n - i * (i - 1) // 2 for i in range(n)]
    out = None
    for d, (nodes, m) in enumerate(zip(levels, mats)):
        diag = F.array(*[F.get(mat, F.lit(a)) for a in at])
        x = nodes.select("geocode", key, vec).join(m.select(key, diag.alias("v")), key).select(
            F.lit(d).alias("depth"), "geocode", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(n - 1)).alias("cell"), F.col(vec), F.col("v")))
        ).toDF("depth", "geocode", "cell", "estimate", "variance")
        out = x if out is None else out.unionByName(x)
    return out.select("depth", "geocode", "cell", r("estimate"), r("variance"))


@query("own_estimate_2cell", sql(" UNION ALL ".join(f"SELECT {d} AS depth, geocode, {c} AS cell, {rs(f'b{c + 1}', 'estimate')}, {rs(f'c{c + 1}{c + 1}', 'variance')} FROM o{d}" for d in range(4) for c in (0, 1)),
    *_TWO, *[(f"o{d}", _SOLVE.format("SELECT geocode, " + ", ".join(_ZERO.format(c) for c in ("p11", "p12", "p22", "r1", "r2")) + f" FROM d{d}")) for d in range(4)]))
def _(t: Tables):
    nodes, precision = dense_inputs(t, TWO)
    units, mats = gd.own_estimates(nodes, precision, 2)
    x = units.join(mats, "own_sig", "left").select(
        "depth", "geocode", F.inline(F.arrays_zip(F.array(F.lit(0), F.lit(1)), "estimate", F.array(F.get("c", F.lit(0)), F.get("c", F.lit(2)))))
    ).toDF("depth", "geocode", "cell", "estimate", "variance")
    return x.select("depth", "geocode", "cell", r("estimate"), r("variance"))


@query("bottom_up_2cell", sql(_cells("up", "u"), *_TWO))
def _(t):
    p = dense_passes(t, TWO)
    return _long(p.nodes, p.mats, "sig", "up", "c", 2)


@query("top_down_2cell", sql(_cells("down", "t"), *_TWO))
def _(t):
    p = dense_passes(t, TWO).run_down(leaf_matrices=True)
    return _long(p.down, p.down_mats, "dsig", "estimate", "ct", 2)


def _gls(share):
    def run(t):
        p = dense_passes(t, DETAILED, share).run_down(leaf_matrices=True)
        return _long(p.down, p.down_mats, "dsig", "estimate", "ct", CELLS)

    return run


_CELLS = sql(f"SELECT depth, geocode, cell, {rs('est', 'estimate')}, {rs('v', 'variance')} FROM cellsS")
query("gls_dense_15cell", _CELLS)(_gls(False))
query("gls_signature", _CELLS)(_gls(True))

# status and total as rows over the 15 cells
ASK = np.vstack([np.ones(CELLS), np.repeat(np.eye(3), 5, axis=1)])
ASK_NAMES = ["total", "status_0", "status_1", "status_2"]


@query("entity_covariance_dense", sql(f"SELECT entity, query, {rs('est', 'estimate')}, {rs('sqrt(v)', 'std_dev')} FROM askS"))
def _(t):
    """All covariances of four queries per entity."""
    p = dense_passes(t).run_down()
    e = ed.entity_covariance(t.part_cover, p, ASK)
    return ed.covariance_intervals(e, ASK_NAMES).select("entity", "query", r("estimate"), r("std_dev"))


@query("entity_variances_tiled", sql(f"SELECT entity, query, {rs('est', 'estimate')}, {rs('sqrt(v)', 'std_dev')} FROM askS"))
def _(t):
    """The same in tiles of three queries, variances alone."""
    e = ed.entity_variances(t.part_cover, dense_passes(t).run_down(), ASK, 3)
    return ed.variance_intervals(e, ASK_NAMES, 3).select("entity", "query", r("estimate"), r("std_dev"))


def diagonal_inputs(t: Tables):
    """Only the detailed query: the dense tier must then repeat the diagonal one."""
    m = measurements(t).filter("query_name = 'detailed'")
    return gd.dense_own(m, mg.marginal_design(t.spark, DETAILED, DETAILED), CELLS)


@query("entity_covariance", sql("""SELECT e.entity, q.query, round(sum(e.est), 6) + 0.0 AS estimate, round(sqrt(sum(e.v)), 6) AS std_dev FROM ent e JOIN qc q ON q.cell = e.cell
  WHERE q.query NOT LIKE 'priority%' GROUP BY 1, 2""", _QC))
def _(t):
    p = gd.DensePasses(SPINE, CELLS, *diagonal_inputs(t)).run_down()
    e = ed.entity_variances(t.segment_cover, p, ASK)
    return ed.variance_intervals(e, ASK_NAMES, len(ASK_NAMES)).select("entity", "query", r("estimate"), r("std_dev"))


@query("fuse_matrices", sql("""SELECT a.geocode AS entity, a.cell, round(a.est + a.v / (m.mv + 3.0) * (b.y - m.my), 6) + 0.0 AS estimate, round(a.v - a.v * a.v / (m.mv + 3.0), 6) + 0.0 AS variance
  FROM fin2 a JOIN (SELECT geocode, cell // 5 AS s, sum(v) AS mv, sum(est) AS my FROM fin2 GROUP BY 1, 2) m ON m.geocode = a.geocode AND m.s = a.cell // 5
  JOIN (SELECT geocode, cell // 5 AS s, CAST(sum(n) + (any_value(key) * 7 + cell // 5) % 11 - 5 AS DOUBLE) AS y FROM true2 GROUP BY 1, 2) b ON b.geocode = a.geocode AND b.s = m.s"""))
def _(t):
    """Fuse the nation estimates (15 cells) with a second run that only knows the three statuses."""
    f = t.passes().run_down().final[2]
    eye = F.transform(F.sequence(F.lit(0), F.lit(CELLS * CELLS - 1)), lambda k: F.when(F.floor(k / CELLS) == k % CELLS, F.get("v", (k % CELLS).cast("int"))).otherwise(F.lit(0.0)))
    first = f.groupBy("geocode").agg(F.array_sort(F.collect_list(F.struct("cell", "final_estimate", "final_variance"))).alias("s")).select(
        F.col("geocode").alias("entity"), F.transform("s", lambda x: x["final_estimate"]).alias("estimate"), F.transform("s", lambda x: x["final_variance"]).alias("v")
    ).select("entity", "estimate", mx.pack_expr(eye, CELLS).alias("covariance"))
    s = F.floor(F.col("cell") / 5).cast("int")
    second = t.true_counts(2).groupBy(F.col("geocode").alias("entity"), s.alias("s")).agg(F.sum("n").alias("n"), F.first("key").alias("key")).groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("s", (F.col("n") + (F.col("key") * 7 + F.col("s")) % 11 - 5).cast("double").alias("y")))).alias("y")
    ).select("entity", F.transform("y", lambda x: x["y"]).alias("estimate"), F.expr("array(3.0D, 0.0D, 0.0D, 3.0D, 0.0D, 3.0D)").alias("covariance"))
    both = fuse.fuse_matrices(first, second, ASK[1:])
    diag = F.array(*[F.get("covariance", F.lit(i * CELLS - i * (i - 1) // 2)) for i in range(CELLS)])
    return both.select("entity", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(CELLS - 1)), "estimate", diag))).toDF("entity", "cell", "estimate", "variance").select(
        "entity", "cell", r("estimate"), r("variance")
    )


@query("gls_residual_15cell", _CELLS)
def _(t):
    """The passes of ``gls_signature`` with one variance per subset of attributes in place of matrices."""
    basis = gr.Basis(SHAPE)
    p = gr.ResidualPasses(SPINE, basis, gr.residual_own(measurements(t), {q.name: q for q in (DETAILED, TOTAL)}, basis)).run_down()
    out = None
    for d in range(4):
        x = p.estimates(d).select(F.lit(d).alias("depth"), "geocode", F.posexplode("estimate").alias("cell", "estimate"), F.when(F.col("variance") < float("inf"), F.col("variance")).alias("variance"))
        out = x if out is None else out.unionByName(x)
    return out.select("depth", "geocode", "cell", r("estimate"), r("variance"))


@query("gls_residual_2016cell", sql(f"SELECT depth, geocode, k, {rs('level_est', 'level_estimate')}, {rs('level_v', 'level_variance')}, {rs('cell_est', 'cell_estimate')}, {rs('cell_v', 'cell_variance')} FROM pickedW"))
def _(t):
    """2,016 cells and three queries: the sums over the first attribute and one cell of each, at all units."""
    basis = gr.Basis(WIDE)
    asked = {n: tab.tabular_query(n, WIDE, {}, m) for n, m in (("detailed", []), ("first", [1, 2, 3]), ("total", [0, 1, 2, 3]))}
    p = gr.ResidualPasses(SPINE, basis, gr.residual_own(wide_measurements(t), asked, basis)).run_down()
    sums = [np.eye(8), *[np.ones((1, n)) for n in WIDE[1:]]]
    k, known, out = F.sequence(F.lit(0), F.lit(7)), lambda c: F.when(F.col(c) < float("inf"), F.col(c)), None
    for d in range(4):
        cells = p.estimates(d).select("geocode", F.transform(k, lambda i: F.get("estimate", i * 252 + (i * 37 + 11) % 252)).alias("cell_estimate"), known("variance").alias("cell_variance"))
        levels = p.answers(d, sums).select("geocode", F.col("estimate").alias("level_estimate"), F.col("variance").alias("level_variance"))
        x = levels.join(cells, "geocode").select(F.lit(d).alias("depth"), "geocode", "cell_variance", F.inline(F.arrays_zip(k.alias("k"), "level_estimate", "level_variance", "cell_estimate")))
        out = x if out is None else out.unionByName(x)
    return out.select("depth", "geocode", "k", r("level_estimate"), r(known("level_variance"), "level_variance"), r("cell_estimate"), r("cell_variance"))
