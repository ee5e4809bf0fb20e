"""Queries on estimation, entities, intervals and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemtally.functions.keys import prefix
from stemtally.operators import entities, fuse, gls_diagonal as gd, intervals
from stemtally.plans.fixtures import CELLS, SPINE, Tables, sql
from stemtally.plans.registry import query

D = 6


def r(c, name=None):
    """Rounded, with -0.0 as 0.0."""
    out = F.round(F.col(c) if isinstance(c, str) else c, D) + F.lit(0.0)
    return out.alias(name or c)


def rs(c, name=None):
    return f"round({c}, {D}) + 0.0 AS {name or c}"


_ALL = [0, 1, 2, 3]


def _levels(tables, pick):
    out = None
    for d, x in enumerate(tables):
        part = x.select(F.lit(d).alias("depth"), *pick)
        out = part if out is None else out.unionByName(part)
    return out


@query("own_estimate", sql(" UNION ALL ".join(f"SELECT {d} AS depth, geocode, cell, {rs('est', 'estimate')}, {rs('v', 'variance')} FROM own{d}" for d in _ALL)))
def _(t: Tables):
    return _levels([t.own(d) for d in _ALL], ["geocode", "cell", r("estimate"), r("variance")])


@query("own_estimate_masked", sql("""SELECT t.geocode, t.cell, CASE WHEN o.v IS NULL THEN 0.0 WHEN t.n = 0 THEN round((o.est / 2) / (1.0 / 2 + 16384), 6) + 0.0 ELSE round(o.est, 6) + 0.0 END AS estimate,
  CASE WHEN o.v IS NULL THEN NULL WHEN t.n = 0 THEN round(1 / (1.0 / 2 + 16384), 6) ELSE 2.0 END AS variance FROM true2 t JOIN own2 o ON o.geocode = t.geocode AND o.cell = t.cell"""))
def _(t):
    masked = t.true_counts(2).filter("n = 0").select("geocode", "cell")
    return gd.own_estimate(t.measured(2), masked).select("geocode", "cell", r("estimate"), r("variance"))


@query("child_sums", sql(" UNION ALL ".join(f"SELECT {d} AS depth, parent, cell, n AS num_siblings, free AS uninformed, {rs('ke', 'known_estimate')}, {rs('kv', 'known_variance')} FROM sums{d}" for d in (0, 1, 2))))
def _(t):
    p = t.passes()
    return _levels(p.sums[:3], ["parent", "cell", "num_siblings", "uninformed", r("known_estimate"), r("known_variance")])


@query("bottom_up", sql(" UNION ALL ".join(f"SELECT {d} AS depth, geocode, cell, {rs('est', 'up_estimate')}, {rs('v', 'up_variance')} FROM up{d}" for d in _ALL)))
def _(t):
    return _levels(t.passes().up, ["geocode", "cell", r("up_estimate"), r("up_variance")])


@query("top_down", sql(f"SELECT depth, geocode, cell, {rs('est', 'final_estimate')}, {rs('v', 'final_variance')} FROM fin"))
def _(t):
    return t.passes().run_down().estimates().select("depth", "geocode", "cell", r("final_estimate"), r("final_variance"))


@query("leaf_top_down", sql("""SELECT u.geocode, u.cell, round(u.est + (f.est - s.ke) / s.n, 6) + 0.0 AS final_estimate, round(u.v * (1 - 1.0 / s.n) + f.v / (s.n * s.n), 6) + 0.0 AS final_variance
  FROM up3 u JOIN sums2 s ON s.parent = substr(u.geocode, 1, 3) AND s.cell = u.cell JOIN fin2 f ON f.geocode = s.parent AND f.cell = s.cell WHERE s.n > 1 AND s.free = 0"""))
def _(t):
    p = t.passes().run_down()
    even = p.sums[2].filter("uninformed = 0 and num_siblings > 1")
    return gd.leaf_top_down(p.up[3], even, p.final[2], 3, p.cut).select("geocode", "cell", r("final_estimate"), r("final_variance"))


@query("children_sum_check", sql("SELECT d.depth, x.geocode AS parent, c.cell, 0.0::DOUBLE AS gap FROM (SELECT unnest([0, 1, 2]) AS depth) d JOIN nodes x ON x.depth = d.depth CROSS JOIN (SELECT DISTINCT cell FROM true0) c"))
def _(t):
    return gd.children_sum_check(t.passes().run_down().final, SPINE).select("depth", "parent", "cell", r("gap"))


@query("coverage_by_level", sql("""SELECT depth, sum(CASE WHEN f.v IS NULL THEN 1 ELSE 0 END)::BIGINT AS undetermined, round(avg(f.v), 6) AS mean_variance, round(avg(1 / sqrt(f.v)), 6) AS mean_precision FROM fin f GROUP BY 1"""))
def _(t):
    e = t.passes().run_down().estimates()
    return e.groupBy("depth").agg(
        F.count(F.when(F.col("final_variance").isNull(), 1)).alias("undetermined"),
        F.round(F.avg("final_variance"), 6).alias("mean_variance"), F.round(F.avg(1 / F.sqrt("final_variance")), 6).alias("mean_precision"),
    )


def _number(t: Tables, step: int):
    """Pairs (a, b) of nations whose numbers differ by ``step``."""
    n = t.level(2).select("geocode", F.substring("geocode", 2, 2).cast("int").alias("k"))
    return n.withColumnRenamed("geocode", "a").join(n.select(F.col("geocode").alias("b"), (F.col("k") - step).alias("k")), "k")


@query("sibling_covariance", sql("""SELECT a.geocode AS a, b.geocode AS b, a.cell, round(a.share * b.share * p.v - a.share * u.v, 6) + 0.0 AS covariance
  FROM fin2 a JOIN fin2 b ON substr(a.geocode, 1, 1) = substr(b.geocode, 1, 1) AND a.cell = b.cell AND substr(a.geocode, 2, 2)::INT + 5 = substr(b.geocode, 2, 2)::INT
  JOIN fin1 p ON p.geocode = substr(a.geocode, 1, 1) AND p.cell = a.cell JOIN up2 u ON u.geocode = b.geocode AND u.cell = b.cell"""))
def _(t):
    """Each nation with the next one of its region: five regions take turns in the numbering."""
    pairs = _number(t, 5).filter(F.left("a", F.lit(1)) == F.left("b", F.lit(1)))
    return entities.sibling_covariance(t.passes().run_down(), pairs, 2).select("a", "b", "cell", r("covariance"))


@query("ancestor_covariance", sql("""SELECT c.geocode AS node, a.geocode AS ancestor, c.cell, round(c.share * n.share * a.v, 6) + 0.0 AS covariance FROM fin3 c
  JOIN fin2 n ON n.geocode = substr(c.geocode, 1, 3) AND n.cell = c.cell JOIN fin1 a ON a.geocode = substr(c.geocode, 1, 1) AND a.cell = c.cell"""))
def _(t):
    return entities.ancestor_covariance(t.passes().run_down(), 3, 1).select("node", "ancestor", "cell", r("covariance"))


@query("cousin_covariance", sql("""SELECT a.geocode AS a, b.geocode AS b, a.cell, round(a.share * b.share * (x.share * y.share * p.v - x.share * u.v), 6) + 0.0 AS covariance
  FROM fin2 a JOIN fin2 b ON a.cell = b.cell AND substr(a.geocode, 1, 1) < substr(b.geocode, 1, 1) AND substr(a.geocode, 2, 2)::INT + 1 = substr(b.geocode, 2, 2)::INT
  JOIN fin1 x ON x.geocode = substr(a.geocode, 1, 1) AND x.cell = a.cell JOIN fin1 y ON y.geocode = substr(b.geocode, 1, 1) AND y.cell = a.cell
  JOIN fin0 p ON p.cell = a.cell JOIN up1 u ON u.geocode = y.geocode AND u.cell = a.cell"""))
def _(t):
    pairs = _number(t, 1).filter(F.left("a", F.lit(1)) < F.left("b", F.lit(1)))
    return entities.cousin_covariance(t.passes().run_down(), pairs, 2, 1).select("a", "b", "cell", r("covariance"))


@query("entity_estimate", sql(f"SELECT entity, cell, {rs('est', 'estimate')} FROM ent"))
def _(t):
    return entities.entity_estimate(t.segment_cover, t.passes().run_down().estimates()).select("entity", "cell", r("estimate"))


@query("entity_variance", sql(f"SELECT entity, cell, {rs('v', 'variance')} FROM ent"))
def _(t):
    return entities.entity_variance(t.segment_cover, t.passes().run_down()).select("entity", "cell", r("variance"))


# queries on the 15 cells: everything, each status, each priority
def _query_cells(t: Tables):
    cells = t.spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    s, p = F.floor(F.col("cell") / 5).cast("int").cast("string"), (F.col("cell") % 5 + 1).cast("string")
    names = F.array(F.lit("total"), F.concat(F.lit("status_"), s), F.concat(F.lit("priority_"), p))
    return cells.select(F.explode(names).alias("query"), "cell", F.lit(1.0).alias("coef"))


_QC = ("qc", """SELECT unnest(['total', 'status_' || (cell // 5), 'priority_' || (cell % 5 + 1)]) AS query, cell FROM (SELECT unnest(range(15))::INT AS cell)""")
_NAT = ("nat", "SELECT f.geocode, q.query, sum(f.est) AS est, sqrt(sum(f.v)) AS sd FROM fin2 f JOIN qc q ON q.cell = f.cell GROUP BY 1, 2")
_Z05, _Z10 = intervals.normal_quantile(0.05), intervals.normal_quantile(0.1)


def _nation_answers(t: Tables):
    f = t.passes().run_down().final[2].select(
        F.col("geocode").alias("entity"), "cell", F.col("final_estimate").alias("estimate"), F.col("final_variance").alias("variance")
    )
    return intervals.query_answers(f, _query_cells(t))


@query("ci", sql(f"SELECT geocode, query, 0.05::DOUBLE AS alpha, {rs('est', 'estimate')}, {rs('sd', 'std_dev')}, round(sd * {_Z05!r}::DOUBLE, 6) AS moe FROM nat", _QC, _NAT))
def _(t):
    return intervals.with_moe(_nation_answers(t), [0.05]).select(F.col("entity").alias("geocode"), "query", "alpha", r("estimate"), r("std_dev"), r("moe"))


@query("ci_alphas", sql(f"""SELECT geocode, query, z.alpha, {rs('est', 'estimate')}, {rs('sd', 'std_dev')}, round(sd * z.z, 6) AS moe FROM nat
  CROSS JOIN (VALUES (0.05::DOUBLE, {_Z05!r}::DOUBLE), (0.1::DOUBLE, {_Z10!r}::DOUBLE)) z(alpha, z)""", _QC, _NAT))
def _(t):
    return intervals.with_moe(_nation_answers(t), [0.05, 0.1]).select(F.col("entity").alias("geocode"), "query", "alpha", r("estimate"), r("std_dev"), r("moe"))


@query("ci_integer", sql(f"""SELECT geocode, query, greatest(ceil(est - sd * {_Z10!r}::DOUBLE), 0)::BIGINT AS lower, greatest(floor(est + sd * {_Z10!r}::DOUBLE), 0)::BIGINT AS upper FROM nat""", _QC, _NAT))
def _(t):
    return intervals.integer_interval(intervals.with_moe(_nation_answers(t), [0.1])).select(F.col("entity").alias("geocode"), "query", "lower", "upper")


@query("ci_entities", sql(f"""SELECT e.entity, q.query, round(sum(e.est), 6) + 0.0 AS estimate, round(sqrt(sum(e.v)), 6) AS std_dev, round(sqrt(sum(e.v)) * {_Z10!r}::DOUBLE, 6) AS moe
  FROM ent e JOIN qc q ON q.cell = e.cell GROUP BY 1, 2""", _QC))
def _(t):
    p = t.passes().run_down()
    cells = entities.entity_estimate(t.segment_cover, p.estimates()).join(entities.entity_variance(t.segment_cover, p), ["entity", "cell"])
    out = intervals.with_moe(intervals.query_answers(cells, _query_cells(t)), [0.1])
    return out.select("entity", "query", r("estimate"), r("std_dev"), r("moe"))


@query("fuse_two_runs", sql("""SELECT a.geocode, a.cell, round((a.est / a.v + b.y / 3.0) / (1 / a.v + 1 / 3.0), 6) + 0.0 AS estimate, round(1 / (1 / a.v + 1 / 3.0), 6) + 0.0 AS variance
  FROM fin2 a JOIN (SELECT geocode, cell, CAST(n + (key * 7 + cell * 5) % 11 - 5 AS DOUBLE) AS y FROM true2) b ON b.geocode = a.geocode AND b.cell = a.cell"""))
def _(t):
    a = t.passes().run_down().final[2].select("geocode", "cell", F.col("final_estimate").alias("estimate"), F.col("final_variance").alias("variance"))
    b = t.true_counts(2).select(
        "geocode", "cell", (F.col("n") + (F.col("key") * 7 + F.col("cell") * 5) % 11 - 5).cast("double").alias("estimate"), F.lit(3.0).alias("variance")
    )
    return fuse.fuse_scalars(a, b, ["geocode", "cell"]).select("geocode", "cell", r("estimate"), r("variance"))
