"""Queries that go through files: readers, writers, codecs and the whole jobs."""

from __future__ import annotations

import uuid
from statistics import NormalDist

from pyspark.sql import functions as F

from stemtally.catalog.attributes import Attribute
from stemtally.catalog.schemas import Schema
from stemtally.functions.lineage import checkpoint_root
from stemtally.functions import matrices as mx
from stemtally.operators import intervals, marginalize as mg, workloads as wl
from stemtally.plans import interval_job as job
from stemtally.plans.fixtures import SPINE, Tables, sql
from stemtally.plans.queries_tabulation import _UNIT_ROWS
from stemtally.plans.queries_estimates import _NAT, _QC, _nation_answers, _Z10, r, rs
from stemtally.plans.registry import query
from stemtally.plans.two_pass import run_two_pass_estimate
from stemtally.sources import measurements as src, results as res


def scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/{uuid.uuid4().hex}/{name}"


def store(t: Tables) -> str:
    """The measured tree as a published input: one directory per level, names with their suffix; nations only as constraints."""
    root = scratch(t, "input")
    for d, level in enumerate(SPINE.names):
        m = t.arrays(d).filter("variance < double('infinity')").select("geocode", F.concat("query_name", F.lit("_dpq")).alias("query_name"), "value", "variance")
        m = m.unionByName(m.filter(F.col("geocode").startswith("1")))  # repeated rows, of which one counts
        if d == 2:
            m = m.filter(~t.bypassed(d))
        if level != "Region":
            m.write.parquet(src.level_path(root, level, src.MEASUREMENT_DIR))
        nodes = t.level(d).select(
            "geocode", F.lit("total_con").alias("query_name"), F.lit("=").alias("sign"), F.array(F.lit(1).cast("bigint")).alias("value"), F.lit("total").alias("part"),
        )
        nodes.write.parquet(src.level_path(root, level, src.CONSTRAINT_DIR))
    return root


@query("read_levels", sql("""SELECT depth, geocode, query_name, off AS bypassed, CASE WHEN off THEN NULL ELSE total END AS total FROM (
  SELECT 3 AS depth, geocode, 'detailed' AS query_name, any_value(v) IS NULL AS off, round(sum(est), 6) AS total FROM own3 GROUP BY 2
  UNION ALL SELECT 3, geocode, 'total', false, round(sum(est) + 3, 6) FROM own3 WHERE v IS NOT NULL GROUP BY 2
  UNION ALL SELECT 2, geocode, 'detailed', any_value(v) IS NULL, round(sum(est), 6) FROM own2 GROUP BY 2
  UNION ALL SELECT 2, geocode, 'total', false, round(sum(est) + 3, 6) FROM own2 WHERE v IS NOT NULL GROUP BY 2
  UNION ALL SELECT 1, geocode, 'detailed', true, NULL FROM own1 GROUP BY 2
  UNION ALL SELECT 0, geocode, 'detailed', false, round(sum(est), 6) FROM own0 GROUP BY 2
  UNION ALL SELECT 0, geocode, 'total', false, round(sum(est) + 3, 6) FROM own0 GROUP BY 2)"""))
def _(t: Tables):
    rows = src.read_levels(t.spark, store(t), SPINE, on_missing_level="bypass")
    total = F.when(F.col("variance") < float("inf"), F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 6))
    return rows.select("depth", "geocode", "query_name", (F.col("variance") == float("inf")).alias("bypassed"), total.alias("total"))


@query("state_roundtrip", sql("SELECT f.geocode, round(sum(f.est), 6) + 0.0 AS total FROM fin2 f WHERE geocode IN (SELECT substr(geocode, 1, 3) FROM leaf WHERE c_mktsegment = 'BUILDING') GROUP BY 1"))
def _(t):
    p = t.passes().run_down()
    base = scratch(t, "state")
    for d in (1, 2):
        res.write_table(p.final[d].select("geocode", "cell", "final_estimate"), f"{base}/{SPINE.names[d]}")
    keep = t.leaf.filter("c_mktsegment = 'BUILDING'").select(F.left("geocode", F.lit(3)).alias("geocode")).distinct()
    back = res.read_state(t.spark, [f"{base}/Region", f"{base}/Nation"], keep, partitions=4)
    return back.groupBy("geocode").agg((F.round(F.sum("final_estimate"), 6) + 0.0).alias("total"))


@query("intervals_roundtrip", sql(f"SELECT geocode, query, 0.1::DOUBLE AS alpha, {rs('est', 'estimate')}, {rs('sd', 'std_dev')}, round(sd * {_Z10!r}::DOUBLE, 6) AS moe FROM nat", _QC, _NAT))
def _(t):
    path = scratch(t, "intervals")
    res.write_intervals(intervals.with_moe(_nation_answers(t), [0.1]).withColumnRenamed("entity", "geocode"), path)
    return res.read_intervals(t.spark, path).select("geocode", "query", "alpha", r("estimate"), r("std_dev"), r("moe"))


@query("publish_partitioned", sql(f"SELECT substr(geocode, 1, 1) AS Region, substr(geocode, 2, 2) AS Nation, geocode, query, {rs('est', 'estimate')}, {rs('sd', 'std_dev')}, 'Orders: ' || query AS query_description, CAST(1 AS BIGINT) AS files FROM nat", _QC, _NAT))
def _(t):
    path = scratch(t, "published")
    rows = _nation_answers(t).select(F.col("entity").alias("geocode"), "query", "estimate", "std_dev", F.concat(F.lit("Orders: "), "query").alias("query_description"))
    levels = {"Region": (1, 1), "Nation": (2, 2)}
    res.publish(rows, path, levels)
    back = res.read_published(t.spark, path, list(levels)).withColumn("file", F.input_file_name())
    files = back.groupBy("Region", "Nation").agg(F.count_distinct("file").alias("files"))
    return back.join(files, ["Region", "Nation"]).select("Region", "Nation", "geocode", "query", r("estimate"), r("std_dev"), "query_description", "files")


@query("widths_roundtrip", sql("SELECT n.depth, ['Root', 'Region', 'Nation', 'Customer'][n.depth + 1] AS level, length(n.geocode)::INTEGER AS width, count(*) AS nodes FROM nodes n GROUP BY 1, 2, 3"))
def _(t):
    path = scratch(t, "widths")
    src.write_widths(t.spark, SPINE, path)
    s = src.read_widths(t.spark, path)
    named = t.spark.createDataFrame(list(zip(s.widths, s.names)), "width int, level string")
    return t.nodes.groupBy("depth", F.length("geocode").alias("width")).agg(F.count(F.lit(1)).alias("nodes")).join(named, "width").select("depth", "level", "width", "nodes")


@query("workload_file", _UNIT_ROWS)
def _(t):
    """Unit workload written as one pipe-separated file, read back, next to the parts of one brand per row."""
    path = scratch(t, "workload")
    src.write_workload(wl.published_rows(t.spark, "unit"), path)
    parts = t.read("part").groupBy(F.substring("p_brand", -1, 1).alias("d")).agg(F.count(F.lit(1)).alias("parts"))
    return src.read_workload(t.spark, path).withColumn("d", (F.col("row_num") % 5 + 1).cast("string")).join(parts, "d").drop("d")


@query("reference_file", sql("""SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '001' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '1' || '1001' AS leaf,
  CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '99999' END AS place FROM customer"""))
def _(t):
    path = scratch(t, "reference")
    c = t.read("customer")
    c.select(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("TABBLKST"), F.lit("001").alias("TABBLKCOU"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("TABTRACTCE"),
        F.lit("1").alias("TABBLKGRPCE"), F.lit("1001").alias("TABBLK"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("99999").alias("PLACEFP"),
    ).write.csv(path, sep="|", header=True)
    return src.read_reference_file(t.spark, path)


@query("roundtrip_packed_matrix", sql("""SELECT geocode, i.i AS row, j.j AS col, CAST(list_extract(v, (least(i.i, j.j) * 5 + greatest(i.i, j.j) + 1)::BIGINT) AS DOUBLE) AS value
  FROM (SELECT geocode, list(CAST(n AS DOUBLE) ORDER BY cell) || list(CAST(n AS DOUBLE) * 2 ORDER BY cell) AS v FROM true3 GROUP BY 1) CROSS JOIN (SELECT unnest(range(5))::INT AS i) i CROSS JOIN (SELECT unnest(range(5))::INT AS j) j"""))
def _(t):
    """A symmetric 5 x 5 matrix per customer, packed, stored, read and unpacked with expressions."""
    n = t.true_counts(3).groupBy("geocode").agg(F.array_sort(F.collect_list(F.struct("cell", F.col("n").cast("double").alias("n")))).alias("s"))
    v = n.select("geocode", F.concat(F.transform("s", lambda x: x["n"]), F.transform("s", lambda x: x["n"] * 2)).alias("v"))
    k = F.sequence(F.lit(0), F.lit(24))
    sym = F.transform(k, lambda x: F.get("v", (F.least(F.floor(x / 5), x % 5) * 5 + F.greatest(F.floor(x / 5), x % 5)).cast("int")))
    stored = res.write_table(v.select("geocode", mx.pack_expr(sym, 5).alias("packed")), scratch(t, "packed"))
    back = stored.select("geocode", F.posexplode(mx.unpack_expr(F.col("packed"), 5)).alias("k", "value"))
    return back.select("geocode", F.floor(F.col("k") / 5).cast("int").alias("row"), (F.col("k") % 5).alias("col"), "value")


ORDERS = Schema("orders", [Attribute("status", "", ["F", "O", "P"], {"finished": [("finished", [0]), ("other", [1, 2])]}), Attribute("priority", "", list("12345"))])
STATUSES = Schema("order statuses", [Attribute("status", "", ["F", "O", "P"])])
ALPHAS = (0.05, 0.1)


def store_run(t: Tables, root: str, arrays, skip: tuple[str, ...] = (), totals: bool = False, zeros: bool = False) -> str:
    """An input of the estimation: ``arrays(depth)`` and, as constraints, true totals and rows that must be zero."""
    for d, level in enumerate(SPINE.names):
        m = arrays(d).select("geocode", F.concat("query_name", F.lit("_dpq")).alias("query_name"), "value", "variance")
        if level not in skip:
            m.write.parquet(src.level_path(root, level, src.MEASUREMENT_DIR))
        n = t.true_counts(d).groupBy("geocode").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("s"))
        con = n.select("geocode", F.lit("total_con").alias("query_name"), F.lit("=").alias("sign"), F.array(F.col("total") if totals else F.lit(1).cast("bigint")).alias("value"), F.lit("total").alias("part"))
        if zeros:  # cells without orders: their upper bound is zero
            con = con.unionByName(n.select("geocode", F.lit("cells_ub_con").alias("query_name"), F.lit("<=").alias("sign"), F.transform("s", lambda x: x["n"]).alias("value"), F.lit("detailed").alias("part")))
        con.write.parquet(src.level_path(root, level, src.CONSTRAINT_DIR))
    return root


def _ask_orders(s: Schema, marginal: str) -> tuple[list, list[str]]:
    """The total and the statuses, restated over the cells of a marginal."""
    target = s.query(marginal)
    return [mg.rows_on_marginal(s.query(n), target) for n in ("total", "status")], ["total", "status_0", "status_1", "status_2"]


def _intervals_sql(relation: str) -> str:
    z = [NormalDist().inv_cdf(1 - a / 2) for a in ALPHAS]
    one = "SELECT entity AS geocode, query, {a}::DOUBLE AS alpha, {e}, {s}, round(sqrt(v) * {z!r}::DOUBLE, 6) + 0.0 AS moe FROM {r}"
    return sql(" UNION ALL ".join(one.format(a=a, e=rs("est", "estimate"), s=rs("sqrt(v)", "std_dev"), z=x, r=relation) for a, x in zip(ALPHAS, z)), _FUSED)


def _rounded(rows):
    return rows.select("geocode", "query", "alpha", r("estimate"), r("std_dev"), r("moe"))


# both runs fused scalar by scalar: the total, and the statuses' deviations from their mean
_FUSED = ("askF", """WITH d AS (SELECT a.entity, a.query, a.est - t.est / 3 AS e, (a.v - t.v / 9) * 1.5 AS v FROM askS a JOIN askS t ON t.entity = a.entity AND t.query = 'total' WHERE a.query <> 'total'),
  b AS (SELECT a.entity, a.query, a.est - t.est / 3 AS e, (a.v - t.v / 9) * 1.5 AS v FROM askB a JOIN askB t ON t.entity = a.entity AND t.query = 'total' WHERE a.query <> 'total'),
  t AS (SELECT a.entity, CASE WHEN isinf(a.v) OR isinf(b.v) THEN a.est ELSE (a.est / a.v + b.est / b.v) / (1 / a.v + 1 / b.v) END AS est, CASE WHEN isinf(a.v) OR isinf(b.v) THEN a.v ELSE 1 / (1 / a.v + 1 / b.v) END AS v
    FROM askS a JOIN askB b ON a.entity = b.entity AND a.query = b.query WHERE a.query = 'total')
  SELECT entity, 'total' AS query, est, v FROM t UNION ALL
  SELECT d.entity, d.query, t.est / 3 + CASE WHEN isinf(t.v) THEN d.e ELSE (d.e / d.v + b.e / b.v) / (1 / d.v + 1 / b.v) END, CASE WHEN isinf(t.v) THEN t.v ELSE t.v / 9 + (2.0 / 3) / (1 / d.v + 1 / b.v) END
  FROM d JOIN b ON b.entity = d.entity AND b.query = d.query JOIN t ON t.entity = d.entity""")


@query("two_pass_job", _intervals_sql("askJ"))
def _(t):
    """The whole job from files: a marginal histogram, an exact total at the root, a missing level; intervals of segments within regions."""
    root = store_run(t, scratch(t, "input"), t.arrays, skip=("Region",), totals=True)
    passes = run_two_pass_estimate(t.spark, root, SPINE, ORDERS, scratch(t, "run"), "status", total_levels=("Root",), on_missing_level="bypass")
    asked, names = _ask_orders(ORDERS, "status")
    return _rounded(job.estimate_intervals({"Part": t.part_cover}, passes, asked, names, ALPHAS, scratch(t, "job"))["Part"])


@query("masked_job", sql(f"SELECT depth, geocode, cell, {rs('est', 'estimate')} FROM finM"))
def _(t):
    """The whole job with cells held at zero above the leaves, from constraints on the detailed query."""
    root = store_run(t, scratch(t, "input"), lambda d: t.arrays(d).filter("query_name = 'detailed'"), zeros=True)
    passes = run_two_pass_estimate(t.spark, root, SPINE, ORDERS, scratch(t, "run"))
    return passes.estimates().select("depth", "geocode", "cell", r("final_estimate", "estimate"))


@query("resumed_run", _intervals_sql("askS"))
def _(t):
    """A run that stops half-way up, goes on from its files, and is opened again by the interval job from its path alone."""
    root, out = store_run(t, scratch(t, "input"), t.arrays), scratch(t, "run")
    if run_two_pass_estimate(t.spark, root, SPINE, ORDERS, out, until="up_2") is not None:
        raise AssertionError("the run did not stop")
    run_two_pass_estimate(t.spark, root, SPINE, ORDERS, out)
    asked, names = _ask_orders(ORDERS, "detailed")
    return _rounded(job.stored_intervals(t.spark, out, {"Part": t.part_cover}, asked, names, ALPHAS, scratch(t, "job"))["Part"])


@query("fused_stored_runs", _intervals_sql("askF"))
def _(t):
    """Two stored runs over different histograms, fused on what both know: the three statuses."""
    first, second = scratch(t, "first"), scratch(t, "second")
    run_two_pass_estimate(t.spark, store_run(t, scratch(t, "input"), t.arrays), SPINE, ORDERS, first)
    run_two_pass_estimate(t.spark, store_run(t, scratch(t, "input"), t.second_arrays), SPINE, STATUSES, second)
    asked, names = _ask_orders(ORDERS, "detailed")
    cover, shared = {"Part": t.part_cover}, job.projection_query(ORDERS, "status", "detailed")
    done = job.stored_intervals(t.spark, first, cover, asked, names, ALPHAS, scratch(t, "job"), second, cover, shared, STATUSES.query("detailed"))
    return _rounded(done["Part"])
