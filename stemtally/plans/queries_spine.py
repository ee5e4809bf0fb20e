"""Queries on the tree and on entities that are not nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemtally.operators import covers, spine as sp
from stemtally.plans.fixtures import SPINE, Tables, sql
from stemtally.plans.registry import query


@query("spine_nodes", sql("SELECT depth, geocode, CASE depth WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN substr(geocode, 1, 1) ELSE substr(geocode, 1, 3) END AS parent FROM nodes"))
def _(t: Tables):
    return t.nodes.select(
        "depth", "geocode",
        F.when(F.col("depth") == 1, "").when(F.col("depth") == 2, F.substring("geocode", 1, 1)).when(F.col("depth") == 3, F.substring("geocode", 1, 3)).alias("parent"),
    )


@query("spine_fanout", sql("SELECT l.geocode, substr(l.geocode, 1, 3) AS parent, f.n AS num_siblings FROM leaf l JOIN (SELECT substr(geocode, 1, 3) AS parent, count(*) AS n FROM leaf GROUP BY 1) f ON f.parent = substr(l.geocode, 1, 3)"))
def _(t):
    return sp.with_num_siblings(t.leaf.select("geocode"), 3).select("geocode", "parent", "num_siblings")


@query("spine_missing_nodes", sql("SELECT geocode, 'detailed' AS query_name, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = key) AS bypassed, (SELECT count(*) FROM orders WHERE o_custkey = key) AS total FROM leaf"))
def _(t):
    seen = t.order_cells.groupBy("key").agg(F.sum("n").alias("n")).join(t.leaf, "key").select(
        "geocode", F.lit("detailed").alias("query_name"), F.array(F.col("n").cast("double")).alias("value"), F.lit(4.0).alias("variance")
    )
    return sp.complete_nodes(seen, sp.level_inventory(t.leaf)).select(
        "geocode", "query_name", (F.col("variance") == float("inf")).alias("bypassed"),
        F.coalesce(F.get("value", F.lit(0)), F.lit(0.0)).cast("bigint").alias("total"),
    )


@query("bypassed_level", sql("SELECT geocode, 'detailed____' AS query_name, true AS unmeasured FROM nodes WHERE depth = 2"))
def _(t):
    return sp.bypassed_measurements(sp.level_inventory(t.level(2)), suffix_len=4).select(
        "geocode", "query_name", (F.col("value").isNull() & (F.col("variance") == float("inf"))).alias("unmeasured")
    )


@query("measurement_rows_resolved", sql("""SELECT substr(geocode, 1, 3) AS geocode, leaf.c_mktsegment AS query_name, min(c_acctbal) AS value FROM leaf JOIN customer ON c_custkey = key GROUP BY 1, 2"""))
def _(t):
    rows = t.leaf.join(t.read("customer").select(F.col("c_custkey").alias("key"), "c_acctbal"), "key").select(
        F.substring("geocode", 1, 3).alias("geocode"), F.concat("c_mktsegment", F.lit("_dpq")).alias("query_name"),
        F.array("c_acctbal").alias("value"), F.lit(2.0).alias("variance"),
    )
    named = rows.withColumn("query_name", sp.strip_suffix("query_name", 4))
    return sp.one_measurement_per_query(named).select("geocode", "query_name", F.get("value", F.lit(0)).alias("value"))


_CONSTRAINED = """SELECT geocode, query_name, kind, total FROM (
  SELECT substr(geocode, 1, 3) AS geocode, c_mktsegment AS query_name, 'measurement' AS kind, count(*) AS total, max(n_acc) AS m FROM (
    SELECT l.geocode, l.c_mktsegment, count(*) OVER (PARTITION BY substr(l.geocode, 1, 3)) AS n_acc FROM leaf l) GROUP BY 1, 2
  UNION ALL SELECT substr(geocode, 1, 3), 'BUILDING', 'constraint', count(*), 0 FROM leaf WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
  WHERE geocode IN (SELECT substr(geocode, 1, 3) FROM leaf WHERE c_mktsegment = 'BUILDING') AND NOT (kind = 'measurement' AND query_name = 'BUILDING')"""


@query("attach_constraints", sql(_CONSTRAINED))
def _(t):
    per = t.leaf.groupBy(F.substring("geocode", 1, 3).alias("geocode"), F.col("c_mktsegment").alias("query_name")).agg(F.count(F.lit(1)).alias("n"))
    m = per.select("geocode", "query_name", F.array(F.col("n").cast("double")).alias("value"), F.lit(2.0).alias("variance"))
    out = sp.attach_constraints(m, m.filter("query_name = 'BUILDING'"), overwrite=True)
    return out.select("geocode", "query_name", "kind", F.get("value", F.lit(0)).cast("bigint").alias("total"))


@query("representative_leaf", sql("SELECT min(geocode) AS geocode FROM (SELECT geocode, lag(geocode) OVER (PARTITION BY substr(geocode, 1, 3) ORDER BY geocode) AS p FROM leaf) WHERE p IS NOT NULL"))
def _(t):
    return sp.representative_leaf(t.leaf, 3)


@query("ancestors", sql("""SELECT geocode, 0 AS depth, '' AS ancestor FROM leaf UNION ALL SELECT geocode, 1, substr(geocode, 1, 1) FROM leaf
  UNION ALL SELECT geocode, 2, substr(geocode, 1, 3) FROM leaf UNION ALL SELECT geocode, 3, geocode FROM leaf"""))
def _(t):
    return sp.ancestors(t.leaf.select("geocode"), list(SPINE.widths))


@query("shortest_path", sql("""SELECT a, b, CASE WHEN a = b THEN a WHEN substr(a, 1, 3) = substr(b, 1, 3) THEN a || '/' || substr(a, 1, 3) || '/' || b
  WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN concat_ws('/', a, substr(a, 1, 3), substr(a, 1, 1), substr(b, 1, 3), b)
  ELSE concat_ws('/', a, substr(a, 1, 3), substr(a, 1, 1), '', substr(b, 1, 1), substr(b, 1, 3), b) END AS path
  FROM (SELECT x.geocode AS a, y.geocode AS b FROM leaf x JOIN leaf y ON y.key = (x.key * 7) // 5)"""))
def _(t):
    a = t.leaf.select(F.col("geocode").alias("a"), F.floor(F.col("key") * 7 / 5).cast("bigint").alias("k"))
    pairs = a.join(t.leaf.select(F.col("geocode").alias("b"), F.col("key").alias("k")), "k").select("a", "b")
    return covers.shortest_path(pairs, SPINE).select("a", "b", F.array_join("path", "/").alias("path"))


@query("path_closure", sql("""SELECT entity, node AS geocode, bool_or(node = geocode) AS in_cover FROM (
  SELECT c.entity, c.geocode, unnest(list_filter([0, 1, 3, 13], lambda w: w <= length(c.geocode))) AS w, substr(c.geocode, 1, w) AS node FROM cover c) GROUP BY 1, 2"""))
def _(t):
    return covers.path_closure(t.segment_cover, SPINE)


@query("coarsest_cover_segment", sql("SELECT entity, depth, geocode FROM cover"))
def _(t):
    return t.segment_cover


@query("tabulation_crosswalk", sql("""SELECT geocode AS leaf, unnest(['Root', 'Region', 'Nation', 'Customer']) AS entity_level,
  unnest(['', substr(geocode, 1, 1), substr(geocode, 1, 3), geocode]) AS entity FROM leaf"""))
def _(t):
    return covers.tabulation_crosswalk(t.leaf, dict(zip(SPINE.names, SPINE.widths)))


@query("cover_with_sentinel", sql("""SELECT s.lo AS entity, s.depth, s.node AS geocode FROM estat s LEFT JOIN estat p ON p.depth = s.depth - 1
  AND p.node = substr(s.node, 1, CASE s.depth WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END)
  WHERE s.lo = s.hi AND (s.depth = 0 OR p.lo <> p.hi) AND s.lo <> '99999'""",
    ("eleaf", """SELECT geocode, CASE WHEN geocode LIKE '1%' THEN 'AMERICA' WHEN c_acctbal > 5000 THEN c.c_mktsegment ELSE '99999' END AS e FROM leaf JOIN customer c ON c.c_custkey = key"""),
    ("estat", """SELECT x.depth AS depth, x.node AS node, min(e) AS lo, max(e) AS hi FROM (SELECT e, unnest([{'depth': 0, 'node': ''}, {'depth': 1, 'node': substr(geocode, 1, 1)},
      {'depth': 2, 'node': substr(geocode, 1, 3)}, {'depth': 3, 'node': geocode}]) AS x FROM eleaf) GROUP BY 1, 2""")))
def _(t):
    joined = t.leaf.join(t.read("customer").select(F.col("c_custkey").alias("key"), "c_acctbal"), "key")
    inside = joined.filter("geocode like '1%' or c_acctbal > 5000").select(
        F.col("geocode").alias("leaf"), F.when(F.col("geocode").like("1%"), "AMERICA").otherwise(F.col("c_mktsegment")).alias("entity")
    )
    return covers.coarsest_cover(covers.entity_crosswalk(t.leaf, inside), SPINE, sentinel=covers.OUTSIDE)


@query("custom_cover", sql("""SELECT 'leaf' AS kind, right(geocode, 16) AS entity, geocode FROM leaf UNION ALL SELECT 'flagged', substr(geocode, 2), geocode FROM nodes WHERE depth = 2
  UNION ALL SELECT 'root', '', '' FROM nodes WHERE depth = 0"""))
def _(t):
    parts = [covers.custom_cover(t.level(d), k).select(F.lit(k).alias("kind"), "entity", "geocode") for k, d in (("leaf", 3), ("flagged", 2), ("root", 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("remap_nodes", sql("""SELECT l.key, coalesce(m.n, l.geocode) AS geocode FROM leaf l LEFT JOIN (
  SELECT geocode AS o, 'X' || substr(geocode, 2) AS n FROM leaf JOIN customer ON c_custkey = key WHERE c_acctbal < -900) m ON m.o = l.geocode"""))
def _(t):
    moved = t.leaf.join(t.read("customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("key")), "key").select(
        F.col("geocode").alias("old"), F.concat(F.lit("X"), F.expr("substring(geocode, 2)")).alias("new")
    )
    return covers.remap(t.leaf.select("key", "geocode"), moved).select("key", "geocode")


@query("surrogate_rank", sql("SELECT geocode, row_number() OVER (ORDER BY geocode) - 1 AS rank FROM leaf"))
def _(t):
    return sp.surrogate_rank(t.leaf)


@query("hierarchical_join", sql("SELECT l.geocode, substr(l.geocode, 1, 3) AS parent, p.n AS parent_orders FROM leaf l JOIN (SELECT geocode, sum(n)::BIGINT AS n FROM true2 GROUP BY 1) p ON p.geocode = substr(l.geocode, 1, 3)"))
def _(t):
    parents = t.true_counts(2).groupBy("geocode").agg(F.sum("n").alias("parent_orders"))
    return sp.hierarchical_join(parents, t.leaf.select("geocode"), 3, 13).select("geocode", "parent", "parent_orders")


@query("even_partitions", sql("SELECT geocode, c_mktsegment FROM leaf"))
def _(t):
    return sp.even_partitions(t.leaf.select("geocode", "c_mktsegment"), 100)
