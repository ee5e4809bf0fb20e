"""Queries on tabulations, workloads, constraints and coarsenings."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import functions as F

from stemtally.catalog import schemas as sc
from stemtally.operators import constraints as ct, marginalize as mg, tabulate as tab, workloads as wl
from stemtally.plans.fixtures import SHAPE, SPINE, Tables, order_cell, sql
from stemtally.plans.registry import query

# groups of the five priorities and three statuses used below
URGENT = [[0, 1], [2, 3, 4]]
OPEN = [[1, 2]]
PREFIX = [list(range(k + 1)) for k in range(5)]
RANGES = [list(range(a, b + 1)) for b in range(5) for a in range(b + 1)]
SPLITS = [list(range(s, min(s + w, 5))) for w in (5, 3, 2, 1) for s in range(0, 5, w)]


def cells(t: Tables):
    """(nation, cell, n) of all orders, nation being the customer's geocode prefix."""
    keyed = t.leaf.select("key", F.left("geocode", F.lit(3)).alias("nation"))
    return t.order_cells.join(keyed, "key").groupBy("nation", "cell").agg(F.sum("n").alias("n"))


_CELLS = ("cells", "SELECT substr(l.geocode, 1, 3) AS nation, o.cell, CAST(sum(o.n) AS BIGINT) AS n FROM ordcell o JOIN leaf l ON l.key = o.key GROUP BY 1, 2")
_ROWS = ("micro", """SELECT substr(l.geocode, 1, 3) AS nation, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS s,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS p FROM orders JOIN leaf l ON l.key = o_custkey""")


@query("marginal_total", sql("SELECT nation, CAST(0 AS BIGINT) AS row_ix, count(*) AS n FROM micro GROUP BY 1", _ROWS))
def _(t: Tables):
    return tab.answer(cells(t), tab.tabular_query("total", SHAPE, {}, [0, 1]), ["nation"])


@query("marginal_detailed_zero_filled", sql("SELECT geocode, CAST(cell AS BIGINT) AS row_ix, n FROM true3"))
def _(t):
    keyed = t.order_cells.join(t.leaf.select("key", "geocode"), "key")
    return tab.zero_fill(tab.answer(keyed, tab.tabular_query("detailed", SHAPE), ["geocode"]), t.leaf, 15, "geocode")


@query("marginal_cross", sql("SELECT nation, CAST(p AS BIGINT) AS row_ix, count(*) AS n FROM micro GROUP BY 1, 2", _ROWS))
def _(t):
    return tab.answer(cells(t), tab.tabular_query("priority", SHAPE, {}, [0]), ["nation"])


@query("crossed_query", sql("SELECT nation, CAST((s - 1) * 0 + (CASE WHEN p < 2 THEN 0 ELSE 1 END) AS BIGINT) AS row_ix, count(*) AS n FROM micro WHERE s > 0 GROUP BY 1, 2", _ROWS))
def _(t):
    return tab.answer(cells(t), tab.tabular_query("open * urgent", SHAPE, {0: OPEN, 1: URGENT}), ["nation"])


@query("nway_marginals", sql("""SELECT CASE WHEN gs = 0 AND gp = 0 AND gn = 0 THEN 'detailed' WHEN gs = 1 AND gp = 1 AND gn = 1 THEN 'total'
  ELSE concat_ws(' * ', CASE WHEN gn = 0 THEN 'nation' END, CASE WHEN gs = 0 THEN 'status' END, CASE WHEN gp = 0 THEN 'priority' END) END AS query,
  CAST(3 - gs - gp - gn AS INTEGER) AS ways, nation, status, priority, n FROM (SELECT nation, s AS status, p AS priority, count(*) AS n, grouping(nation) AS gn, grouping(s) AS gs, grouping(p) AS gp
  FROM micro GROUP BY GROUPING SETS ((nation, s, p), (nation, s), (nation, p), (s, p), (nation), (s), (p), ()))""", _ROWS))
def _(t):
    rows = cells(t).select("nation", F.floor(F.col("cell") / 5).cast("int").alias("status"), (F.col("cell") % 5).alias("priority"), "n")
    return tab.marginals(rows, ["nation", "status", "priority"], [0, 1, 2, 3]).select("query", "ways", "nation", "status", "priority", "n")


@query("recode_grouped", sql("SELECT nation, CAST(s * 2 + (CASE WHEN p < 2 THEN 0 ELSE 1 END) AS BIGINT) AS row_ix, count(*) AS n FROM micro GROUP BY 1, 2", _ROWS))
def _(t):
    return tab.answer(cells(t), tab.tabular_query("urgent", SHAPE, {1: URGENT}), ["nation"])


@query("recode_subset", sql("SELECT nation, CAST(CASE p WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS row_ix, count(*) AS n FROM micro WHERE s IN (0, 2) AND p IN (1, 4) GROUP BY 1, 2", _ROWS))
def _(t):
    return tab.answer(cells(t), tab.subset_query("some", SHAPE, {0: [0, 2], 1: [4, 1]}, margins=[0]), ["nation"])


def _overlap(name, groups):
    values = ", ".join(f"({r}, {i})" for r, g in enumerate(groups) for i in g)

    @query(name, sql(f"SELECT nation, CAST(g.r AS BIGINT) AS row_ix, count(*) AS n FROM micro JOIN (VALUES {values}) g(r, p) ON g.p = micro.p GROUP BY 1, 2", _ROWS))
    def _(t):
        return tab.answer(cells(t), tab.tabular_query(name, SHAPE, {1: groups}, [0]), ["nation"])


_overlap("recode_overlapping_prefix", PREFIX)
_overlap("recode_overlapping_range", RANGES)
_overlap("binary_split", SPLITS)
W1, W2 = [[1, -1, 0], [0.5, 0.5, 0.25]], [[1, 2, 3, 4, 5], [0, 0, 1, 0, -2]]


@query("kron_weighted", sql("""SELECT nation, CAST(a.r * 2 + b.r AS BIGINT) AS row_ix, sum(a.c * b.c) AS n FROM micro
  JOIN (VALUES (0, 0, 1.0::DOUBLE), (0, 1, -1.0), (1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.25)) a(r, s, c) ON a.s = micro.s
  JOIN (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0), (0, 2, 3.0), (0, 3, 4.0), (0, 4, 5.0), (1, 2, 1.0), (1, 4, -2.0)) b(r, p, c) ON b.p = micro.p GROUP BY 1, 2""", _ROWS))
def _(t):
    return tab.answer(cells(t), tab.kron_query("w", [W1, W2]), ["nation"])


@query("predicate_and_complement", sql("SELECT nation, CAST(CASE WHEN s = 0 AND p < 3 THEN 0 ELSE 1 END AS BIGINT) AS row_ix, count(*) AS n FROM micro GROUP BY 1, 2", _ROWS))
def _(t):
    return tab.predicate_counts(cells(t), (F.col("cell") < 5) & (F.col("cell") % 5 < 3), ["nation"])


@query("multi_histogram", sql("""SELECT nation, row_ix, sum(n) AS n FROM (SELECT nation, CAST(s AS BIGINT) AS row_ix, 2.0::DOUBLE * count(*) AS n FROM micro GROUP BY 1, 2
  UNION ALL SELECT substr(l.geocode, 1, 3), CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT), -0.5::DOUBLE * count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN leaf l ON l.key = o_custkey GROUP BY 1, 2) GROUP BY 1, 2""", _ROWS))
def _(t):
    a = tab.answer(cells(t), tab.tabular_query("status", SHAPE, {}, [1]), ["nation"])
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("bigint")
    per_order = t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), flag.alias("row_ix")).agg(F.count(F.lit(1)).alias("n"))
    b = (
        per_order.join(t.read("orders").select("o_orderkey", F.col("o_custkey").alias("key")), "o_orderkey")
        .join(t.leaf.select("key", F.left("geocode", F.lit(3)).alias("nation")), "key").groupBy("nation", "row_ix").agg(F.sum("n").alias("n"))
    )
    return tab.multi_histogram([a, b], [2.0, -0.5], ["nation"])


def _matrices(t):
    status = tab.query_cell(t.spark, tab.tabular_query("status", SHAPE, {}, [1]))
    urgent = tab.query_cell(t.spark, tab.tabular_query("urgent", SHAPE, {1: URGENT}, [0]))
    return status, urgent


@query("stacked", sql("""SELECT nation, row_ix, CAST(count(*) AS DOUBLE) AS n FROM (SELECT nation, CAST(s AS BIGINT) AS row_ix, s FROM micro UNION ALL
  SELECT nation, CAST(3 + CASE WHEN p < 2 THEN 0 ELSE 1 END AS BIGINT), s FROM micro) WHERE s < 2 GROUP BY 1, 2""", _ROWS))
def _(t):
    status, urgent = _matrices(t)
    domain = t.order_cells.select("cell").distinct().filter("cell < 10")
    m = tab.stacked("both", [(status, 3), (urgent, 2)], domain)
    return tab.answer_by_matrix(cells(t), m, ["nation"]).drop("query")


@query("combo", sql("""SELECT nation, row_ix, sum(n) AS n FROM (SELECT nation, CAST(CASE WHEN p < 2 THEN 0 ELSE 1 END AS BIGINT) AS row_ix, 3.0::DOUBLE AS n FROM micro
  UNION ALL SELECT nation, CAST(s AS BIGINT), -1.0 FROM micro WHERE s < 2) GROUP BY 1, 2""", _ROWS))
def _(t):
    status, urgent = _matrices(t)
    m = tab.combination("mix", [urgent, status.filter("row_ix < 2")], [3.0, -1.0])
    return tab.answer_by_matrix(cells(t), m, ["nation"]).drop("query")


@query("stub", sql("SELECT nation, CAST(r AS BIGINT) AS row_ix, count(*)::DOUBLE AS n FROM micro CROSS JOIN range(3) x(r) WHERE s = r GROUP BY 1, 2", _ROWS))
def _(t):
    zero = tab.stub_query(t.spark, "stub", 3)
    every = cells(t).select("nation").distinct().withColumn("row_ix", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)]))).join(zero, "row_ix").select("nation", "row_ix", "n")
    a = tab.answer(cells(t), tab.tabular_query("status", SHAPE, {}, [1]), ["nation"])
    return tab.multi_histogram([a, every], [1.0, 1.0], ["nation"])


# partsupp-like relation from the data: brands group part sizes
_BRAND = ("brand", "SELECT DISTINCT p_brand AS grp, p_size AS member FROM part")


def _brand_matrix(t):
    return t.read("part").select(F.lit("brand").alias("query"), F.expr("cast(substring(p_brand, 7) as bigint)").alias("row_ix"), F.col("p_size").cast("bigint").alias("cell")).groupBy("query", "row_ix", "cell").agg(F.count(F.lit(1)).cast("double").alias("coef"))


_BM = ("bm", "SELECT 'brand' AS query, CAST(substr(p_brand, 7) AS BIGINT) AS row_ix, CAST(p_size AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS coef FROM part GROUP BY 1, 2, 3")


@query("sparse_overlap_check", sql("SELECT query, cell, count(*) AS rows FROM bm GROUP BY 1, 2 HAVING count(*) > 1", _BM))
def _(t):
    return tab.overlap_check(_brand_matrix(t))


@query("sensitivity_audit", sql("SELECT 'brand' AS query, max(s) AS l1, CASE WHEN max(s) = 1 THEN 1.0::DOUBLE END AS l2, true AS is_integer FROM (SELECT cell, sum(coef) AS s FROM bm GROUP BY 1)", _BM))
def _(t):
    return tab.sensitivity(_brand_matrix(t))


@query("query_equality", sql("""SELECT row_ix, cell, coef FROM (SELECT * EXCLUDE query FROM bm EXCEPT ALL SELECT row_ix, cell, coef FROM bm2)
  UNION ALL SELECT row_ix, cell, coef FROM (SELECT row_ix, cell, coef FROM bm2 EXCEPT ALL SELECT * EXCLUDE query FROM bm)""", _BM,
    ("bm2", "SELECT CAST(substr(p_brand, 7) AS BIGINT) AS row_ix, CAST(p_size AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS coef FROM part WHERE p_retailprice > 920 GROUP BY 1, 2")))
def _(t):
    other = t.read("part").filter("p_retailprice > 920").groupBy(F.expr("cast(substring(p_brand, 7) as bigint)").alias("row_ix"), F.col("p_size").cast("bigint").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("coef"))
    return tab.query_differences(_brand_matrix(t), other)


@query("query_cells", sql("""SELECT nation, CAST(CASE WHEN s = 0 THEN 0 ELSE 1 END * 5 + p AS BIGINT) AS row_ix, count(*)::DOUBLE AS n FROM micro GROUP BY 1, 2""", _ROWS))
def _(t):
    m = tab.check_dimension(tab.query_cell(t.spark, tab.tabular_query("q", SHAPE, {0: [[0], [1, 2]]})), 15)
    return tab.answer_by_matrix(cells(t), m, ["nation"]).drop("query")


@query("query_shape", sql("SELECT nation, CAST(s * 2 + (CASE WHEN p < 2 THEN 0 ELSE 1 END) AS BIGINT) AS row_ix, s AS status, CASE WHEN p < 2 THEN 0 ELSE 1 END AS urgent, count(*) AS n FROM micro GROUP BY ALL", _ROWS))
def _(t):
    q = tab.tabular_query("urgent", SHAPE, {1: URGENT})
    return tab.with_row_levels(tab.answer(cells(t), q, ["nation"]), q, ["status", "urgent"])


# ---- workloads over a person-like histogram of the line items --------------------------------

PL94 = sc.schema("PL94_SCHEMA")
_PERSON = ("person", """SELECT s_nationkey AS nation, l_suppkey % 8 AS hhgq, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS vote, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS hisp,
  l_partkey % 63 AS race FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")


def person_cells(t: Tables):
    cell = ((F.col("l_suppkey") % 8 * 2 + (F.col("l_quantity") > 25).cast("int")) * 2 + (F.col("l_linestatus") == "O").cast("int")) * 63 + F.col("l_partkey") % 63
    per = t.read("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return per.join(t.read("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), "s_suppkey").groupBy("nation", "cell").agg(F.sum("n").alias("n"))


@lru_cache
def _workload_sql() -> str:
    """One conditional count per query, written from the predicates themselves."""
    cols = []
    for name, p in wl.redistricting_predicates():
        test = p.replace("voting_age in", "lpad(CAST(vote + 1 AS VARCHAR), 1, '0') in").replace("hispanic in", "CAST(hisp + 1 AS VARCHAR) in")
        test = test.replace("cenrace in", "lpad(CAST(race + 1 AS VARCHAR), 2, '0') in").replace("hhgq in", "CAST(hhgq AS VARCHAR) in")
        cols.append(f"count(*) FILTER (WHERE {test or 'true'}) AS {name}")
    return sql(f"SELECT nation, query, CAST(n AS DOUBLE) AS n FROM (UNPIVOT (SELECT nation, {', '.join(cols)} FROM person GROUP BY 1) ON COLUMNS(* EXCLUDE nation) INTO NAME query VALUE n) WHERE n > 0", _PERSON)


@query("workload_answers", _workload_sql())
def _(t):
    w = wl.redistricting_workload(t.spark)
    m = wl.workload_cells(w, wl.parse_predicates(w), PL94)
    return m.join(person_cells(t), "cell").groupBy("nation", "query").agg(F.sum(F.col("coef") * F.col("n")).alias("n"))


@query("workload_parse", sql("""SELECT race AS code, CAST(count(*) AS BIGINT) AS queries, CAST(max(n) AS BIGINT) AS persons FROM (SELECT race FROM (SELECT DISTINCT race FROM person) JOIN LATERAL (
  SELECT query FROM wl WHERE list_contains(levels, race)) ON true) q JOIN (SELECT race AS r, count(*) AS n FROM person GROUP BY 1) ON r = race GROUP BY 1""", _PERSON,
    ("wl", "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', [{', '.join(str(int(c) - 1) for c in p.split('cenrace in (')[1].replace(')', '').replace(chr(39), '').split(', '))}])" for n, p in wl.redistricting_predicates() if "cenrace" in p
    ) + ") x(query, levels)")))
def _(t):
    parsed = wl.parse_predicates(wl.redistricting_workload(t.spark)).filter("attr = 'cenrace'").select("query", F.explode("levels").alias("code"))
    persons = person_cells(t).groupBy((F.col("cell") % 63).alias("code")).agg(F.sum("n").alias("persons"))
    return parsed.groupBy("code").agg(F.count(F.lit(1)).alias("queries")).join(persons, "code").select(F.col("code").cast("bigint").alias("code"), "queries", "persons")


@query("interval_codes", sql("SELECT p_size AS lo, list_transform(range(greatest(p_size, 1), least(p_size * 3, 63) + 1), lambda i: lpad(CAST(i AS VARCHAR), 2, '0')).array_to_string(',') AS codes, count(*) AS parts FROM part GROUP BY 1, 2"))
def _(t):
    return t.read("part").groupBy(F.col("p_size").alias("lo")).agg(F.count(F.lit(1)).alias("parts")).select(
        "lo", F.array_join(wl.interval_codes(F.col("lo"), F.col("lo") * 3), ",").alias("codes"), "parts"
    )


# a DHC person histogram: relationship, sex, age, origin, race from the line items
DHCP = sc.schema("DHCP_SCHEMA")


def dhcp_cells(t: Tables):
    age = F.col("l_partkey") % 116
    rel = F.col("l_orderkey") % 42
    cell = (((rel * 2 + (F.col("l_linestatus") == "O").cast("int")) * 116 + age) * 2 + (F.col("l_returnflag") == "R").cast("int")) * 63 + F.col("l_suppkey") % 63
    return t.read("lineitem").groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


_DHCP = ("dhcp", """SELECT l_orderkey % 42 AS rel, CASE l_linestatus WHEN 'O' THEN 'Female' ELSE 'Male' END AS sex, l_partkey % 116 AS age,
  CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS hisp, l_suppkey % 63 AS race FROM lineitem""")
_CHILD = "CASE WHEN age < 3 THEN 'Under 3 years' WHEN age < 5 THEN '3 and 4 years' WHEN age = 5 THEN '5 years' WHEN age < 12 THEN '6 to 11 years' WHEN age < 14 THEN '12 and 13 years' WHEN age = 14 THEN '14 years' ELSE '15 to 17 years' END"
_INST = "CASE WHEN rel < 18 THEN 'Household' WHEN rel < 33 THEN 'Institutional Facility' ELSE 'Non-Institutional Facility' END"
_HH4 = "CASE WHEN rel < 6 THEN 'Householder, spouse, or unmarried partner' WHEN rel < 9 THEN 'Own Child' WHEN rel < 18 THEN 'Other Children' ELSE 'In Group Quarters' END"
_AGE12 = "CASE WHEN age = 0 THEN 'Under 1 year' WHEN age = 1 THEN '1 year' WHEN age < 100 THEN age || ' years' WHEN age < 105 THEN '100 to 104 years' WHEN age < 110 THEN '105 to 109 years' ELSE '110 years and over' END"


@query("workload_tables", sql(f"""SELECT 'PCT12' AS tbl, 'sex' AS query, sex AS level, count(*) AS n FROM dhcp GROUP BY 3
  UNION ALL SELECT 'PCT12', 'sex * agepct12', sex || ' BY ' || {_AGE12}, count(*) FROM dhcp GROUP BY 3
  UNION ALL SELECT 'PCT8', 'nonvoting', 'Non-voting Age', count(*) FROM dhcp WHERE age < 18
  UNION ALL SELECT 'PCT8', 'nonvoting * hhinstlevels', {_INST} || ' BY Non-voting Age', count(*) FROM dhcp WHERE age < 18 GROUP BY 3
  UNION ALL SELECT 'PCT8', 'nonvoting * hhspchildothgq', {_HH4} || ' BY Non-voting Age', count(*) FROM dhcp WHERE age < 18 GROUP BY 3
  UNION ALL SELECT 'PCT8', 'childage7lev * hhspchildothgq', {_HH4} || ' BY ' || {_CHILD}, count(*) FROM dhcp WHERE age < 18 AND rel BETWEEN 6 AND 17 GROUP BY 3
  UNION ALL SELECT 'PCT8', 'childage7lev * hhinstlevels', {_INST} || ' BY ' || {_CHILD}, count(*) FROM dhcp WHERE age < 18 AND rel >= 18 GROUP BY 3""", _DHCP))
def _(t):
    rows = wl.published_rows(t.spark, "person").filter(wl.in_family(["PCT8", "PCT12"]))
    names = sorted({q for k, qs in wl.tb.workload("person").items() if k in ("PCT8", "PCT12") for q in qs if q != "total"})
    got = wl.answer_workload(dhcp_cells(t), rows, DHCP, names)
    return got.select(F.col("TABLE").alias("tbl"), F.col("QUERY").alias("query"), F.col("LEVEL").alias("level"), "n")


_REL8 = "CASE rel WHEN 0 THEN 'Householder living alone' WHEN 1 THEN 'Householder not living alone' END"


# Labels of the published tables, as the oracle must state them.
_OF_GROUP = """(VALUES ('', ''), ('A', ' BY White alone'), ('B', ' BY Black or African American alone'), ('C', ' BY American Indian and Alaska Native alone'), ('D', ' BY Asian alone'),
  ('E', ' BY Native Hawaiian and Pacific Islander alone'), ('F', ' BY Some Other Race alone'), ('G', ' BY Two or more races'), ('H', ' BY Hispanic or Latino'), ('I', ' BY Not Hispanic or Latino BY White alone')) t(x, label)
  ON CASE t.x WHEN '' THEN true WHEN 'G' THEN race >= 6 WHEN 'H' THEN hisp = 1 WHEN 'I' THEN race = 0 AND hisp = 0 ELSE race = ascii(t.x) - 65 END"""


@query("workload_drop_rules", sql(f"""SELECT tbl, level, count(*) AS n FROM (SELECT 'PCT9' || t.x AS tbl, {_REL8} || ' BY ' || sex || ' BY 65 years and over' || t.label AS level
  FROM dhcp JOIN {_OF_GROUP} WHERE age >= 65 AND rel < 2) GROUP BY 1, 2""", _DHCP))
def _(t):
    start = "65andover * relgq8cats * sex"
    rows = wl.published_rows(t.spark, "person").filter(F.col("QUERY").startswith(start))
    names = [q for qs in wl.tb.workload("person").values() for q in qs if q.startswith(start)]
    got = wl.answer_workload(dhcp_cells(t), rows, DHCP, names)
    return got.select(F.col("TABLE").alias("tbl"), F.col("LEVEL").alias("level"), "n")


def unit_workload_values() -> str:
    """The published unit workload as SQL values, unfolded here label by label."""
    s, rows = sc.schema(wl.tb.WORKLOAD_SCHEMA["unit"]), []
    for name, queries in wl.tb.workload("unit").items():
        for q in queries:
            if q != "total" and s.knows(q):
                rows += [(name, q, " BY ".join(labels), k) for k, labels in enumerate(product(*s.labels(q))) if not k or not (name.startswith("PCT10") and q.startswith("dhch_hhtype_p12_part1"))]
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join(f"({', '.join(map(text, (*r, k)))})" for k, r in enumerate(rows, 1)) + ") w(tbl, query, level, col_index, row_num)"


_BRANDS = "SELECT right(p_brand, 1) AS d, count(*) AS parts FROM part GROUP BY 1"
_UNIT_ROWS = f"""SELECT tbl AS "TABLE", query AS "QUERY", level AS "LEVEL", CAST(col_index AS INTEGER) AS col_index, CAST(row_num AS INTEGER) AS row_num, parts
  FROM {unit_workload_values()} JOIN ({_BRANDS}) p ON p.d = CAST(row_num % 5 + 1 AS VARCHAR)"""


@query("workload_row_number", _UNIT_ROWS)
def _(t):
    """Published rows of the unit workload next to how many parts carry their table's brand number."""
    rows = wl.published_rows(t.spark, "unit")
    parts = t.read("part").groupBy(F.substring("p_brand", -1, 1).alias("d")).agg(F.count(F.lit(1)).alias("parts"))
    return rows.withColumn("d", (F.col("row_num") % 5 + 1).cast("string")).join(parts, "d").select("TABLE", "QUERY", "LEVEL", "col_index", "row_num", "parts")


@query("table_family", sql("SELECT p_type AS tbl, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'P19' WHEN p_size % 3 = 1 THEN 'H4' ELSE 'H14' END || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'b' ELSE 'AB' END AS p_type FROM part) WHERE regexp_matches(p_type, '^(P19|H4)[A-Z]*$') GROUP BY 1"))
def _(t):
    s = F.col("p_size")
    name = F.concat(F.when(s % 3 == 0, "P19").when(s % 3 == 1, "H4").otherwise("H14"), F.when(s % 4 == 0, "").when(s % 4 == 1, "A").when(s % 4 == 2, "b").otherwise("AB"))
    return t.read("part").select(name.alias("tbl")).filter(wl.in_family(["P19", "H4"], "tbl")).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


# ---- constraints ----------------------------------------------------------------------------

def _constraints(t: Tables):
    """Constraint rows per nation, shifted by the smallest count so that some bounds are zero."""
    n = t.true_counts(2)
    full = n.groupBy("geocode").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("s"), F.sum("n").alias("total"), F.sum(F.when(F.col("cell") % 5 == 4, F.col("n"))).alias("low"))
    low = F.least(*[F.get("s", F.lit(i))["n"] for i in range(15)])
    value = F.transform("s", lambda x: x["n"] - low)
    null = F.lit(None).cast("string")

    def rows(name, sign, a, b, v, keep=None):
        src = full if keep is None else full.filter(keep)
        return src.select("geocode", F.lit(name).alias("query_name"), F.lit(sign).alias("sign"), v.alias("value"), F.lit(a).alias("a"), (null if b is None else F.lit(b)).alias("b"))

    return (
        rows("total_con", "=", "total", None, F.array("total")).unionByName(rows("cell_ub_con", "<=", "status", "priority", value))
        .unionByName(rows("cell_lb_con", ">=", "status", "priority", value))
        .unionByName(rows("low_con", "=", "status * x", "low", F.array(F.lit(0).cast("bigint")), F.col("low") % 3 == 0))
    )


_SHIFT = ("shifted", "SELECT geocode, cell, n - min(n) OVER (PARTITION BY geocode) AS n FROM true2")
_LOW = "SELECT geocode FROM true2 GROUP BY 1 HAVING CAST(sum(n) FILTER (WHERE cell % 5 = 4) AS BIGINT) % 3 = 0"


@query("constraints_to_zero_cells", sql(f"""SELECT geocode, 'status * priority' AS query_name, 'zero' AS kind, cell AS row_ix, 0.0::DOUBLE AS value, 1.0 / 16384 AS variance FROM shifted WHERE n = 0
  UNION ALL SELECT geocode, 'low', 'zero', 0, 0.0, 1.0 / 16384 FROM ({_LOW})""", _SHIFT))
def _(t):
    return ct.interpret(_constraints(t))


@query("total_invariant", sql("SELECT geocode, CAST(sum(n) AS DOUBLE) AS value FROM true2 GROUP BY 1"))
def _(t):
    return ct.interpret(_constraints(t), total_invariant=True).filter("kind = 'total'").select("geocode", "value")


@query("zero_mask", sql(f"""SELECT DISTINCT geocode, CAST(cell AS BIGINT) AS cell FROM (SELECT geocode, cell FROM shifted WHERE n = 0
  UNION ALL SELECT geocode, unnest([4, 9, 14]) FROM ({_LOW}))""", _SHIFT))
def _(t):
    m = tab.query_cell(t.spark, tab.tabular_query("status * priority", SHAPE)).unionByName(tab.query_cell(t.spark, tab.tabular_query("low", SHAPE, {1: [[4]]}, [0])))
    return ct.zero_mask(ct.interpret(_constraints(t)), m)


@query("marginal_zero_mask", sql(f"""SELECT geocode, CAST(cell % 5 AS INTEGER) AS cell FROM (SELECT DISTINCT geocode, cell FROM (SELECT geocode, cell FROM shifted WHERE n = 0
  UNION ALL SELECT geocode, unnest([4, 9, 14]) FROM ({_LOW}))) GROUP BY 1, 2 HAVING count(*) = 3""", _SHIFT))
def _(t):
    m = tab.query_cell(t.spark, tab.tabular_query("status * priority", SHAPE)).unionByName(tab.query_cell(t.spark, tab.tabular_query("low", SHAPE, {1: [[4]]}, [0])))
    every = t.spark.range(15).select(F.col("id").alias("cell"))
    return ct.marginal_mask(ct.interpret(_constraints(t)), m, (F.col("cell") % 5).cast("int"), every)


_FLAG = ("flag", "SELECT l.geocode, c.c_acctbal < 9000 AS z FROM leaf l JOIN customer c ON c.c_custkey = l.key")


@query("zero_rollup", sql("""SELECT 3 AS depth, geocode, z AS is_zero FROM flag UNION ALL SELECT 2, substr(geocode, 1, 3), bool_and(z) FROM flag GROUP BY 2
  UNION ALL SELECT 1, substr(geocode, 1, 1), bool_and(z) FROM flag GROUP BY 2 UNION ALL SELECT 0, '', bool_and(z) FROM flag""", _FLAG))
def _(t):
    flags = t.leaf.join(t.read("customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") < 9000).alias("is_zero")), "key")
    return ct.roll_up_zeros(flags, SPINE)


# ---- coarsenings ----------------------------------------------------------------------------


@query("common_coarsening", sql("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 1000 + (year(o_orderdate) % 50) * 12 + month(o_orderdate) AS g, o_orderkey // 2 AS m FROM orders), r(m, x) AS (
  SELECT m, m FROM e UNION SELECT b.m, r.x FROM r JOIN e a ON a.m = r.m JOIN e b ON b.g = a.g WHERE r.x < b.m) SELECT m AS member, min(x) AS component FROM r GROUP BY 1"""))
def _(t):
    # orders of one customer in one month belong together, and so do neighbouring order numbers
    d = F.col("o_orderdate")
    groups = t.read("orders").select(
        (F.col("o_custkey") * 1000 + F.year(d) % 50 * 12 + F.month(d)).alias("grp"), F.floor(F.col("o_orderkey") / 2).cast("bigint").alias("member")
    )
    return mg.merge_overlapping(groups)


@query("refinement_test", sql("""SELECT c.coarse_row, i.fine_row AS row_ix, coalesce(g.got, 0) = c.want AND coalesce(g.covered, 0) = c.want AS exact
  FROM (SELECT row_ix AS coarse_row, count(*) AS want FROM co GROUP BY 1) c
  LEFT JOIN (SELECT i.coarse_row, count(*) AS got, count(DISTINCT f.cell) AS covered FROM ins i JOIN fi f ON f.row_ix = i.fine_row GROUP BY 1) g ON g.coarse_row = c.coarse_row
  LEFT JOIN ins i ON i.coarse_row = c.coarse_row""",
    ("fi", "SELECT DISTINCT CAST(o_custkey // 5 AS BIGINT) AS row_ix, o_custkey AS cell FROM orders"),
    ("co", "SELECT c_custkey // 10 AS row_ix, c_custkey AS cell FROM customer"),
    ("ins", "SELECT x.coarse_row, x.fine_row FROM (SELECT co.row_ix AS coarse_row, fi.row_ix AS fine_row, count(*) AS shared FROM fi JOIN co ON co.cell = fi.cell GROUP BY 1, 2) x JOIN (SELECT row_ix, count(*) AS size FROM fi GROUP BY 1) s ON s.row_ix = x.fine_row WHERE x.shared = s.size")))
def _(t):
    # groups of five buying customers against groups of ten customers: exact where all ten bought
    fine = t.read("orders").select(F.floor(F.col("o_custkey") / 5).cast("bigint").alias("row_ix"), F.col("o_custkey").alias("cell")).distinct()
    coarse = t.read("customer").select(F.floor(F.col("c_custkey") / 10).cast("bigint").alias("row_ix"), F.col("c_custkey").alias("cell"))
    return mg.refinement(fine, coarse)


@query("marginalised_measurement", sql("""SELECT geocode, 'detailed' AS query_name, CAST(cell // 5 * 2 + CASE WHEN cell % 5 < 2 THEN 0 ELSE 1 END AS BIGINT) AS row_ix, sum(est) + 0.0 AS value, sum(v) AS variance
  FROM own3 WHERE v IS NOT NULL GROUP BY 1, 3"""))
def _(t):
    detailed = tab.tabular_query("detailed", SHAPE)
    marginal = tab.tabular_query("status * urgent", SHAPE, {1: URGENT})
    m = t.arrays(3).filter("query_name = 'detailed' and variance < double('infinity')")
    return mg.marginalise(m, detailed, marginal)


@query("projection_rows", sql("""SELECT geocode, CAST(cell // 5 AS BIGINT) AS coarse_row, CAST(sum(n) AS BIGINT) AS n FROM true2 WHERE cell % 5 < 2 GROUP BY 1, 2"""))
def _(t):
    fine = tab.tabular_query("urgent only", SHAPE, {1: [[0, 1]]})
    p = mg.projection(t.spark, tab.tabular_query("detailed", SHAPE), fine)
    return t.true_counts(2).withColumnRenamed("cell", "row_ix").join(p, "row_ix").groupBy("geocode", "coarse_row").agg(F.sum("n").alias("n"))


@query("tenure_patch", sql("""SELECT geocode, 'hhtenshort_3lev' AS query_name, r.r AS row_ix, CASE r.r WHEN 2 THEN v[3] + v[4] ELSE v[r.r + 1] END AS value, 2.0::DOUBLE * CASE r.r WHEN 2 THEN 2 ELSE 1 END AS variance
  FROM (SELECT geocode, list(est ORDER BY cell) AS v FROM own1 GROUP BY 1) CROSS JOIN (SELECT unnest([0, 1, 2]) AS r) r"""))
def _(t):
    m = t.arrays(1).filter("query_name = 'detailed'").select("geocode", F.lit("tenvacgq").alias("query_name"), "value", F.lit(2.0).alias("variance"))
    rows = mg.tenure_rows(m).select("geocode", "query_name", "variance", F.posexplode("value").alias("row_ix", "value"))
    three = tab.tabular_query(mg.TENURE[1], (3,))
    design = mg.tenure_design(mg.marginal_design(t.spark, three, three), True)
    return rows.join(design.select("query_name", "row_ix", "mult"), ["query_name", "row_ix"]).select("geocode", "query_name", "row_ix", "value", (F.col("variance") * F.col("mult")).alias("variance"))
