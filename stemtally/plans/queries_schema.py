"""Queries that bring the catalog to the data: labels, recodes, names and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemtally.catalog import attributes as at, frames as fr, schemas as sc, tables as tb
from stemtally.operators import tabulate as tab
from stemtally.operators.spine import surrogate_rank
from stemtally.plans.fixtures import Tables, sql
from stemtally.plans.queries_tabulation import _DHCP, _PERSON, _ROWS, cells, dhcp_cells, person_cells
from stemtally.plans.registry import query

PL94 = sc.schema("PL94_SCHEMA")


def _values(rows) -> str:
    def one(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows) + ")"


_NAMES = sc.schema_names()


@query("schema_catalog", sql("""SELECT schema, count(*) AS customers, any_value(size)::BIGINT AS cells, any_value(dims)::BIGINT AS attributes, any_value(unit_schema) AS unit_schema, any_value(constraint_schema) AS constraint_schema
  FROM customer JOIN cat ON ix = c_custkey % 36 GROUP BY 1""",
    ("cat", f"SELECT * FROM {_values((i, n, sc.schema(n).size, len(sc.schema(n).shape), sc.unit_schema(n), sc.constraint_schema(n)) for i, n in enumerate(_NAMES))} x(ix, schema, size, dims, unit_schema, constraint_schema)")))
def _(t: Tables):
    names = t.spark.createDataFrame(list(enumerate(_NAMES)), "ix long, schema string")
    asked = t.read("customer").groupBy((F.col("c_custkey") % len(_NAMES)).alias("ix")).agg(F.count(F.lit(1)).alias("customers")).join(names, "ix")
    size = fr.schema_attributes(t.spark).groupBy("schema").agg(F.round(F.product(F.col("size").cast("double"))).cast("bigint").alias("cells"), F.count(F.lit(1)).alias("attributes"))
    return asked.join(size, "schema").join(fr.related_schemas(t.spark), "schema").select("schema", "customers", "cells", "attributes", "unit_schema", "constraint_schema")


@query("attribute_levels", sql("SELECT r.label, count(*) AS n FROM dhcp JOIN rel r ON r.ix = dhcp.rel GROUP BY 1", _DHCP,
    ("rel", f"SELECT * FROM {_values(enumerate(at.ATTRIBUTES['RelGQAttr'].levels))} x(ix, label)")))
def _(t):
    levels = fr.dim_level(t.spark, ["RelGQAttr"])
    rel = tab.answer(dhcp_cells(t), sc.schema("DHCP_SCHEMA").query("relgq"))
    return rel.join(levels, rel.row_ix == levels.level_ix).select("label", "n")


@query("recode_catalog", None)
def _(t):
    """Every recode of every person attribute of the DHC schema, counted over the line items; overlaps count repeatedly."""
    s = sc.schema("DHCP_SCHEMA")
    recodes = fr.recode_level(t.spark, [a.cls for a in s.attributes])
    kinds = fr.recode_kinds(recodes, fr.dim_level(t.spark))
    dims = F.array(*[F.struct(F.lit(a.cls).alias("class"), lv.alias("level_ix")) for a, lv in zip(s.attributes, tab.levels_of(F.col("cell"), s.shape))])
    per = dhcp_cells(t).select("n", F.inline(dims)).groupBy("class", "level_ix").agg(F.sum("n").alias("n"))
    return per.join(recodes, ["class", "level_ix"]).groupBy("class", "recode", "group_ix", "group_label").agg(F.sum("n").alias("n")).join(kinds, ["class", "recode"])


_AGE = "SELECT l_partkey % 116 AS age FROM lineitem"


def _age_recode(name, oracle):
    @query(name, oracle)
    def _(t):
        a = at.ATTRIBUTES["AgeAttr"]
        recode = {"age_prefix": "prefix_agecats", "age_range": "range_agecats", "age_binary_split": "binarysplit_agecats"}[name]
        groups = a.recodes[recode]
        per = t.read("lineitem").groupBy((F.col("l_partkey") % 116).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        labels = t.spark.createDataFrame([(i, label) for i, (label, _) in enumerate(groups)], "group_ix int, group_label string")
        q = tab.tabular_query(recode, (a.size,), {0: [levels for _, levels in groups]})
        return tab.answer(per, q).join(labels, F.col("row_ix") == F.col("group_ix")).select("group_ix", "group_label", "n")


_age_recode("age_prefix", f"SELECT CAST(j AS INTEGER) AS group_ix, CASE WHEN j = 0 THEN 'age 0' ELSE 'age 0-' || j END AS group_label, count(*) AS n FROM ({_AGE}) JOIN range(116) r(j) ON age <= j GROUP BY 1, 2")
_age_recode("age_range", f"""SELECT CAST(j * (j + 1) / 2 + k AS INTEGER) AS group_ix, CASE WHEN j = k THEN 'age ' || k ELSE 'age ' || k || '-' || j END AS group_label, sum(n)::BIGINT AS n
  FROM (SELECT age, count(*) AS n FROM ({_AGE}) GROUP BY 1) JOIN (SELECT j, k FROM range(116) a(j), range(116) b(k) WHERE k <= j) ON age BETWEEN k AND j GROUP BY j, k""")
_age_recode("age_binary_split", f"""SELECT CAST(g.ix AS INTEGER) AS group_ix, 'split' || g.w || ': age ' || CASE WHEN lo = hi THEN lo || '' ELSE lo || '-' || hi END AS group_label, count(*) AS n FROM ({_AGE})
  JOIN (SELECT w, lo, least(lo + w - 1, 115) AS hi, row_number() OVER (ORDER BY w DESC, lo) - 1 AS ix FROM (SELECT w, unnest(range(0, 115, w)) AS lo FROM (VALUES (116), (58), (29), (15), (7), (4), (2), (1)) s(w))) g ON age BETWEEN lo AND hi GROUP BY 1, 2""")


@query("crossed_labels", sql("SELECT nation, CASE s WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END || ' BY ' || CASE WHEN p < 2 THEN 'urgent' ELSE 'normal' END AS level, count(*) AS n FROM micro GROUP BY 1, 2", _ROWS))
def _(t):
    s = sc.Schema("orders", [at.Attribute("status", "S", ["F", "O", "P"]), at.Attribute("priority", "P", list("12345"), {"urgency": [("urgent", [0, 1]), ("normal", [2, 3, 4])]})])
    labels = fr.crossed_labels(t.spark, s, "urgency * status")
    return tab.answer(cells(t), s.query("urgency * status"), ["nation"]).join(labels, "row_ix").select("nation", "level", "n")


@query("default_labels", sql("""SELECT attr, CAST(level_ix AS INTEGER) AS level_ix, CASE WHEN bool_and(label IS NOT NULL) OVER (PARTITION BY attr) THEN label ELSE attr || '_' || level_ix END AS label FROM lv""",
    ("lv", "SELECT p_brand AS attr, p_size AS level_ix, CASE WHEN min(p_retailprice) > 905 THEN min(p_name) END AS label FROM part GROUP BY 1, 2")))
def _(t):
    lv = t.read("part").groupBy(F.col("p_brand").alias("attr"), F.col("p_size").alias("level_ix")).agg(F.when(F.min("p_retailprice") > 905, F.min("p_name")).alias("label"))
    return fr.with_default_labels(lv)


@query("level_order", sql("SELECT label, row_number() OVER (ORDER BY first) - 1 AS level_ix FROM (SELECT c_mktsegment AS label, min(c_custkey) AS first FROM customer GROUP BY 1)"))
def _(t):
    """Levels in the order of their first index."""
    first = t.read("customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.min("c_custkey").alias("first")).withColumn("geocode", F.lpad(F.col("first").cast("string"), 19, "0"))
    return first.join(surrogate_rank(first), "geocode").select("label", F.col("rank").alias("level_ix"))


@query("group_labels", sql("SELECT p_brand AS recode, CAST(p_size AS INTEGER) AS group_ix, string_agg(DISTINCT p_type, '.' ORDER BY p_type) AS group_label FROM part GROUP BY 1, 2"))
def _(t):
    types = t.read("part").select("p_type").distinct()
    ranked = surrogate_rank(types.withColumnRenamed("p_type", "geocode")).select(F.col("geocode").alias("p_type"), F.col("rank").cast("int").alias("level_ix"))
    groups = t.read("part").select(F.col("p_brand").alias("recode"), F.col("p_size").alias("group_ix"), "p_type").distinct().join(ranked, "p_type").select("recode", "group_ix", "level_ix")
    return fr.group_labels(groups, ranked.select("level_ix", F.col("p_type").alias("label")))


_ASK = """CASE c_custkey % 4 WHEN 0 THEN 'cenrace' WHEN 1 THEN 'votingage' WHEN 2 THEN 'total' ELSE 'noSuchRecode' END || CASE c_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '*hispanic' WHEN 2 THEN ' * majorRaces' WHEN 3 THEN ' *detailed' ELSE ' * hhgq * voting' END"""


def _asked(t):
    a, b = F.col("c_custkey") % 4, F.col("c_nationkey") % 5
    one = F.when(a == 0, "cenrace").when(a == 1, "votingage").when(a == 2, "total").otherwise("noSuchRecode")
    two = F.when(b == 0, "").when(b == 1, "*hispanic").when(b == 2, " * majorRaces").when(b == 3, " *detailed").otherwise(" * hhgq * voting")
    return t.read("customer").select(F.concat(one, two).alias("name"))


@query("resolve_names", sql(f"""SELECT name, count(*) AS n, CASE WHEN name LIKE 'noSuch%' OR name LIKE '%detailed' THEN false WHEN name LIKE 'total%' THEN name = 'total'
  WHEN name LIKE 'cenrace%majorRaces' OR name LIKE 'votingage%voting' THEN false ELSE true END AS valid FROM (SELECT {_ASK} AS name FROM customer) GROUP BY 1"""))
def _(t):
    asked = _asked(t).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = [f"{a}{b}" for a in ("cenrace", "votingage", "total", "noSuchRecode") for b in ("", "*hispanic", " * majorRaces", " *detailed", " * hhgq * voting")]
    return asked.join(fr.resolve(t.spark, PL94, names), "name").select("name", "n", "valid")


@query("sorted_names", sql(f"SELECT DISTINCT name, array_to_string(list_sort(regexp_split_to_array(name, '\\s*\\*\\s*')), ' * ') AS sorted, regexp_replace(name, '\\s*\\*\\s*', '.', 'g') AS file FROM (SELECT {_ASK} AS name FROM customer)"))
def _(t):
    return _asked(t).distinct().select("name", fr.sorted_name("name").alias("sorted"), fr.to_file_name("name").alias("file"))


@query("file_names_back", sql(f"SELECT name, count(*) AS n FROM (SELECT array_to_string(regexp_split_to_array({_ASK}, '\\s*\\*\\s*'), ' * ') AS name FROM customer) GROUP BY 1"))
def _(t):
    return _asked(t).select(fr.to_query_name(fr.to_file_name("name")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_BASES = [(p, d, p) for p, d in enumerate(PL94.dims)] + [(len(PL94.dims) + i, r, d) for i, (r, (d, _)) in enumerate(PL94.recodes.items())]
_FILLED = {"hhgq": "hhgq", "votingage": "vote", "hispanic": "hisp", "cenrace": "race"}


def _filled_sql() -> str:
    """Distinct filled rows of the crosses of at most two dimensions."""
    pairs = [[a, b] for i, a in enumerate(PL94.dims) for b in PL94.dims[i + 1 :]]
    crosses = [[d] for d in PL94.dims] + pairs
    counts = [f"SELECT '{sc.CROSS.join(c)}' AS name, count(DISTINCT {" || '|' || ".join(_FILLED[d] for d in c)}) AS filled FROM person" for c in crosses]
    return "SELECT 'total' AS name, CAST(1 AS BIGINT) AS filled UNION ALL " + " UNION ALL ".join(counts)


@query("nway_names", sql(f"""SELECT n.name, n.ways, f.filled FROM (
  SELECT 'total' AS name, CAST(0 AS INTEGER) AS ways UNION ALL SELECT base, 1 FROM b
  UNION ALL SELECT x.base || '{sc.CROSS}' || y.base, 2 FROM b x JOIN b y ON y.pos > x.pos AND y.dim <> x.dim) n LEFT JOIN ({_filled_sql()}) f ON f.name = n.name""",
    _PERSON, ("b", f"SELECT * FROM {_values(_BASES)} v(pos, base, dim)")))
def _(t):
    """Two-way and three-way crosses of the redistricting schema, with the number of filled rows for each dimension-only cross."""
    names = fr.nway_names(t.spark, PL94, [0, 1, 2])
    rows = person_cells(t).groupBy("cell").agg(F.sum("n").alias("n"))
    dims = [lv.alias(d) for d, lv in zip(PL94.dims, tab.levels_of(F.col("cell"), PL94.shape))]
    filled = tab.marginals(rows.select("n", *dims), PL94.dims, [0, 1, 2]).groupBy("query").agg(F.count(F.lit(1)).alias("filled"))
    return names.join(filled, names.name == filled["query"], "left").select("name", "ways", "filled")


@query("table_queries", sql("""SELECT x.tbl, q.query, x.n FROM (SELECT 'P' || (o_orderkey % 4 + 1) AS tbl, count(*) AS n FROM orders GROUP BY 1) x JOIN tq q ON q.tbl = x.tbl""",
    ("tq", f"SELECT * FROM {_values((k, q) for k, v in tb.tables('PL94_SCHEMA').items() if k in ('P1', 'P2', 'P3', 'P4') for q in v)} v(tbl, query)")))
def _(t):
    catalog = fr.table_catalog(t.spark).filter("schema = 'PL94_SCHEMA' and valid").select(F.col("table").alias("tbl"), "query").distinct()
    asked = t.read("orders").groupBy(F.concat(F.lit("P"), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("tbl")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(catalog, "tbl").select("tbl", "query", "n")


@query("table_levels", sql("""SELECT 'numraces' AS query, CASE WHEN race < 6 THEN '1 Race' WHEN race < 21 THEN '2 Races' WHEN race < 41 THEN '3 Races' WHEN race < 56 THEN '4 Races' WHEN race < 62 THEN '5 Races' ELSE '6 Races' END AS level, count(*) AS n FROM person GROUP BY 2
  UNION ALL SELECT 'hispanic * numraces', CASE hisp WHEN 1 THEN 'Hispanic or Latino' ELSE 'Not Hispanic or Latino' END || ' BY ' || CASE WHEN race < 6 THEN '1 Race' WHEN race < 21 THEN '2 Races' WHEN race < 41 THEN '3 Races' WHEN race < 56 THEN '4 Races' WHEN race < 62 THEN '5 Races' ELSE '6 Races' END, count(*) FROM person GROUP BY 2
  UNION ALL SELECT 'hispanic', CASE hisp WHEN 1 THEN 'Hispanic or Latino' ELSE 'Not Hispanic or Latino' END, count(*) FROM person GROUP BY 2
  UNION ALL SELECT 'total', 'total', count(*) FROM person
  UNION ALL SELECT 'cenrace', c.label, count(*) FROM person JOIN rc c ON c.ix = race GROUP BY 2
  UNION ALL SELECT 'hispanic * cenrace', CASE hisp WHEN 1 THEN 'Hispanic or Latino' ELSE 'Not Hispanic or Latino' END || ' BY ' || c.label, count(*) FROM person JOIN rc c ON c.ix = race GROUP BY 2""",
    _PERSON, ("rc", f"SELECT * FROM {_values(enumerate(at.ATTRIBUTES['CenraceAttr'].levels))} v(ix, label)")))
def _(t):
    """Table P2 of the redistricting schema with its level labels."""
    from stemtally.operators.workloads import answer_many

    names = sorted(set(tb.tables("PL94_SCHEMA")["P2"]))
    labels = None
    for n in names:
        part = fr.crossed_labels(t.spark, PL94, n)
        labels = part if labels is None else labels.unionByName(part)
    return answer_many(person_cells(t), [PL94.query(n) for n in names]).join(labels, ["query", "row_ix"]).select("query", "level", "n")


_TWO = [("Household", [0]), ("Institutional", [1, 2, 3, 4]), ("Military", [6])]


@query("sql_recode", sql("""SELECT CASE WHEN hhgq = 0 THEN 'Household' WHEN hhgq < 5 THEN 'Institutional' WHEN hhgq = 6 THEN 'Military' ELSE '-1' END AS label,
  CASE WHEN hhgq = 0 THEN '0' WHEN hhgq < 5 THEN '1' WHEN hhgq = 6 THEN '2' ELSE '-1' END AS code, count(*) AS n FROM person GROUP BY 1, 2""", _PERSON))
def _(t):
    code = (F.col("cell") / 252).cast("int").cast("string")
    rows = person_cells(t).withColumn("hhgq", code)
    return rows.select(fr.recode_case("hhgq", _TWO, labels=True).alias("label"), F.expr(fr.recode_sql("hhgq", _TWO)).alias("code"), "n").groupBy("label", "code").agg(F.sum("n").alias("n"))


@query("replacement_map", sql("SELECT p_brand AS brand, max_by(p_type, p_retailprice) AS type, p_size AS size, count(*) AS parts FROM part GROUP BY 1, 3"))
def _(t):
    p = t.read("part")
    groups = p.groupBy(F.col("p_brand").alias("recode"), F.col("p_size").alias("level_ix")).agg(F.max_by("p_type", "p_retailprice").alias("group_label")).withColumn("group_ix", F.lit(0))
    sizes = p.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("parts"))
    return sizes.join(fr.replacement_map(groups), F.col("brand") == F.col("recode")).select("brand", F.try_element_at("replacement", F.col("size").cast("string")).alias("type"), "size", "parts")


@query("level_subset", sql("SELECT c.label, count(*) AS n FROM person JOIN rc c ON c.ix = race WHERE race IN (0, 6, 21, 62) GROUP BY 1", _PERSON,
    ("rc", f"SELECT * FROM {_values(enumerate(at.ATTRIBUTES['CenraceAttr'].levels))} v(ix, label)")))
def _(t):
    levels = fr.level_subset(fr.dim_level(t.spark, ["CenraceAttr"]), [0, 6, 21, 62])
    race = tab.answer(person_cells(t), PL94.query("cenrace"))
    return race.join(levels, race.row_ix == levels.level_ix).select("label", "n")


@query("enumerate_cells", sql("""SELECT CAST(h AS VARCHAR) AS hhgq, CAST(v AS VARCHAR) AS votingage, CAST(i AS VARCHAR) AS hispanic, CAST(r AS VARCHAR) AS cenrace, coalesce(n, 0) AS n
  FROM range(8) a(h), range(2) b(v), range(2) c(i), range(63) d(r) LEFT JOIN (SELECT hhgq, vote, hisp, race, count(*) AS n FROM person GROUP BY ALL) ON hhgq = h AND vote = v AND hisp = i AND race = r""", _PERSON))
def _(t):
    every = fr.enumerate_cells(t.spark, PL94, mangled=False, flat_index=True)
    got = person_cells(t).groupBy(F.col("cell").cast("string").alias("flat_index")).agg(F.sum("n").alias("n"))
    return every.join(got, "flat_index", "left").select(*PL94.dims, F.coalesce("n", F.lit(0)).alias("n"))


_BITS = ("bits", """SELECT row_number() OVER (ORDER BY k, b DESC) - 1 AS ix, b, k, concat_ws('-', CASE WHEN b[1] = '1' THEN 'white' END, CASE WHEN b[2] = '1' THEN 'black' END, CASE WHEN b[3] = '1' THEN 'aian' END,
  CASE WHEN b[4] = '1' THEN 'asian' END, CASE WHEN b[5] = '1' THEN 'nhopi' END, CASE WHEN b[6] = '1' THEN 'sor' END) AS label
  FROM (SELECT lpad(bin(i), 6, '0') AS b, length(replace(bin(i), '0', '')) AS k FROM range(1, 64) r(i))""")


@query("race_codes", sql("SELECT b.b AS bits, b.label, CAST(b.k AS INTEGER) AS n_races, count(*) AS n FROM person JOIN bits b ON b.ix = race GROUP BY ALL", _PERSON, _BITS))
def _(t):
    race = tab.answer(person_cells(t), PL94.query("cenrace"))
    return race.join(fr.race_codes(t.spark), F.col("row_ix") + 1 == F.col("ix")).select("bits", "label", "n_races", "n")


@query("race_alone_or_combined", sql("""SELECT x AS race, count(*) AS n, count(*) FILTER (WHERE k = 1) AS alone FROM (SELECT unnest(string_split(label, '-')) AS x, k FROM person JOIN bits ON ix = race) GROUP BY 1""", _PERSON, _BITS))
def _(t):
    race = tab.answer(person_cells(t), PL94.query("cenrace")).join(fr.race_codes(t.spark), F.col("row_ix") + 1 == F.col("ix"))
    each = race.select(F.explode(F.split("label", "-")).alias("race"), "n_races", "n")
    return each.groupBy("race").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n_races") == 1, F.col("n")).otherwise(0)).alias("alone"))


_TYPES = at.household_types()


@query("household_type_levels", sql("""SELECT CASE WHEN MARRIED = 1 AND OWN_CHILD_UNDER_18 = 1 THEN 'Married Couple HH with Own Children <18' WHEN MARRIED = 1 THEN 'Married Couple HH W/o Own Children <18'
  WHEN COHABITING = 1 AND OWN_CHILD_UNDER_18 = 1 THEN 'Cohabiting Couple HH with Own Children <18' ELSE 'Cohabiting Couple HH W/o Own Children <18' END AS label, SIZE AS size, count(*) AS n
  FROM orders JOIN ht ON ix = o_orderkey % 522 WHERE MARRIED = 1 OR COHABITING = 1 GROUP BY 1, 2""",
    ("ht", f"SELECT * FROM {_values((i, *t.values()) for i, t in enumerate(_TYPES))} v(ix, {', '.join(_TYPES[0])})")))
def _(t):
    from functools import reduce

    types = fr.household_dimension(t.spark)
    rows = t.read("orders").groupBy((F.col("o_orderkey") % 522).cast("int").alias("hhtype")).agg(F.count(F.lit(1)).alias("n")).join(types, "hhtype")
    groups = at.household_groupings()["dhch_hhtype_p12_part1"]
    parts = [rows.filter(p).select(F.lit(label).alias("label"), F.col("SIZE").alias("size"), "n") for label, p in groups]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("label", "size").agg(F.sum("n").alias("n"))


@query("household_type_index", sql("""SELECT CAST(ix AS INTEGER) AS hhtype, count(*) AS n FROM orders JOIN ht ON SIZE = o_orderkey % 7 + 1 AND NO_SPOUSE_OR_PARTNER = 1 AND MULTIG = 0 AND NO_OWN_CHILD_UNDER_18 = 1
  AND CHILD_UNDER_18 = (o_custkey % 2) AND NO_CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER = 1 AND WITH_RELATIVES = CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 2 END GROUP BY 1""",
    ("ht", f"SELECT * FROM {_values((i, *t.values()) for i, t in enumerate(_TYPES))} v(ix, {', '.join(_TYPES[0])})")))
def _(t):
    """From indicators to the type number."""
    k = F.col("o_orderkey") % 7
    asked = t.read("orders").groupBy(
        (k + 1).cast("int").alias("SIZE"), (F.col("o_custkey") % 2).cast("int").alias("CHILD_UNDER_18"),
        F.when(k == 0, 0).otherwise(F.col("o_orderkey") % 2).cast("int").alias("WITH_RELATIVES"),
    ).agg(F.count(F.lit(1)).alias("n"))
    types = fr.household_dimension(t.spark).filter(
        "NO_SPOUSE_OR_PARTNER = 1 and MULTIG = 0 and NO_OWN_CHILD_UNDER_18 = 1 and NO_CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER = 1"
    )
    return asked.join(types, ["SIZE", "CHILD_UNDER_18", "WITH_RELATIVES"]).groupBy("hhtype").agg(F.sum("n").alias("n"))


@query("stacked_unit_levels", sql("""SELECT CASE WHEN gq <> '000' THEN 11 + CASE WHEN gq = '702' THEN 23 ELSE list_position(['101','102','103','104','105','106','201','202','203','301','401','402','403','404','405','501','601','602','701','801','802','900','901','997'], gq) - 1 END
  WHEN vac > 0 THEN vac + 3 ELSE ten - 1 END::INTEGER AS level, count(*) AS n FROM (SELECT o_orderkey % 4 + 1 AS ten, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 + 1 ELSE 0 END AS vac,
  CASE o_orderkey % 5 WHEN 0 THEN '101' WHEN 1 THEN '702' WHEN 2 THEN '501' ELSE '000' END AS gq FROM orders) GROUP BY 1"""))
def _(t):
    k = F.col("o_orderkey") % 5
    gq = F.when(k == 0, "101").when(k == 1, "702").when(k == 2, "501").otherwise("000")
    vac = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 7 + 1).otherwise(0)
    level = fr.stacked_unit_level(F.col("o_orderkey") % 4 + 1, vac, gq)
    return t.read("orders").groupBy(level.cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))

