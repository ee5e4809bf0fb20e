"""Workloads: lists of published query rows, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemtally.catalog import tables as tb
from stemtally.catalog.attributes import RACES, race_combinations
from stemtally.catalog.schemas import BY, Schema, UnknownQuery, schema
from stemtally.operators.tabulate import LinearQuery, _with_rows, answer, int_array, level_of, ravel

# fixed values: source names of the attributes, and what is subtracted from a code to get a level
PL94_SOURCE = (("hhgq", "hhgq", 0), ("voting_age", "votingage", 1), ("hispanic", "hispanic", 1), ("cenrace", "cenrace", 1))


def interval_codes(lo: Column | int, hi: Column | int, top: int = 63) -> Column:
    """Two-digit codes from lo to hi, clipped to 1..top."""
    lo = F.lit(lo) if isinstance(lo, int) else lo
    hi = F.lit(hi) if isinstance(hi, int) else hi
    inside = F.filter(F.sequence(F.lit(1), F.lit(top)), lambda i: (i >= lo) & (i <= hi))
    return F.transform(inside, lambda i: F.lpad(i.cast("string"), 2, "0"))


def _in(attr: str, codes: Sequence[str]) -> str:
    return f"{attr} in ({', '.join(repr(c) for c in codes)})"


def redistricting_predicates() -> list[tuple[str, str]]:
    """The 298 redistricting queries by rule: totals, then every race by how many it combines."""
    counts = [len(c) for c in race_combinations(RACES)]
    code = lambda lo, hi: [f"{i:02d}" for i in range(lo, hi + 1)]
    races = []
    for k in range(1, len(RACES) + 1):
        lo, hi = counts.index(k) + 1, counts.index(k) + counts.count(k)
        if k == 2:
            races.append(code(lo, len(counts)))
        races.append(code(lo, hi))
        races += [[c] for c in code(lo, hi)]
    voting, no_hisp, hisp = "voting_age in ('2')", "hispanic in ('1')", "hispanic in ('2')"
    gq = ["1234567", "1234", "1", "2", "3", "4", "567", "5", "6", "7"]
    join = lambda *p: " and ".join(x for x in p if x)
    blocks = {
        1: [""] + [_in("cenrace", r) for r in races],
        2: ["", hisp, no_hisp] + [join(no_hisp, _in("cenrace", r)) for r in races],
        3: [voting] + [join(voting, _in("cenrace", r)) for r in races],
        4: [voting, join(voting, hisp), join(voting, no_hisp)] + [join(voting, no_hisp, _in("cenrace", r)) for r in races],
        5: [_in("hhgq", list(g)) for g in gq],
    }
    return [(f"P{t:03d}{i:04d}", p) for t, ps in blocks.items() for i, p in enumerate(ps, 1)]


def redistricting_workload(spark: SparkSession) -> DataFrame:
    """(query, predicate)."""
    return spark.createDataFrame(redistricting_predicates(), "query string, predicate string")


def parse_predicates(df: DataFrame) -> DataFrame:
    """(query, attr, levels): 'a in (..) and b in (..)' to level numbers; attributes not named are absent."""
    clauses = df.select("query", F.explode(F.split("predicate", " and ")).alias("clause")).filter("clause <> ''")
    source = F.regexp_extract("clause", r"^(\w+) in", 1)
    name = F.create_map(*[F.lit(x) for s, a, _ in PL94_SOURCE for x in (s, a)])
    offset = F.create_map(*[F.lit(x) for s, _, o in PL94_SOURCE for x in (s, o)])
    codes = F.regexp_extract_all("clause", F.lit(r"'(\d+)'"), 1)
    return clauses.select(
        "query", F.try_element_at(name, source).alias("attr"),
        F.transform(codes, lambda c: c.cast("int") - F.try_element_at(offset, source)).alias("levels"),
    )


def workload_cells(workload: DataFrame, parsed: DataFrame, s: Schema) -> DataFrame:
    """(query, cell, coef): exactly the cells each query counts, unfolded from its level lists."""
    per = parsed.groupBy("query").pivot("attr", s.dims).agg(F.first("levels"))
    out = workload.select("query").join(per, "query", "left")
    for d, n in zip(s.dims, s.shape):
        out = out.withColumn(d, F.explode(F.coalesce(F.col(d), F.sequence(F.lit(0), F.lit(n - 1)))))
    cell = sum((F.col(d) * prod(s.shape[i + 1 :]) for i, d in enumerate(s.dims)), F.lit(0))
    return out.select("query", cell.cast("bigint").alias("cell"), F.lit(1.0).alias("coef"))


# ---- table workloads ------------------------------------------------------------------------


def expand_workload(spark: SparkSession, kind: str) -> DataFrame:
    """(TABLE, QUERY, LEVEL, col_index, seq): one row per reported number, in listed order."""
    s = schema(tb.WORKLOAD_SCHEMA[kind])
    rows = []
    for i, (t, q) in enumerate((t, q) for t, qs in tb.workload(kind).items() for q in qs):
        if q == "total":
            continue
        if s.knows(q):
            rows.append((i, t, q, s.labels(q)))
    listed = spark.createDataFrame(rows, "seq int, TABLE string, QUERY string, labels array<array<string>>")
    n = F.aggregate("labels", F.lit(1), lambda a, x: a * F.size(x))
    each = listed.withColumn("col_index", F.explode(F.sequence(F.lit(0), n - 1)))
    below = lambda d: F.aggregate(  # noqa: E731  rows spanned by one step of attribute d
        F.slice("labels", d + 2, F.size("labels")), F.lit(1), lambda a, x: a * F.size(x)
    )
    level = F.array_join(
        F.transform("labels", lambda x, d: F.get(x, (F.floor(F.col("col_index") / below(d)) % F.size(x)).cast("int"))), BY
    )
    out = each.select("TABLE", "QUERY", level.alias("LEVEL"), "col_index", "seq")
    if kind == "person":
        total = spark.createDataFrame([("PCT12", "total", "Total", 0, 1 << 30)], out.schema)
        out = out.unionByName(total)
    return out


def unreported() -> Column:
    """Rows of cross tables that are not published."""
    t, q, lv = F.col("TABLE"), F.col("QUERY"), F.col("LEVEL")
    return (
        ((t == "PCT8") & (q == "childage7lev * hhspchildothgq") & F.left(lv, F.lit(11)).isin("Householder", "In Group Qu"))
        | ((t == "PCT8") & (q == "childage7lev * hhinstlevels") & lv.startswith("Household"))
        | (t.startswith("PCT9") & q.startswith("65andover * relgq8cats * sex") & ~lv.startswith("Householder"))
        | (t.startswith("PCT9") & q.startswith("65andover * relgq_4_groups") & ~lv.startswith("Householder"))
        | (t.startswith("PCT10") & q.startswith("dhch_hhtype_p12_part1") & (F.col("col_index") != 0))
    )


def number_rows(rows: DataFrame) -> DataFrame:
    """Add row_num in listed order. Catalog-sized: one window over at most a few thousand rows."""
    return rows.withColumn("row_num", F.row_number().over(Window.orderBy("seq", "col_index"))).drop("seq")


def published_rows(spark: SparkSession, kind: str) -> DataFrame:
    return number_rows(expand_workload(spark, kind).filter(~unreported()))


def in_family(names: Sequence[str], table: str = "TABLE") -> Column:
    """Table is one of the names, or one of them followed by capital letters."""
    return F.col(table).rlike(f"^({'|'.join(names)})[A-Z]*$")


def tables_of_marginal(name: str) -> list[str]:
    """Table families answered from a marginal histogram."""
    found = tb.marginals()
    if name not in found:
        raise UnknownQuery(f"no tables are planned for the marginal {name!r}")
    return found[name]


def answer_many(cells: DataFrame, queries: Sequence[LinearQuery], keys: Sequence[str] = (), value: str = "n") -> DataFrame:
    """(keys, query, row_ix, value) of several queries in one scan and one aggregation.

    Every histogram row is unfolded to the rows it feeds and combined before
    the shuffle. Overlapping queries are answered on their own and appended.
    """
    simple = [q for q in queries if not any(f.overlaps for f in q.factors) and all(c == 1.0 for f in q.factors for *_, c in f.entries)]
    out = None
    if simple:
        entries = F.array(*[F.struct(F.lit(q.name).alias("query"), _row_or_null(q).alias("row_ix")) for q in simple])
        flat = cells.select(*keys, value, F.inline(entries)).filter("row_ix is not null")
        out = flat.groupBy(*keys, "query", "row_ix").agg(F.sum(value).alias(value))
    for q in queries:
        if q not in simple:
            part = answer(cells, q, keys, value).select(*keys, F.lit(q.name).alias("query"), "row_ix", value)
            out = part if out is None else out.unionByName(part)
    return out


def _row_or_null(q: LinearQuery) -> Column:
    rows = []
    for d, f in enumerate(q.factors):
        if f.rows == 1 and len(f.entries) == f.size:
            rows.append(F.lit(0))
            continue
        lv = level_of(F.col("cell"), q.shape, d)
        if f.is_identity:
            rows.append(lv)
            continue
        of = {i: r for r, i, _ in f.entries}
        rows.append(F.get(int_array(of.get(i) for i in range(f.size)), lv))
    return ravel(rows, q.row_shape)


def answer_workload(cells: DataFrame, rows: DataFrame, s: Schema, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(TABLE, QUERY, LEVEL, row_num, keys, n) for published rows; queries not in the schema are skipped."""
    known = [s.query(n) for n in names if s.knows(n)]
    got = answer_many(cells, known, keys).withColumnRenamed("query", "QUERY")
    return rows.withColumn("row_ix", F.col("col_index").cast("bigint")).join(got, ["QUERY", "row_ix"]).select(
        "TABLE", "QUERY", "LEVEL", "row_num", *keys, "n"
    )
