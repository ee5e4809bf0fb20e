"""Linear tabulations of a multi-attribute histogram.

A histogram is rows (keys ..., cell, n) with ``cell`` the row-major index of its
attribute levels. A query is one small factor per attribute; its row index is
row-major over the factor rows. Factors are catalog-sized and enter plans as
literal look-up arrays, so a tabulation is a projection and one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage


@dataclass(frozen=True)
class Factor:
    """Part of a query on one attribute: which levels feed which rows, and how much."""

    size: int
    rows: int
    entries: tuple[tuple[int, int, float], ...]  # (row, level, coef)

    @staticmethod
    def identity(n: int) -> "Factor":
        return Factor(n, n, tuple((i, i, 1.0) for i in range(n)))

    @staticmethod
    def total(n: int) -> "Factor":
        return Factor(n, 1, tuple((0, i, 1.0) for i in range(n)))

    @staticmethod
    def groups(n: int, groups: Sequence[Iterable[int]]) -> "Factor":
        return Factor(n, len(groups), tuple((r, int(i), 1.0) for r, g in enumerate(groups) for i in g))

    @staticmethod
    def weights(matrix: Sequence[Sequence[float]]) -> "Factor":
        n = len(matrix[0])
        return Factor(n, len(matrix), tuple((r, i, float(c)) for r, row in enumerate(matrix) for i, c in enumerate(row) if c))

    def row_levels(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.rows)]
        for r, i, _ in self.entries:
            out[r].append(i)
        return out

    @property
    def is_identity(self) -> bool:
        return self == Factor.identity(self.size)

    @property
    def overlaps(self) -> bool:
        return len({i for _, i, _ in self.entries}) < len(self.entries)

    def stretches(self) -> list[tuple[int, int]] | None:
        """(first, last) level of each row where every row is a stretch of neighbouring levels, counted once each; else None."""
        rows = [sorted(x) for x in self.row_levels()]
        plain = all(c == 1.0 for *_, c in self.entries) and all(x and x[-1] - x[0] + 1 == len(x) == len(set(x)) for x in rows)
        return [(x[0], x[-1]) for x in rows] if plain else None


@dataclass(frozen=True)
class LinearQuery:
    """A named Kronecker query over attributes of the given sizes."""

    name: str
    factors: tuple[Factor, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(f.size for f in self.factors)

    @property
    def row_shape(self) -> tuple[int, ...]:
        return tuple(f.rows for f in self.factors)

    @property
    def num_rows(self) -> int:
        return prod(self.row_shape)

    @property
    def domain_size(self) -> int:
        return prod(self.shape)


def tabular_query(
    name: str,
    shape: Sequence[int],
    groupings: Mapping[int, Sequence[Iterable[int]]] | None = None,
    margins: Sequence[int] = (),
) -> LinearQuery:
    """Group some attributes, sum out others, keep the rest; arguments are checked."""
    groupings = dict(groupings or {})
    if not shape or any(not isinstance(s, int) or s < 1 for s in shape):
        raise ValueError("attribute sizes must be positive integers")
    if len(set(margins)) != len(margins) or any(not 0 <= m < len(shape) for m in margins):
        raise ValueError("summed attributes must be distinct and exist")
    if set(groupings) & set(margins):
        raise ValueError("an attribute cannot be both grouped and summed out")
    for d, groups in groupings.items():
        if not 0 <= d < len(shape):
            raise ValueError(f"grouped attribute {d} does not exist")
        for g in groups:
            g = list(g)
            if len(set(g)) != len(g) or any(not 0 <= i < shape[d] for i in g):
                raise ValueError(f"group {g} of attribute {d} repeats or exceeds its levels")
    factors = [
        Factor.groups(n, groupings[d]) if d in groupings else Factor.total(n) if d in margins else Factor.identity(n)
        for d, n in enumerate(shape)
    ]
    return LinearQuery(name, tuple(factors))


def subset_query(name: str, shape: Sequence[int], subset: Mapping[int, Sequence[int]], margins: Sequence[int] = ()) -> LinearQuery:
    """Keep only some levels per attribute, then sum out ``margins``; repeated levels are rejected."""
    for d, levels in subset.items():
        if len(set(levels)) != len(levels):
            raise ValueError(f"subset of attribute {d} repeats a level")
    groups = {d: ([list(s)] if d in margins else [[i] for i in s]) for d, s in subset.items()}
    return tabular_query(name, shape, groups, [m for m in margins if m not in subset])


def kron_query(name: str, matrices: Sequence[Sequence[Sequence[float]]]) -> LinearQuery:
    """Arbitrary coefficient matrix per attribute."""
    return LinearQuery(name, tuple(Factor.weights(m) for m in matrices))


# ---- expressions --------------------------------------------------------------------------


def int_array(values: Iterable[int | None]) -> Column:
    """Literal look-up array, written as text: one plan node to build instead of one per level."""
    return F.expr("array(" + ", ".join("cast(null as int)" if v is None else str(int(v)) for v in values) + ")")


def level_of(index: Column, shape: Sequence[int], d: int) -> Column:
    """Level of attribute ``d`` in a row-major index."""
    return ((index / F.lit(prod(shape[d + 1 :]))).cast("bigint") % shape[d]).cast("int")


def levels_of(index: Column, shape: Sequence[int]) -> list[Column]:
    return [level_of(index, shape, d) for d in range(len(shape))]


def ravel(levels: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major index of attribute levels."""
    parts = [lv.cast("bigint") * prod(shape[d + 1 :]) for d, lv in enumerate(levels)]
    return reduce(lambda a, b: a + b, parts)


def _with_rows(df: DataFrame, query: LinearQuery, cell: str) -> DataFrame:
    """Add ``row_ix`` and ``coef``; a cell in several rows is repeated, one in none is dropped."""
    shape, row_shape = query.shape, query.row_shape
    rows, coef = [], F.lit(1.0)
    for d, f in enumerate(query.factors):
        if f.rows == 1 and len(f.entries) == f.size and all(c == 1.0 for *_, c in f.entries):
            rows.append(F.lit(0))
            continue
        lv = level_of(F.col(cell), shape, d)
        if f.is_identity:
            rows.append(lv)
            continue
        by_level: list[list[tuple[int, float]]] = [[] for _ in range(f.size)]
        for r, i, c in f.entries:
            by_level[i].append((r, c))
        plain = all(c == 1.0 for *_, c in f.entries)
        if not f.overlaps:
            look = int_array(b[0][0] if b else None for b in by_level)
            df = df.withColumn(f"_r{d}", F.get(look, lv)).filter(F.col(f"_r{d}").isNotNull())
            rows.append(F.col(f"_r{d}"))
            if not plain:
                coef = coef * F.get(F.array(*[F.lit(b[0][1] if b else 0.0) for b in by_level]), lv)
        else:
            none = F.array().cast("array<struct<r:int,c:double>>")
            look = F.array(*[
                F.array(*[F.struct(F.lit(r).cast("int").alias("r"), F.lit(c).alias("c")) for r, c in b]) if b else none
                for b in by_level
            ])
            df = df.withColumn(f"_e{d}", F.explode(F.get(look, lv)))
            rows.append(F.col(f"_e{d}")["r"])
            if not plain:
                coef = coef * F.col(f"_e{d}")["c"]
    return df.withColumn("row_ix", ravel(rows, row_shape)).withColumn("coef", coef)


def answer(cells: DataFrame, query: LinearQuery, keys: Sequence[str] = (), value: str = "n", cell: str = "cell") -> DataFrame:
    """(keys, row_ix, value) of a query over histogram rows; rows without any cell are absent.

    Overlapping stretches of levels (prefixes, ranges, splits) are differences
    of running sums; other overlapping groups repeat a cell once per group.
    """
    for d, f in enumerate(query.factors):
        if f.overlaps and (bounds := f.stretches()):
            return _answer_stretches(cells, query, d, bounds, keys, value, cell)
    out = _with_rows(cells.select(*keys, cell, value), query, cell)
    plain = all(c == 1.0 for f in query.factors for *_, c in f.entries)
    v = F.col(value) if plain else F.col("coef") * F.col(value)
    return out.groupBy(*keys, "row_ix").agg(F.sum(v).alias(value))


def _answer_stretches(cells: DataFrame, query: LinearQuery, d: int, bounds: Sequence[tuple[int, int]], keys: Sequence[str], value: str, cell: str) -> DataFrame:
    """Attribute ``d`` is kept whole, its running sums are formed once per key and other rows, and each stretch is two look-ups."""
    n, stride = query.factors[d].size, prod(query.row_shape[d + 1 :])
    plain = LinearQuery(query.name, (*query.factors[:d], Factor.identity(n), *query.factors[d + 1 :]))
    per = answer(cells, plain, keys, value, cell)
    level = level_of(F.col("row_ix"), plain.row_shape, d)
    held = per.select(*keys, (F.col("row_ix") - level.cast("bigint") * stride).alias("_rest"), level.alias("_level"), value)
    held = held.groupBy(*keys, "_rest").agg(F.map_from_entries(F.collect_list(F.struct("_level", value))).alias("_m"))  # n entries at most
    every, kind = F.sequence(F.lit(0), F.lit(n - 1)), per.schema[value].dataType
    zero = F.lit(0).cast(kind)

    def running(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    sums = running(F.transform(every, lambda i: F.coalesce(F.try_element_at("_m", i), zero)), zero)
    seen = running(F.transform(every, lambda i: F.try_element_at("_m", i).isNotNull().cast("int")), F.lit(0))
    held = held.select(*keys, "_rest", sums.alias("_s"), seen.alias("_n"))
    first, behind = int_array(a for a, _ in bounds), int_array(b + 1 for _, b in bounds)
    between = lambda c, r: F.get(c, F.get(behind, r)) - F.get(c, F.get(first, r))
    rows = F.transform(F.sequence(F.lit(0), F.lit(len(bounds) - 1)), lambda r: F.struct(r.alias("_r"), between(F.col("_s"), r).alias(value), between(F.col("_n"), r).alias("_seen")))
    out = held.select(*keys, "_rest", F.inline(rows)).filter("_seen > 0")
    high, low = F.floor(F.col("_rest") / (n * stride)), F.col("_rest") % stride
    return out.select(*keys, ((high * len(bounds) + F.col("_r")) * stride + low).cast("bigint").alias("row_ix"), F.col(value).cast(kind).alias(value))


def zero_fill(answers: DataFrame, nodes: DataFrame, num_rows: int, key: str, value: str = "n") -> DataFrame:
    """Every (node, row) of the domain, 0 where nothing was counted."""
    domain = nodes.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(num_rows - 1).cast("bigint"))).alias("row_ix"))
    return domain.join(answers, [key, "row_ix"], "left").select(
        key, "row_ix", F.coalesce(F.col(value), F.lit(0)).alias(value)
    )


def query_cell(spark: SparkSession, query: LinearQuery) -> DataFrame:
    """(query, row_ix, cell, coef): the sparse matrix of a query, generated in parallel from its cell range."""
    out = _with_rows(spark.range(query.domain_size).withColumnRenamed("id", "cell"), query, "cell")
    return out.select(F.lit(query.name).alias("query"), "row_ix", "cell", "coef")


def with_row_levels(df: DataFrame, query: LinearQuery, names: Sequence[str]) -> DataFrame:
    """Attach the per-attribute row numbers of ``row_ix``: the answer with its shape."""
    return df.select("*", *[lv.alias(n) for n, lv in zip(names, levels_of(F.col("row_ix"), query.row_shape))])


# ---- queries as sparse relations (query, row_ix, cell, coef) -------------------------------


def answer_by_matrix(cells: DataFrame, matrix: DataFrame, keys: Sequence[str] = (), value: str = "n") -> DataFrame:
    """Sparse matrix times histogram: one join on the cell."""
    return (
        matrix.join(cells.select(*keys, "cell", value), "cell")
        .groupBy("query", *keys, "row_ix").agg(F.sum(F.col("coef") * F.col(value)).alias(value))
    )


def check_dimension(matrix: DataFrame, size: int) -> DataFrame:
    """The matrix unchanged, raising on a cell outside the histogram."""
    bad = F.assert_true((F.col("cell") >= 0) & (F.col("cell") < size), F.lit("query and histogram differ in size"))
    return matrix.filter(F.coalesce(bad.cast("boolean"), F.lit(True)))


def predicate_counts(cells: DataFrame, predicate: Column, keys: Sequence[str] = (), value: str = "n") -> DataFrame:
    """Rows 0 and 1: what satisfies the predicate and what does not."""
    return cells.groupBy(*keys, F.when(predicate, 0).otherwise(1).cast("bigint").alias("row_ix")).agg(F.sum(value).alias(value))


def stub_query(spark: SparkSession, name: str, num_rows: int) -> DataFrame:
    """All-zero answers of the given length."""
    return spark.range(num_rows).select(F.lit(name).alias("query"), F.col("id").alias("row_ix"), F.lit(0.0).alias("n"))


def multi_histogram(answers: Sequence[DataFrame], coefs: Sequence[float], keys: Sequence[str] = (), value: str = "n") -> DataFrame:
    """Weighted sum of equally long answers that come from different histograms."""
    parts = [a.select(*keys, "row_ix", (F.lit(float(c)) * F.col(value)).alias(value)) for a, c in zip(answers, coefs, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "row_ix").agg(F.sum(value).alias(value))


def stacked(name: str, parts: Sequence[tuple[DataFrame, int]], domain: DataFrame | None = None) -> DataFrame:
    """Matrices below one another: (matrix, number of rows) each; ``domain`` keeps only some cells."""
    out, offset = None, 0
    for m, n in parts:
        p = m.select(F.lit(name).alias("query"), (F.col("row_ix") + offset).alias("row_ix"), "cell", "coef")
        out = p if out is None else out.unionByName(p)
        offset += n
    return out if domain is None else out.join(domain.select("cell"), "cell", "left_semi").select("query", "row_ix", "cell", "coef")


def combination(name: str, parts: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted sum of matrices of equal shape; weights default to 1."""
    weights = [1.0] * len(parts) if weights is None else weights
    scaled = [m.select("row_ix", "cell", (F.lit(float(w)) * F.col("coef")).alias("coef")) for m, w in zip(parts, weights, strict=True)]
    return (
        reduce(DataFrame.unionByName, scaled).groupBy("row_ix", "cell").agg(F.sum("coef").alias("coef"))
        .filter("coef <> 0").select(F.lit(name).alias("query"), "row_ix", "cell", "coef")
    )


def overlap_check(matrix: DataFrame) -> DataFrame:
    """(query, cell, rows): cells counted by more than one row."""
    return matrix.groupBy("query", "cell").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def sensitivity(matrix: DataFrame) -> DataFrame:
    """(query, l1, l2, integer): largest column norm; the 2-norm only where it follows from l1 = 1."""
    whole = F.bool_and(F.col("coef") == F.floor("coef"))
    per = matrix.groupBy("query", "cell").agg(F.sum(F.abs("coef")).alias("s"), whole.alias("w"))
    return per.groupBy("query").agg(F.max("s").alias("l1"), F.bool_and("w").alias("is_integer")).select(
        "query", "l1", F.when(F.col("l1") == 1, F.lit(1.0)).alias("l2"), "is_integer"
    )


def query_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries in only one of two matrices; empty means the queries are equal."""
    cols = ["row_ix", "cell", "coef"]
    x, y = a.filter("coef <> 0").select(*cols), b.filter("coef <> 0").select(*cols)
    return x.exceptAll(y).unionAll(y.exceptAll(x))


def cover_tree(sets: Sequence[tuple[str, ...]], sizes: Mapping[str, int]) -> list[tuple[tuple[str, ...], tuple[str, ...] | None]]:
    """(set, the smallest computed superset or None for the first), in an order in which each comes after its superset.

    The first is the union of all sets, asked for or not. ``sizes`` are the
    numbers of values of the attributes; a table has at most their product.
    """
    top = tuple(d for d in sizes if any(d in s for s in sets))
    rows, done = lambda s: prod(sizes[d] for d in s), [top]
    out: list[tuple[tuple[str, ...], tuple[str, ...] | None]] = [(top, None)]
    for s in sorted({tuple(s) for s in sets} - {top}, key=lambda s: (-len(s), s)):
        out.append((s, min((t for t in done if set(s) < set(t)), key=lambda t: (rows(t), t))))
        done.append(s)
    return out


def marginals(df: DataFrame, dims: Sequence[str], ways: Sequence[int], value: str = "n", include: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """All n-way marginals; the rows are read once, and each marginal is summed from the smallest one computed before that holds it.

    Adds ``query`` ('a * b'; the full cross is 'detailed', the empty one
    'total') and ``ways``. ``include`` must be in every cross, ``ignore``
    never. No rows give no rows. Tables that others are summed from are
    written; at most one per set of attributes.
    """
    from itertools import combinations

    use = [d for d in dims if d not in ignore]
    sets = [s for w in sorted(ways) for s in combinations(use, w) if set(include) <= set(s)]
    held = {d for s in sets for d in s}
    top = [d for d in use if d in held]
    full = cut_lineage(df.groupBy(*top).agg(F.sum(value).alias(value)) if top else df.groupBy(F.lit(0).alias("_")).agg(F.sum(value).alias(value)), "full")
    counts = full.agg(F.lit(0).alias("_"), *[F.count_distinct(d).alias(d) for d in top]).first()
    tree = cover_tree(sets, {d: counts[d] + 1 for d in top})
    parents, tables, out = {p for _, p in tree}, {tuple(top): full}, None
    for s, parent in tree:
        if parent is not None:
            t = tables[parent].groupBy(*s, *([] if s else [F.lit(0).alias("_")])).agg(F.sum(value).alias(value))
            tables[s] = cut_lineage(t, "marginal") if s in parents else t
        if s in sets:
            name = "detailed" if list(s) == list(dims) else " * ".join(s) or "total"
            cols = [F.col(d) if d in s else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in use]
            part = tables[s].select(*cols, F.lit(name).alias("query"), F.lit(len(s)).alias("ways"), value)
            out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no set of attributes was asked for")
    return out
