"""A measured tree derived from the order tables, as DataFrames and as SQL.

Tree: root '' -> region (1 character) -> nation (3) -> customer (13).
Histogram of a node: its orders by status {F,O,P} and priority {1..5}, 15 cells.
Measurements add repeatable arithmetic noise; nation 13 and every fifth
customer of nation 7 are bypassed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.keys import Spine, prefix
from stemtally.functions.lineage import cut_lineage
from stemtally.operators import gls_diagonal as gd
from stemtally.operators.covers import coarsest_cover

SPINE = Spine(("Root", "Region", "Nation", "Customer"), (0, 1, 3, 13))
SHAPE = (3, 5)
CELLS = 15
STATUS = ("F", "O", "P")
VARIANCE = (0.5, 1.0, 2.0, 4.0)


class Tables:
    """The given parquet tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def leaf(self) -> DataFrame:
        code = F.concat(
            F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"),
            F.lpad(F.col("c_custkey").cast("string"), 10, "0"),
        )
        return self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            code.alias("geocode"), F.col("c_custkey").alias("key"), "c_mktsegment"
        )

    def level(self, depth: int) -> DataFrame:
        """Distinct geocodes of a level."""
        return self.leaf.select(prefix("geocode", SPINE.widths[depth]).alias("geocode")).distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        out = None
        for d in range(4):
            part = self.level(d).select(F.lit(d).alias("depth"), "geocode")
            out = part if out is None else out.unionByName(part)
        return out

    @cached_property
    def order_cells(self) -> DataFrame:
        """(key, cell, n): orders per customer and cell."""
        return self.read("orders").groupBy(F.col("o_custkey").alias("key"), order_cell().alias("cell")).agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def _leaf_arrays(self) -> DataFrame:
        """(geocode, key, n): orders per customer, one number per cell."""
        cell = order_cell()
        n = self.read("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array(*[F.count_if(cell == i) for i in range(CELLS)]).alias("n"))
        none = F.array(*[F.lit(0).cast("bigint")] * CELLS)
        return cut_lineage(self.leaf.select("geocode", "key").join(n, "key", "left").select("geocode", "key", F.coalesce("n", none).alias("n")), "leaf_counts")

    def true_counts(self, depth: int) -> DataFrame:
        """(geocode, cell, n, key) with every cell present."""
        if depth == 3:
            return self._leaf_counts
        if depth == 2:
            return self._nation_counts
        return self._rolled_up(depth)

    @cached_property
    def _nation_counts(self) -> DataFrame:
        """Written, so that the levels above do not come back to the leaves."""
        return cut_lineage(self._rolled_up(2), "nation_counts")

    def _rolled_up(self, depth: int) -> DataFrame:
        below = self.true_counts(depth + 1)
        up = below.groupBy(prefix("geocode", SPINE.widths[depth]).alias("geocode"), "cell").agg(F.sum("n").alias("n"))
        key = {0: F.lit(0), 1: F.col("geocode"), 2: F.substring("geocode", 2, 2)}[depth].cast("bigint")
        return up.withColumn("key", key)

    @cached_property
    def _leaf_counts(self) -> DataFrame:
        return self._leaf_arrays.select("geocode", "key", F.posexplode("n").alias("cell", "n"))

    def measured(self, depth: int) -> DataFrame:
        """(geocode, cell, value, variance), variance infinite where bypassed."""
        noise = added_noise(F.col("key"), F.col("cell"))
        off = self.bypassed(depth)
        v = F.when(off, F.lit(float("inf"))).otherwise(F.lit(VARIANCE[depth]))
        return self.true_counts(depth).select(
            "geocode", "cell", (F.col("n") + noise).cast("double").alias("value"), v.alias("variance")
        )

    @cached_property
    def _measured_leaves(self) -> DataFrame:
        """(geocode, value, variance, sum) of the leaves: :meth:`measured` as arrays, never a row per cell. A geocode that comes twice has each cell twice."""
        n = self._leaf_arrays.groupBy("geocode").agg(F.collect_list(F.struct("key", "n")).alias("s"), F.first("key").alias("key"))
        at = lambda x, i: (F.get(x["n"], i) + added_noise(x["key"], i)).cast("double")
        once = F.transform(F.get("s", F.lit(0))["n"], lambda x, i: (x + added_noise(F.col("key"), i)).cast("double"))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.array_sort(F.transform("s", lambda x: at(x, i)))))
        v = F.when(self.bypassed(SPINE.depth), F.lit(float("inf"))).otherwise(F.lit(VARIANCE[SPINE.depth]))
        some = F.filter("value", lambda x: x.isNotNull())
        return n.select("geocode", F.when(F.size("s") == 1, once).otherwise(every).alias("value"), v.alias("variance")).withColumn(
            "sum", F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))
        )

    @staticmethod
    def bypassed(depth: int) -> Column:
        nation = F.substring("geocode", 2, 2)
        if depth == 2:
            return nation == "13"
        if depth == 3:
            return (nation == "07") & (F.col("key") % 5 == 0)
        return F.lit(False)

    def own(self, depth: int) -> DataFrame:
        return gd.single_estimate(self.measured(depth))

    def passes(self, cut=None) -> gd.DiagonalPasses:
        return gd.DiagonalPasses(SPINE, [self.own(d) for d in range(4)], cut=cut or cut_lineage)

    @cached_property
    def part_cover(self) -> DataFrame:
        """Market segments of single regions; only those of one region hold several bypassed customers of a nation."""
        entity = F.concat("c_mktsegment", F.lit("/"), F.left("geocode", F.lit(1)))
        return coarsest_cover(self.leaf.select(F.col("geocode").alias("leaf"), entity.alias("entity")), SPINE)

    @cached_property
    def segment_cover(self) -> DataFrame:
        return coarsest_cover(self.leaf.select(F.col("geocode").alias("leaf"), F.col("c_mktsegment").alias("entity")), SPINE)

    def second_arrays(self, depth: int) -> DataFrame:
        """A second, independent measurement of the three statuses and their total, in the form of :meth:`arrays`."""
        status = F.floor(F.col("cell") / 5).cast("int")
        off = self.bypassed(depth)
        cells = self.true_counts(depth).groupBy("geocode", "key", status.alias("cell")).agg(F.sum("n").alias("n")).select(
            "geocode", "cell", (F.col("n") + (F.col("key") * 7 + F.col("cell")) % 11 - 5).cast("double").alias("value"),
            F.when(off, F.lit(float("inf"))).otherwise(F.lit(VARIANCE[depth] * 1.5)).alias("variance"),
        )
        detailed = cells.groupBy("geocode").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("s"), F.first("variance").alias("variance")).select(
            "geocode", F.lit("detailed").alias("query_name"), F.transform("s", lambda x: x["value"]).alias("value"), "variance"
        )
        total = cells.groupBy("geocode").agg(F.sum("value").alias("s"), F.first("variance").alias("variance")).select(
            "geocode", F.lit("total").alias("query_name"), F.array(F.col("s") + 2.0).alias("value"), (F.col("variance") * 3).alias("variance")
        )
        return detailed.unionByName(total).select(F.lit(depth).alias("depth"), "*")

    def arrays(self, depth: int) -> DataFrame:
        """Measurements as published: (depth, geocode, query_name, value, variance) for 'detailed' and 'total'."""
        if depth == SPINE.depth:
            cells = self._measured_leaves
        else:
            cells = self.measured(depth).groupBy("geocode").agg(
                F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("s"), F.first("variance").alias("variance"), F.sum("value").alias("sum")
            ).select("geocode", F.transform("s", lambda x: x["value"]).alias("value"), "variance", "sum")
        detailed = cells.select("geocode", F.lit("detailed").alias("query_name"), "value", "variance")
        total = cells.select("geocode", F.col("sum").alias("s"), "variance").select(
            "geocode", F.lit("total").alias("query_name"), F.array(F.col("s") + 3.0).alias("value"),
            # a bypassed nation keeps a finite total, which must not count
            F.when(F.lit(depth == 2), VARIANCE[depth] * 2.0).otherwise(F.col("variance") * 2).alias("variance"),
        )
        return detailed.unionByName(total).select(F.lit(depth).alias("depth"), "*")


WIDE = (8, 2, 2, 63)  # attributes of a wide histogram of orders
WIDE_CELLS = 2016


def wide_cell() -> Column:
    """Order number modulo 8, finished or not, urgent or not, day of the year modulo 63."""
    status, urgent = (F.col("o_orderstatus") != "F").cast("int"), (F.left("o_orderpriority", F.lit(1)).cast("int") > 2).cast("int")
    return (((F.col("o_orderkey") % 8) * 2 + status) * 2 + urgent) * 63 + F.dayofyear("o_orderdate") % 63


def wide_measurements(t: Tables) -> DataFrame:
    """(depth, geocode, query_name, value, variance) of all cells, of the first attribute and of the total, over the wide histogram.

    Counts stay lists of (cell, orders) up the tree; arrays of all cells are made where they are read, in one go per unit.
    """
    n = t.read("orders").groupBy(F.col("o_custkey").alias("key"), wide_cell().cast("int").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = n.filter("cell is not null").groupBy("key").agg(F.collect_list(F.struct("cell", "n")).alias("s"))  # WIDE_CELLS entries at most
    level = cut_lineage(t.leaf.join(held, "key", "left").select("geocode", "key", F.col("s.cell").alias("cells"), F.col("s.n").alias("n")), "wide")
    out = None
    for d in range(SPINE.depth, -1, -1):
        if d < SPINE.depth:
            each = level.select(prefix("geocode", SPINE.widths[d]).alias("geocode"), F.inline_outer(F.arrays_zip("cells", "n")))
            sums = each.groupBy("geocode", "cells").agg(F.sum("n").alias("n"))  # units without orders keep one row without a cell
            level = sums.groupBy("geocode").agg(F.collect_list(F.when(F.col("cells").isNotNull(), F.struct("cells", "n"))).alias("s"))
            key = {0: F.lit(0), 1: F.col("geocode"), 2: F.substring("geocode", 2, 2)}[d].cast("bigint")
            level = cut_lineage(level.select("geocode", key.alias("key"), F.col("s.cells").alias("cells"), F.col("s.n").alias("n")), "wide")
        v = F.when(t.bypassed(d), F.lit(float("inf"))).otherwise(F.lit(VARIANCE[d]))
        rows = level.select(F.lit(d).alias("depth"), "geocode", F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNotNull().alias("known"), "cells", "n", v.alias("variance"))
        if d == SPINE.depth:  # lists are small files, their arrays are not: as many tasks as a shuffle has
            rows = rows.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "geocode")
        part = rows.mapInPandas(_wide_answers, "depth int, geocode string, query_name string, value array<double>, variance double")
        out = part if out is None else out.unionByName(part)
    return out


def _wide_answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Noisy answers of the units; the rows of a unit follow one another."""
    i = np.arange(WIDE_CELLS)
    for whole in batches:
        for a in range(0, len(whole), 1000):
            pdf = whole.iloc[a : a + 1000]
            y = np.zeros((len(pdf), WIDE_CELLS))
            for u, (cells, n) in enumerate(zip(pdf["cells"], pdf["n"], strict=True)):
                if cells is not None:
                    y[u, np.asarray(cells, dtype=int)] = n
            y += np.fmod(pdf["key"].to_numpy(np.int64)[:, None] * 31 + i * 17, 13) - 6  # as added_noise
            y[~pdf["known"].to_numpy(bool)] = np.nan
            first = y.reshape(len(y), WIDE[0], -1).sum(axis=2) + np.arange(WIDE[0])
            total, v, depth = y.sum(axis=1) + 3, pdf["variance"].to_numpy(np.float64), pdf["depth"].to_numpy()
            value = [x for u in range(len(y)) for x in (y[u], first[u], total[u : u + 1])]
            yield pd.DataFrame({
                "depth": depth.repeat(3), "geocode": pdf["geocode"].to_numpy().repeat(3), "query_name": ["detailed", "first", "total"] * len(y),
                "value": pd.Series(value, dtype=object), "variance": np.stack([v, v / 2, np.array(VARIANCE)[depth] * 2], axis=1).ravel(),
            })


def added_noise(key: Column, cell: Column) -> Column:
    return (key * 31 + cell * 17) % 13 - 6


def order_cell() -> Column:
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return status * 5 + F.left("o_orderpriority", F.lit(1)).cast("int") - 1


# ---- the same in SQL ----------------------------------------------------------------------

_CTES: list[tuple[str, str]] = [
    ("leaf", """SELECT CAST(n_regionkey AS VARCHAR) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS geocode,
      c_custkey AS key, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    ("nodes", """SELECT DISTINCT 0 AS depth, '' AS geocode FROM leaf UNION ALL SELECT DISTINCT 1, substr(geocode, 1, 1) FROM leaf
      UNION ALL SELECT DISTINCT 2, substr(geocode, 1, 3) FROM leaf UNION ALL SELECT 3, geocode FROM leaf"""),
    ("ordcell", """SELECT o_custkey AS key, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 5
      + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS cell, count(*) AS n FROM orders GROUP BY 1, 2"""),
    ("true3", """SELECT l.geocode, l.key, CAST(r.cell AS INTEGER) AS cell, coalesce(c.n, 0) AS n FROM leaf l CROSS JOIN range(15) r(cell)
      LEFT JOIN ordcell c ON c.key = l.key AND c.cell = r.cell"""),
    ("true2", "SELECT substr(geocode, 1, 3) AS geocode, CAST(substr(geocode, 2, 2) AS BIGINT) AS key, cell, CAST(sum(n) AS BIGINT) AS n FROM true3 GROUP BY ALL"),
    ("true1", "SELECT substr(geocode, 1, 1) AS geocode, CAST(substr(geocode, 1, 1) AS BIGINT) AS key, cell, CAST(sum(n) AS BIGINT) AS n FROM true3 GROUP BY ALL"),
    ("true0", "SELECT '' AS geocode, CAST(0 AS BIGINT) AS key, cell, CAST(sum(n) AS BIGINT) AS n FROM true3 GROUP BY ALL"),
]
_OFF = {0: "false", 1: "false", 2: "substr(geocode, 2, 2) = '13'", 3: "substr(geocode, 2, 2) = '07' AND key % 5 = 0"}
for _d in (3, 2, 1, 0):
    _CTES.append((f"own{_d}", f"""SELECT geocode, cell, CASE WHEN {_OFF[_d]} THEN 0.0 ELSE CAST(n + (key * 31 + cell * 17) % 13 - 6 AS DOUBLE) END AS est,
      CASE WHEN {_OFF[_d]} THEN NULL ELSE CAST({VARIANCE[_d]} AS DOUBLE) END AS v FROM true{_d}"""))

def _estimates(x: str, cover: str = "cover") -> list[tuple[str, str]]:
    """From the relations own0{x} .. own3{x} (geocode, cell, est, v) all that follows, cell by cell: up, sums, fin and, for the entities of a cover, ent."""
    out = [(f"up3{x}", f"SELECT * FROM own3{x}")]
    for d in (2, 1, 0):
        w, lone = SPINE.widths[d], "count(*) = 1" if d == 2 else "false"
        out.append((f"sums{d}{x}", f"""SELECT substr(geocode, 1, {w}) AS parent, cell, count(*) AS n,
      CASE WHEN {lone} THEN 1 ELSE count(*) FILTER (WHERE v IS NULL) END AS free,
      CASE WHEN {lone} THEN 0 ELSE coalesce(sum(est) FILTER (WHERE v IS NOT NULL), 0) END AS ke,
      CASE WHEN {lone} THEN 0 ELSE coalesce(sum(v), 0) END AS kv FROM up{d + 1}{x} GROUP BY 1, 2"""))
        out.append((f"up{d}{x}", f"""SELECT geocode, cell, CASE WHEN p + j > 0 THEN (p * est + j * ke) / (p + j) ELSE 0 END AS est,
      CASE WHEN p + j > 0 THEN 1 / (p + j) END AS v FROM (SELECT o.geocode, o.cell, o.est, s.ke, coalesce(1 / o.v, 0) AS p,
      CASE WHEN s.free = 0 THEN 1 / s.kv ELSE 0 END AS j FROM own{d}{x} o JOIN sums{d}{x} s ON s.parent = o.geocode AND s.cell = o.cell)"""))
    out.append((f"fin0{x}", f"SELECT *, CAST(NULL AS DOUBLE) AS share FROM up0{x}"))
    for d in (1, 2, 3):
        w, lone = SPINE.widths[d - 1], "s.n = 1" if d == 3 else "false"
        out.append((f"fin{d}{x}", f"""SELECT geocode, cell, CASE WHEN rest THEN 0 ELSE est END + share * (pest - ke) AS est,
      CASE WHEN rest THEN CASE WHEN free = 1 THEN pv + kv END WHEN free = 0 THEN v + share * share * pv - share * v ELSE v END AS v, share
      FROM (SELECT u.geocode, u.cell, u.est, u.v, s.ke, s.kv, s.free, f.est AS pest, f.v AS pv, u.v IS NULL OR ({lone}) AS rest,
      CASE WHEN {lone} THEN 1.0 WHEN s.free = 0 THEN u.v / s.kv WHEN u.v IS NULL THEN 1.0 / s.free ELSE 0 END AS share
      FROM up{d}{x} u JOIN sums{d - 1}{x} s ON s.parent = substr(u.geocode, 1, {w}) AND s.cell = u.cell
      JOIN fin{d - 1}{x} f ON f.geocode = s.parent AND f.cell = s.cell)"""))
    # variance of an entity: weights g and settled variance r, lifted level by level
    out.append((f"car3{x}", f"SELECT c.entity, c.geocode, u.cell, CAST(1.0 AS DOUBLE) AS g, CAST(0.0 AS DOUBLE) AS r, u.v FROM {cover} c JOIN up3{x} u ON u.geocode = c.geocode WHERE c.depth = 3"))
    for d in (2, 1, 0):
        w, v = SPINE.widths[d], "CASE WHEN s.n = 1 THEN NULL ELSE c.v END" if d == 2 else "c.v"
        out.append((f"lift{d}{x}", f"""SELECT entity, parent AS geocode, cell, g, CASE WHEN free > 1 AND abs(fgg - fg * fg / free) > 1e-9 THEN CAST('inf' AS DOUBLE)
      ELSE r + vgg - 2 * g * vg + g * g * kv END AS r FROM (SELECT entity, parent, cell, r, vg, vgg, fg, fgg, free, kv,
      CASE WHEN free = 0 THEN vg / kv ELSE fg / free END AS g FROM (SELECT c.entity, s.parent, s.cell, sum(c.r) AS r, any_value(s.free) AS free, any_value(s.kv) AS kv,
      coalesce(sum({v} * c.g), 0) AS vg, coalesce(sum({v} * c.g * c.g), 0) AS vgg, coalesce(sum(CASE WHEN {v} IS NULL THEN c.g END), 0) AS fg,
      coalesce(sum(CASE WHEN {v} IS NULL THEN c.g * c.g END), 0) AS fgg
      FROM car{d + 1}{x} c JOIN sums{d}{x} s ON s.parent = substr(c.geocode, 1, {w}) AND s.cell = c.cell GROUP BY 1, 2, 3))"""))
        if d:
            out.append((f"car{d}{x}", f"""SELECT l.entity, l.geocode, l.cell, l.g, l.r, u.v FROM lift{d}{x} l JOIN up{d}{x} u ON u.geocode = l.geocode AND u.cell = l.cell
          UNION ALL SELECT c.entity, c.geocode, u.cell, 1.0, 0.0, u.v FROM {cover} c JOIN up{d}{x} u ON u.geocode = c.geocode WHERE c.depth = {d}"""))
    out += [
        (f"fin{x}", " UNION ALL ".join(f"SELECT {d} AS depth, geocode, cell, est, v FROM fin{d}{x}" for d in range(4))),
        (f"ent{x}", f"""SELECT e.entity, e.cell, e.est, x.v FROM (SELECT c.entity, f.cell, sum(f.est) AS est FROM {cover} c JOIN fin{x} f ON f.depth = c.depth AND f.geocode = c.geocode GROUP BY 1, 2) e
      JOIN (SELECT l.entity, l.cell, coalesce(CASE WHEN l.g = 0 THEN l.r ELSE l.r + l.g * l.g * f.v END, CAST('inf' AS DOUBLE)) AS v
      FROM lift0{x} l JOIN fin0{x} f ON f.cell = l.cell) x ON x.entity = e.entity AND x.cell = e.cell"""),
    ]
    return out


def _parted(x: str, cells: int, own: dict[int, str], total: dict[int, str]) -> list[tuple[str, str]]:
    """Cells measured one by one and in total, as two kinds of scalars that never meet: each cell's deviation from the mean, and the total.

    Covariances with equal variances and equal covariances have these
    eigenspaces, and so has every sum, inverse and product of them. ``own``:
    SQL of (geocode, cell, y, v) per level, v NULL where bypassed; ``total``:
    SQL of the measured total's (geocode, y, v). Cell number ``cells`` is the
    total. ``cells{x}`` and ``ask{x}`` put both kinds together again: cells of
    all levels, and the total and the sums over thirds of the cells per entity.
    """
    out = []
    for d in range(4):
        out.append((f"own{d}{x}", f"""WITH o AS ({own[d]}), t AS ({total[d]}) SELECT geocode, cell, CASE WHEN v IS NULL THEN 0 ELSE y - avg(y) OVER (PARTITION BY geocode) END AS est, v FROM o
      UNION ALL SELECT geocode, {cells}, CASE WHEN v IS NULL THEN 0 ELSE (y / ({cells} * v) + ty / tv) / (1 / ({cells} * v) + 1 / tv) END, CASE WHEN v IS NOT NULL THEN 1 / (1 / ({cells} * v) + 1 / tv) END
      FROM (SELECT o.geocode, sum(o.y) AS y, any_value(o.v) AS v, any_value(t.y) AS ty, any_value(t.v) AS tv FROM o JOIN t ON t.geocode = o.geocode GROUP BY 1)"""))
    out += _estimates(x, "cover_of_parts")
    out.append((f"cells{x}", f"SELECT d.depth, d.geocode, d.cell, d.est + t.est / {cells} AS est, d.v * (1 - 1.0 / {cells}) + t.v / {cells * cells} AS v FROM fin{x} d JOIN fin{x} t ON t.depth = d.depth AND t.geocode = d.geocode WHERE d.cell < {cells} AND t.cell = {cells}"))
    k = cells // 3
    out.append((f"ask{x}", f"""SELECT entity, 'total' AS query, est, v FROM ent{x} WHERE cell = {cells}
      UNION ALL SELECT d.entity, 'status_' || (d.cell // {k}), sum(d.est) + any_value(t.est) / 3, any_value(d.v) * {k} * (2.0 / 3) + any_value(t.v) / 9
      FROM ent{x} d JOIN ent{x} t ON t.entity = d.entity WHERE d.cell < {cells} AND t.cell = {cells} GROUP BY d.entity, d.cell // {k}"""))
    return out


_ANC = "[{'depth': 0, 'node': ''}, {'depth': 1, 'node': substr(geocode, 1, 1)}, {'depth': 2, 'node': substr(geocode, 1, 3)}, {'depth': 3, 'node': geocode}]"
for _x, _entity in (("", "c_mktsegment"), ("_of_parts", "c_mktsegment || '/' || substr(geocode, 1, 1)")):
    _CTES += [
        (f"stat{_x}", f"""SELECT x.depth AS depth, x.node AS node, min(e) AS lo, max(e) AS hi
      FROM (SELECT {_entity} AS e, unnest({_ANC}) AS x FROM leaf) GROUP BY 1, 2"""),
        (f"cover{_x}", f"""SELECT s.lo AS entity, s.depth, s.node AS geocode FROM stat{_x} s LEFT JOIN stat{_x} p ON p.depth = s.depth - 1
      AND p.node = substr(s.node, 1, CASE s.depth WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) WHERE s.lo = s.hi AND (s.depth = 0 OR p.lo <> p.hi)"""),
    ]
_CTES += _estimates("")
_DETAILED = {d: f"SELECT geocode, cell, est AS y, v FROM own{d}" for d in range(4)}
_TOTAL = {d: f"SELECT geocode, sum(est) + 3 AS y, any_value(v) * 2 AS v FROM own{d} GROUP BY 1" for d in range(4)}
_CTES += _parted("S", CELLS, _DETAILED, _TOTAL)
# a stored run over the statuses alone: regions missing, the total of the root exact
_STATUS = {d: f"SELECT geocode, cell // 5 AS cell, sum(est) AS y, {'CAST(NULL AS DOUBLE)' if d == 1 else 'any_value(v) * 5'} AS v FROM own{d} GROUP BY 1, 2" for d in range(4)}
_CTES += _parted("J", 3, _STATUS, _TOTAL | {0: "SELECT geocode, CAST(sum(n) AS DOUBLE) AS y, 1.0 / 16384 AS v FROM true0 GROUP BY 1"})
# a second run that measured the three statuses
_SECOND = {d: f"""SELECT geocode, cell // 5 AS cell, CASE WHEN {_OFF[d]} THEN 0 ELSE CAST(sum(n) + (any_value(key) * 7 + cell // 5) % 11 - 5 AS DOUBLE) END AS y,
      CASE WHEN {_OFF[d]} THEN NULL ELSE {VARIANCE[d]} * 1.5 END AS v FROM true{d} GROUP BY geocode, cell // 5, key""" for d in range(4)}
_CTES += _parted("B", 3, _SECOND, {d: f"SELECT geocode, sum(y) + 2 AS y, any_value(v) * 3 AS v FROM ({_SECOND[d]}) GROUP BY 1" for d in range(4)})
# the wide histogram: cells within a level of the first attribute, levels against their mean, and the total never meet
_CTES.append(("widecell", f"""SELECT o_custkey AS key, CAST(((o_orderkey % 8 * 2 + CAST(o_orderstatus <> 'F' AS INTEGER)) * 2 + CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) > 2 AS INTEGER)) * 63 + dayofyear(o_orderdate) % 63 AS INTEGER) AS cell,
      count(*) AS n FROM orders GROUP BY 1, 2"""))
_CTES.append(("wide3", f"SELECT l.geocode, l.key, CAST(r.cell AS INTEGER) AS cell, coalesce(c.n, 0) AS n FROM leaf l CROSS JOIN range({WIDE_CELLS}) r(cell) LEFT JOIN widecell c ON c.key = l.key AND c.cell = r.cell"))
_CTES += [(f"wide{d}", f"SELECT {g} AS geocode, CAST({k} AS BIGINT) AS key, cell, CAST(sum(n) AS BIGINT) AS n FROM wide3 GROUP BY ALL") for d, g, k in
          ((2, "substr(geocode, 1, 3)", "substr(geocode, 2, 2)"), (1, "substr(geocode, 1, 1)", "substr(geocode, 1, 1)"), (0, "''", "0"))]
for _d in range(4):
    _v = float(VARIANCE[_d])
    _CTES.append((f"own{_d}W", f"""WITH y AS (SELECT geocode, cell, {_OFF[_d]} AS off, n + (key * 31 + cell * 17) % 13 - 6.0 AS y FROM wide{_d}),
      l AS (SELECT geocode, cell // 252 AS k, any_value(off) AS off, sum(y) AS y FROM y GROUP BY 1, 2), m AS (SELECT *, avg(y) OVER (PARTITION BY geocode) AS mean FROM l),
      t AS (SELECT geocode, any_value(off) AS off, sum(y) AS y FROM l GROUP BY 1)
      SELECT y.geocode, y.cell, CASE WHEN y.off THEN 0 ELSE y.y - l.y / 252 END AS est, CASE WHEN y.off THEN NULL ELSE {_v} END AS v FROM y JOIN l ON l.geocode = y.geocode AND l.k = y.cell // 252
      UNION ALL SELECT geocode, {WIDE_CELLS} + k, CASE WHEN off THEN 0 ELSE ((y - mean) / {252 * _v} + (y - mean + k - 3.5) / {_v / 2}) / (1 / {252 * _v} + 1 / {_v / 2}) END, CASE WHEN off THEN NULL ELSE 1 / (1 / {252 * _v} + 1 / {_v / 2}) END FROM m
      UNION ALL SELECT geocode, {WIDE_CELLS + 8}, CASE WHEN off THEN 0 ELSE (y / {WIDE_CELLS * _v} + (y + 28) / {4 * _v} + (y + 3) / {2 * _v}) / (1 / {WIDE_CELLS * _v} + 1 / {4 * _v} + 1 / {2 * _v}) END,
        CASE WHEN off THEN NULL ELSE 1 / (1 / {WIDE_CELLS * _v} + 1 / {4 * _v} + 1 / {2 * _v}) END FROM t"""))
_CTES += _estimates("W")
_CTES.append(("levelsW", f"""SELECT l.depth, l.geocode, CAST(l.cell - {WIDE_CELLS} AS INTEGER) AS k, l.est + t.est / 8 AS est, l.v * (7.0 / 8) + t.v / 64 AS v
      FROM finW l JOIN finW t ON t.depth = l.depth AND t.geocode = l.geocode WHERE l.cell BETWEEN {WIDE_CELLS} AND {WIDE_CELLS + 7} AND t.cell = {WIDE_CELLS + 8}"""))
_CTES.append(("pickedW", f"""SELECT l.depth, l.geocode, l.k, l.est AS level_est, l.v AS level_v, c.est + l.est / 252 AS cell_est, c.v * (251.0 / 252) + l.v / {252 * 252} AS cell_v
      FROM levelsW l JOIN finW c ON c.depth = l.depth AND c.geocode = l.geocode AND c.cell = l.k * 252 + (l.k * 37 + 11) % 252"""))
# the detailed query alone, with cells of no count held at zero above the leaves
_CTES += [(f"own{d}M", f"""SELECT t.geocode, t.cell, CASE WHEN o.v IS NULL THEN 0.0 WHEN t.n = 0 AND {d} < 3 THEN o.est / o.v / (1 / o.v + 16384) ELSE o.est END AS est,
      CASE WHEN o.v IS NULL THEN NULL WHEN t.n = 0 AND {d} < 3 THEN 1 / (1 / o.v + 16384) ELSE o.v END AS v FROM true{d} t JOIN own{d} o ON o.geocode = t.geocode AND o.cell = t.cell""") for d in range(4)]
_CTES += _estimates("M")


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` with the relations it needs in front; ``extra`` adds further named relations."""
    import re

    known = [*_CTES, *extra]
    need, text = set(), [body]
    while text:
        words = set(re.findall(r"\w+", text.pop()))
        for name, q in known:
            if name in words and name not in need:
                need.add(name)
                text.append(q)
    parts = [f"{name} AS MATERIALIZED ({q})" for name, q in known if name in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
