"""A histogram of many cells is not written before it is measured."""

import numpy as np

from stemtally.operators import gls_residual as gr, tabulate as tab
from stemtally.plans import fixtures as fx


def test_counts_of_leaves_stay_lists(spark, sf_dir, monkeypatch):
    kept, cut = [], fx.cut_lineage
    monkeypatch.setattr(fx, "cut_lineage", lambda df, *a, **k: kept.append(cut(df, *a, **k)) or kept[-1])
    rows = fx.wide_measurements(fx.Tables(spark, sf_dir))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert max(len(r.n) for r in kept[0].select("n").collect() if r.n) < 200 < fx.WIDE_CELLS
    totals = {r.depth: r.s for r in rows.filter("query_name = 'total'").selectExpr("depth", "value[0] - 3 AS s").groupBy("depth").sum("s").toDF("depth", "s").collect()}
    noise = sum((i * 17) % 13 - 6 for i in range(fx.WIDE_CELLS))
    assert totals[0] == orders + noise


def test_own_sums_rows_wherever_they_are(spark):
    shape = (2, 3)
    queries = {n: tab.tabular_query(n, shape, {}, m) for n, m in (("detailed", []), ("first", [1]), ("total", [0, 1]))}
    basis = gr.Basis(shape)
    rng = np.random.default_rng(3)
    rows = [(1, g, n, [float(x) for x in rng.normal(5, 2, q.num_rows)], v) for g in ("a", "b", None) for n, q in queries.items() for v in (0.5, 2.0)]  # every answer twice
    rows += [(1, "off", "detailed", [0.0] * 6, float("inf")), (1, "off", "total", [1.0], 1.0)]
    schema = "depth int, geocode string, query_name string, value array<double>, variance double"
    got = {}
    for name, order in (("together", rows), ("apart", [rows[i] for i in rng.permutation(len(rows))])):
        m = spark.createDataFrame(order, schema).repartition(3) if name == "apart" else spark.createDataFrame(order, schema).coalesce(1)
        got[name] = {r.geocode: (r.p, r.b, r.off) for r in gr.residual_own(m, queries, basis).collect()}
    for own in got.values():
        assert set(own) == {"a", "b", None, "off"} and own["off"][2] == [1.0]
        for g in ("a", "b", None):
            p, b = np.zeros(basis.subsets), np.zeros(basis.cells)
            for _, h, n, y, v in rows:
                if h == g:
                    info, z = basis.measured(queries[n], np.array([y]))
                    p, b = p + info / v, b + z[0] / v
            assert np.allclose(own[g][0], p) and np.allclose(own[g][1], b) and own[g][2] == [0.0]
