"""Wide units are written as the answers they gave, few different numbers; states in the basis of the leaves are not written at all."""

import numpy as np

from stemtally.functions import lineage
from stemtally.functions.keys import Spine
from stemtally.operators import gls_residual as gr, tabulate as tab

SHAPE = (8, 2, 2, 63)
QUERIES = {n: tab.tabular_query(n, SHAPE, {}, m) for n, m in (("detailed", []), ("first", [1, 2, 3]))}


def test_written_bytes_of_wide_leaves(spark, monkeypatch):
    basis, rng, written = gr.Basis(SHAPE), np.random.default_rng(2), {}

    def watched(df, name="stage", by=()):
        out = lineage.cut_lineage(df, name, by)
        written[name] = lineage.written_bytes(out)
        return out

    monkeypatch.setattr(gr, "cut_lineage", watched)
    units = 200
    rows = [(1, f"{u:03d}", n, (rng.poisson(2, q.num_rows) - 2.0).tolist(), v) for u in range(units) for (n, q), v in zip(QUERIES.items(), (2.0, 1.0), strict=True)]
    rows += [(0, "", "detailed", (rng.poisson(2, basis.cells) * 1.0).tolist(), 1.0)]
    m = spark.createDataFrame(rows, "depth int, geocode string, query_name string, value array<double>, variance double")
    p = gr.ResidualPasses(Spine(("a", "b"), (0, 3)), basis, gr.residual_own(m, QUERIES, basis), cut=watched).run_down()
    got = {r.geocode: r for r in p.estimates(1).collect()}
    sums = {r.geocode: r.estimate for r in p.answers(1, [np.eye(8), *[np.ones((1, n)) for n in SHAPE[1:]]]).collect()}
    assert len(got) == len(sums) == units
    for g, r in got.items():
        assert np.allclose(np.reshape(r.estimate, (8, -1)).sum(axis=1), sums[g])
    root = p.estimates(0).first()
    assert np.allclose(np.sum([r.estimate for r in got.values()], axis=0), root.estimate, atol=1e-6)
    levels = 252 * 2048  # bytes of the tables of upper levels, dense but few
    assert sum(written.values()) < units * basis.cells * 8 / 4 + levels, written


def test_tables_by_value_are_complete(spark):
    df = spark.range(1000).selectExpr("id % 30 AS k", "id", "cast(null AS string) AS s")
    out = lineage.cut_lineage(df, "by", by=["k"])  # more values than files that are open at once
    assert sorted((r.k, r.id) for r in out.collect()) == sorted((i % 30, i) for i in range(1000))
    assert out.filter("k = 7").count() == 34
