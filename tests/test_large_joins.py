"""Tables that grow with the units never pass through the driver, whatever their files weigh."""

import numpy as np

from stemtally.functions import lineage
from stemtally.operators import entities_dense, gls_dense
from test_gls import dense_passes, make_rows, random_cover
from trees import random_tree


def test_units_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    spine, levels = random_tree(rng, 3, 2, 3)
    plans = []

    def watched(df, name="stage", by=()):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return lineage.cut_lineage(df, name, by)

    monkeypatch.setattr(entities_dense, "cut_lineage", watched)
    passes = dense_passes(spark, spine, make_rows(rng, levels, lambda d, g, q: 1.0)[1])
    cover, _ = random_cover(spark, rng, spine, levels)
    e = entities_dense.entity_variances(cover, passes, np.ones((1, 2)), 1)
    plans.append(("entities", e._jdf.queryExecution().executedPlan().toString()))
    assert {"start", "entities"} <= {name for name, _ in plans}
    for name, plan in plans:
        assert "BroadcastHashJoin [geocode" not in plan, name


def test_parents_are_sent_to_the_leaves(spark, monkeypatch):
    """Files of a leaf level below the broadcast limit: what the leaves meet is a written table, smaller than they are."""
    rng = np.random.default_rng(6)
    spine, levels = gls_dense.Spine(("a", "b", "c"), (0, 1, 4)), [[""], ["0", "1"], [f"{i % 2}{i:03d}" for i in range(300)]]
    plans = {}

    def watched(df, name="stage", by=()):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return lineage.cut_lineage(df, name, by)

    table = make_rows(rng, levels, lambda d, g, q: 1.0)[1]
    design = spark.createDataFrame([("detailed", i, i, 1.0, 1.0) for i in range(2)], "query_name string, row_ix int, cell int, coef double, mult double")
    m = spark.createDataFrame([r for r in table if r[1] in levels[0] + levels[1] + levels[2] and r[2] == "detailed"], "depth int, geocode string, query_name string, value array<double>, variance double")
    gls_dense.DensePasses(spine, 2, *gls_dense.dense_own(m, design, 2), cut=watched).run_down()
    joins = [line for line in plans["handed_2"].splitlines() if "Join [parent" in line]
    assert joins and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins), joins
