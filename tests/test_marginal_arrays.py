import pytest
from pyspark.sql import functions as F

from stemtally.operators import marginalize as mg, tabulate as tab

SHAPE = (3, 5)
DETAILED = tab.tabular_query("detailed", SHAPE)


@pytest.mark.parametrize("marginal", [DETAILED, tab.tabular_query("two", SHAPE, {0: [[0], [1, 2]]}, [1])], ids=["same", "coarser"])
def test_arrays_are_summed_where_they_are(spark, marginal):
    rows = [("a", [float(i * i) for i in range(15)], 1.0), ("b", [1.0] * 15, 2.0), ("b", [float(i) for i in range(15)], 2.0), ("long", [float(i) for i in range(40)], 1.0), ("none", None, 1.0)]
    m = spark.createDataFrame(rows, "geocode string, value array<double>, variance double").withColumn("query_name", F.lit("detailed"))
    got = mg.marginalised_arrays(m, DETAILED, marginal)
    long = {}
    for r in mg.marginalise(m, DETAILED, marginal).collect():
        long.setdefault(r.geocode, {})[r.row_ix] = r.value
    n = mg.common_coarsening(DETAILED, marginal).num_rows
    want = sorted((g, v, [long.get(g, {}).get(i, 0.0) for i in range(n)]) for g, _, v in rows)
    assert sorted((r.geocode, r.variance, r.value) for r in got.collect()) == want
    assert "Generate posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per cell
