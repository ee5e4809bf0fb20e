"""Orders by customer and cell, from rows of its own: what tabulations read, and the same as the arrays that estimates read."""

from datetime import datetime

from stemtally.plans import registry
from stemtally.plans.fixtures import Tables

registry.load_all()
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDERS = [(1, "F", 0), (1, "F", 0), (1, "O", 4), (2, "P", 2), (3, "O", None), (None, "F", 1), (9, "F", 1)]  # customer, status, priority


def write(spark, folder):
    day = datetime(2024, 1, 1)
    rows = {
        "nation": ([(3, "A", 1), (4, "B", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"c{k}", n, 0.0, "BUILDING") for k, n in ((1, 3), (2, 4), (3, 4), (5, 4))], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": (
            [(i, c, s, 1.0, day, p if p is None else PRIORITY[p]) for i, (c, s, p) in enumerate(ORDERS)],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_cells_and_arrays(spark, tmp_path):
    t = Tables(spark, write(spark, tmp_path / "in"))
    got = {(r.key, r.cell): r.n for r in t.order_cells.collect()}
    assert got == {(1, 0): 2, (1, 9): 1, (2, 12): 1, (3, None): 1, (None, 1): 1, (9, 1): 1}
    held = {(r.key, r.cell): r.n for r in t.true_counts(3).filter("n > 0").collect()}
    assert held == {(1, 0): 2, (1, 9): 1, (2, 12): 1}


def test_tabulations_read_them(spark, tmp_path):
    folder = write(spark, tmp_path / "in")
    run = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, folder).collect()))
    assert run("marginal_total") == [("103", 0, 3), ("204", 0, 2)]
    code = lambda nation, k: f"{nation}{k:010d}"
    assert run("spine_missing_nodes") == [(code("103", 1), "detailed", False, 3), (code("204", 2), "detailed", False, 1), (code("204", 3), "detailed", False, 1), (code("204", 5), "detailed", True, 0)]
