import numpy as np
import pytest
from pyspark.sql import functions as F

from stemtally.operators.query_rows import factor_matrix
from stemtally.sources import results as res
from stemtally.functions import matrices as mx
from stemtally.functions.keys import Spine
from stemtally.operators import constraints as ct, covers, intervals, marginalize as mg, spine as sp, tabulate as tab
from trees import random_tree


def test_marginalised_golden_arrays(spark):
    shape = (2, 3, 2, 2)
    marginal = tab.tabular_query("m", shape, {1: [[0], [1, 2]]}, [2, 3])
    want = {  # fixed values: answers and designs that must come out
        (0, 1): ([0.015625, 0.09375, 0.125, 0.75], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]),
        (): ([0.015625], [[1, 1, 1, 1]]),
        (0, 1, 2, 3): ([0.234375, 63.75, 960.0, 261120.0], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]),
        (1, 2): ([0.046875, 0.9375], [[1, 0, 1, 0], [0, 1, 0, 1]]),
        (2, 3): ([0.234375], [[1, 1, 1, 1]]),
        (0, 2): ([0.046875, 0.1875], [[1, 1, 0, 0], [0, 0, 1, 1]]),
    }
    for keep, (answers, rows) in want.items():
        q = tab.tabular_query(str(keep), shape, {}, [d for d in range(4) if d not in keep])
        m = spark.createDataFrame([("g", q.name, [2.0 ** (i - 6) for i in range(q.num_rows)], 1.0)], "geocode string, query_name string, value array<double>, variance double")
        got = [r.value for r in mg.marginalise(m, q, marginal).orderBy("row_ix").collect()]
        assert got == answers
        design = np.zeros((len(answers), 4))
        for r in mg.marginal_design(spark, q, marginal).collect():
            design[r.row_ix, r.cell] = r.coef
        assert design.tolist() == rows


def test_common_groups():
    assert mg.common_groups([[0, 1], [2], [3]], [[1, 2], [4]]) == [[0, 1, 2], [3], [4]]
    assert mg.common_groups([[0]], [[0], [1, 2]]) == [[0], [1, 2]]
    stub = tab.LinearQuery("stub", ())
    q = tab.tabular_query("q", (2, 3))
    assert mg.common_coarsening(stub, q) is q


def test_rows_on_marginal():
    m = tab.tabular_query("m", (4,), {0: [[0, 1], [2, 3]]})
    assert mg.rows_on_marginal(tab.tabular_query("t", (4,), {}, [0]), m).factors[0].row_levels() == [[0, 1]]
    with pytest.raises(ValueError, match="finer"):
        mg.rows_on_marginal(tab.tabular_query("d", (4,)), m)


def test_arguments_are_checked():
    for bad in (dict(margins=[0, 0]), dict(margins=[5]), dict(groupings={0: [[0]]}, margins=[0]), dict(groupings={0: [[7]]}), dict(groupings={3: [[0]]})):
        with pytest.raises(ValueError):
            tab.tabular_query("q", (2, 3), **bad)
    with pytest.raises(ValueError):
        tab.subset_query("q", (3,), {0: [1, 1]})
    with pytest.raises(ValueError):
        tab.tabular_query("q", (2.0, 3))


@pytest.mark.parametrize("n", [5, 10, 50])
def test_packed_matrices(spark, n):
    rng = np.random.default_rng(n)
    a = rng.uniform(size=(n, n))
    a = a + a.T
    assert np.array_equal(mx.unpack(mx.pack(a)), a)
    row = spark.createDataFrame([(a.ravel().tolist(),)], "m array<double>").select(mx.pack_expr(F.col("m"), n).alias("p"))
    got = row.select("p", mx.unpack_expr(F.col("p"), n).alias("u"), mx.packed_order_expr(F.col("p")).alias("n")).first()
    assert got.n == n and np.array_equal(np.array(got.p), mx.pack(a)) and np.array_equal(np.array(got.u).reshape(n, n), a)


def test_many_matrices_and_a_wrong_size():
    a = np.random.default_rng(3).uniform(size=(5, 4, 4))
    a = a + np.swapaxes(a, 1, 2)
    assert np.array_equal(mx.unpack_many(mx.pack_many(a)), a) and np.array_equal(mx.pack_many(a)[2], mx.pack(a[2]))
    with pytest.raises(ValueError):
        mx.packed_order(4)
    assert np.isinf(mx.unpack(np.array([np.inf, 0, np.inf]))).trace() == 2


def test_cover_and_closure_against_brute_force(spark):
    rng = np.random.default_rng(11)
    for _ in range(3):
        spine, levels = random_tree(rng, 3, 1, 4)
        of = {g: f"e{int(rng.integers(0, 3))}" for g in levels[-1]}
        got = covers.coarsest_cover(spark.createDataFrame(list(of.items()), "leaf string, entity string"), spine)
        pure = lambda g: {e for x, e in of.items() if x.startswith(g)}
        want = {(next(iter(pure(g))), d, g) for d, level in enumerate(levels) for g in level if len(pure(g)) == 1 and (d == 0 or len(pure(g[:-1])) > 1)}
        assert {(r.entity, r.depth, r.geocode) for r in got.collect()} == want
        paths = set()
        by = {}
        for e, _, g in want:
            by.setdefault(e, []).append(g)
        for e, nodes in by.items():
            paths |= {(e, g) for g in nodes}
            for a in nodes:
                for b in nodes:
                    k = max(w for w in spine.widths if a[:w] == b[:w] and w <= min(len(a), len(b)))
                    paths |= {(e, x[:w]) for x in (a, b) for w in spine.widths if k <= w <= len(x)}
        closure = covers.path_closure(got, spine)
        assert {(r.entity, r.geocode) for r in closure.collect()} == paths
        assert {(r.entity, r.geocode) for r in closure.filter("in_cover").collect()} == {(e, g) for e, _, g in want}


def test_spine_edges(spark):
    nodes = spark.createDataFrame([("10",), ("20",), ("21",), ("22",)], "geocode string")
    assert sp.representative_leaf(nodes, 1).first().geocode == "21"
    assert sp.representative_leaf(nodes.filter("geocode < '21'"), 1).count() == 0
    root = spark.createDataFrame([("", 7)], "geocode string, v int")
    joined = sp.hierarchical_join(root, nodes, 0, 2)
    assert {(r.geocode, r.v) for r in joined.collect()} == {(g, 7) for g in ("10", "20", "21", "22")}
    with pytest.raises(ValueError):
        Spine(("a", "b"), (1, 1))
    two_roots = covers.custom_cover(nodes, "root")
    with pytest.raises(Exception, match="exactly one node"):
        two_roots.collect()
    parts = sp.even_partitions(nodes, 2, least=1).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 4 and len(parts) <= 2


def test_constraints_edges(spark):
    ddl = "geocode string, query_name string, sign string, value array<bigint>, a string, b string"
    rows = [("g", "total_con", "=", [3, 4], "total", None), ("g", "x", "<=", [0, 5], "p", "q * r"), ("g", "y", ">=", [0], "p", None), ("g", "z", "<=", [1, 2], "p", None), ("g", "e", "=", [0, 0], "p", "s")]
    c = spark.createDataFrame(rows, ddl)
    got = {(r.query_name, r.kind, r.row_ix, r.value) for r in ct.interpret(c, True).collect()}
    assert got == {("total", "total", 0, 7.0), ("p", "zero", 0, 0.0), ("p * s", "zero", 0, 0.0), ("p * s", "zero", 1, 0.0)}
    assert ct.interpret(c, False).filter("kind = 'total'").count() == 0
    with pytest.raises(Exception, match="equalities to zero"):
        ct.interpret(spark.createDataFrame([("g", "e", "=", [1], "p", None)], ddl)).collect()


def test_household_zeros(spark):
    spine = Spine(("r", "c"), (0, 1))
    ddl = "geocode string, query_name string, value array<bigint>"
    some = spark.createDataFrame([("a", "hhgq_total_ub_con", [0]), ("b", "hhgq_total_ub_con", [3])], ddl)
    assert ct.household_zeros(some, spine).count() == 0
    every = spark.createDataFrame([("a", "hhgq_total_ub_con", [0]), ("b", "hhgq_total_ub_con", [0])], ddl)
    assert [(r.depth, r.geocode, r.query_name) for r in ct.household_zeros(every, spine).collect()] == [(0, "", "hhinstlevels")]


def test_intervals(spark):
    a = spark.createDataFrame([("e", "q", 10.4, 2.0), ("e", "r", -5.0, 1.0)], "entity string, query string, estimate double, std_dev double")
    got = {(r["query"], r.alpha): (r.lower, r.upper) for r in intervals.integer_interval(intervals.with_moe(a, [0.1])).collect()}
    assert got == {("q", 0.1): (8, 13), ("r", 0.1): (0, 0)}
    with pytest.raises(ValueError):
        intervals.normal_quantile(0)


def test_stub_and_differences(spark):
    assert [r.n for r in tab.stub_query(spark, "s", 3).collect()] == [0.0] * 3
    q = tab.query_cell(spark, tab.tabular_query("q", (2, 3), {}, [1]))
    assert tab.query_differences(q, q).count() == 0
    with pytest.raises(Exception, match="differ in size"):
        tab.check_dimension(q, 5).collect()


def test_overlapping_stretches_are_differences_of_running_sums(spark):
    rng = np.random.default_rng(4)
    shape = (3, 7, 4)
    q = tab.tabular_query("ranges", shape, {0: [[0, 2], [1]], 1: [[0], [0, 1, 2], [2, 3, 4, 5, 6], [6], list(range(7)), [3]], 2: [[1, 2], [2, 3], [0]]})
    rows = [(k, c, int(rng.integers(1, 9))) for k in ("a", "b") for c in range(84) if rng.uniform() < 0.3]
    df = spark.createDataFrame(rows, "k string, cell int, n bigint")
    whole = np.ones((1, 1))
    for f in q.factors:
        whole = np.kron(whole, factor_matrix(f))
    want = {}
    for k, c, n in rows:
        for r in np.flatnonzero(whole[:, c]):
            want[k, int(r)] = want.get((k, int(r)), 0) + n
    out = tab.answer(df, q, ["k"])
    assert {(r.k, r.row_ix): r.n for r in out.collect()} == want and out.schema["n"].dataType.simpleString() == "bigint"
    assert tab.Factor.groups(5, [[0, 2], [1, 2]]).stretches() is None and tab.Factor.weights([[1, 1], [0, 2]]).stretches() is None


def test_each_marginal_comes_from_the_smallest_one_that_holds_it(spark):
    tree = dict(tab.cover_tree([("a", "b"), ("a", "c"), ("b", "c"), ("b",), ("c",), ()], {"a": 100, "b": 10, "c": 2}))
    assert tree == {("a", "b", "c"): None, ("a", "b"): ("a", "b", "c"), ("a", "c"): ("a", "b", "c"), ("b", "c"): ("a", "b", "c"), ("b",): ("b", "c"), ("c",): ("b", "c"), (): ("c",)}
    df = spark.createDataFrame([(None, 1, 5), ("x", 1, 2), ("x", 2, 3), (None, 1, 4)], "a string, b int, n bigint")
    got = {(r.query, r.a, r.b): r.n for r in tab.marginals(df, ["a", "b"], [0, 1, 2]).collect()}
    assert got == {("detailed", None, 1): 9, ("detailed", "x", 1): 2, ("detailed", "x", 2): 3, ("a", None, None): 9, ("a", "x", None): 5, ("b", None, 1): 11, ("b", None, 2): 3, ("total", None, None): 14}
    assert tab.marginals(df.limit(0), ["a", "b"], [0, 1]).count() == 0


def test_a_large_directory_is_split_into_files(spark, tmp_path):
    rows = spark.range(300).select(
        F.when(F.col("id") < 200, "1001").otherwise(F.concat(F.lit("2"), F.lpad(F.col("id").cast("string"), 3, "0"))).alias("geocode"), F.col("id").cast("string").alias("query"),
        F.lit(1.5).alias("estimate"), F.lit(0.5).alias("std_dev"), F.lit("d").alias("query_description"),
    )
    res.publish(rows, str(tmp_path / "p"), {"State": (1, 1)}, rows_per_file=50)
    files = {s.name: len(list(s.glob("part-*"))) for s in (tmp_path / "p").iterdir() if s.is_dir()}
    assert 4 <= files["State=1"] <= 8 and 2 <= files["State=2"] <= 4
    assert res.read_published(spark, str(tmp_path / "p"), ["State"]).count() == 300
