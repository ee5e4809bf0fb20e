import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stemtally.catalog.schemas import schema
from stemtally.functions.keys import Spine
from stemtally.functions.matrices import unpack
from stemtally.operators import constraints
from stemtally.operators.gls_diagonal import SOFT_VARIANCE
from stemtally.operators import tabulate as tab
from stemtally.operators.query_rows import FactorRows, as_rows, contract, factor_matrix
from stemtally.plans import interval_job as job
from stemtally.plans.stored_run import StoredRun, load
from stemtally.plans.two_pass import run_two_pass_estimate
from stemtally.sources import measurements as src, results as res

SPINE = Spine(("Root", "Leaf"), (0, 1))
MARGINAL = "hhsex * couplelevels"


def write_inputs(spark, root, rng):
    s = schema("HOUSEHOLDSMALL_SCHEMA")
    q = {n: s.query(n).num_rows for n in ("detailed", "total", "hhsex")}
    kept = {}
    for level, nodes in (("Root", [""]), ("Leaf", ["a", "b", "c"])):
        rows = []
        for g in nodes:
            for n, size in q.items():
                y = rng.normal(20, 3, size).tolist()
                rows.append((g, n + "_dpq", y, 2.0 if n == "detailed" else 1.0))
                kept[g, n] = np.array(y)
        spark.createDataFrame(rows, "geocode string, query_name string, value array<double>, variance double").write.parquet(src.level_path(root, level, "DPQuery"))
        con = [(g, "total_con", "=", [999], "total") for g in nodes] + ([("", "c", "<=", [0, 5, 5], "couplelevels")] if level == "Root" else [])
        spark.createDataFrame(con, "geocode string, query_name string, sign string, value array<bigint>, part string").write.parquet(src.level_path(root, level, "Constraint"))
    return kept


def test_whole_job(spark, tmp_path):
    rng = np.random.default_rng(5)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    kept = write_inputs(spark, root, rng)
    passes = run_two_pass_estimate(spark, root, SPINE, "HOUSEHOLDSMALL_SCHEMA", out, MARGINAL, total_levels=("Root",))
    assert passes.n == 6 and src.read_widths(spark, f"{out}/widths") == SPINE
    # the same by hand: 6 cells, 3 leaves
    groups = [list(range(8)), list(range(8, 18)), list(range(18, 24))]
    p, r = np.zeros((18, 18)), np.zeros(18)

    def use(leaves, coefs, y, v):
        a = np.zeros(18)
        for i in leaves:
            a[i * 6 : i * 6 + 6] = coefs
        p[:] += np.outer(a, a) / v
        r[:] += a * y / v

    for g, leaves in (("", [0, 1, 2]), ("a", [0]), ("b", [1]), ("c", [2])):
        d = kept[g, "detailed"].reshape(2, 24)
        for s in range(2):
            for k, levels in enumerate(groups):
                use(leaves, np.eye(6)[s * 3 + k], d[s, levels].sum(), 2.0 * len(levels))
            use(leaves, np.eye(6)[s * 3 : s * 3 + 3].sum(0), kept[g, "hhsex"][s], 1.0)
        use(leaves, np.ones(6), 999.0 if g == "" else kept[g, "total"][0], SOFT_VARIANCE if g == "" else 1.0)
    for s in range(2):  # couplelevels row 0 is zero at the root
        use([0, 1, 2], np.eye(6)[s * 3], 0.0, SOFT_VARIANCE)
    cov = np.linalg.inv(p)
    mean = cov @ r
    got = {(x.geocode, x.cell): x.final_estimate for x in passes.estimates().collect()}
    for i, g in enumerate("abc"):
        for c in range(6):
            assert got[g, c] == pytest.approx(mean[i * 6 + c], abs=1e-6)
    # soft constraints pull, they do not bind: here the measurements disagree with the total by hundreds
    assert abs(got["", 0]) < 0.1 and sum(got["", c] for c in range(6)) == pytest.approx(999, abs=0.1)
    # intervals for two entities, one of two leaves; then fused with an independent second run
    cover = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("y", 1, "c")], "entity string, depth int, geocode string")
    ask = np.vstack([np.ones(6), [1, 0, 0, 1, 0, 0]])
    rows = job.estimate_intervals({"Pair": cover}, passes, ask, ["all", "married"], [0.1], out)["Pair"].collect()
    sx = np.hstack([ask, ask, np.zeros((2, 6))])
    for x in rows:
        if x.geocode == "x":
            i = ["all", "married"].index(x["query"])
            assert x.estimate == pytest.approx((sx @ mean)[i], abs=1e-6) and x.std_dev == pytest.approx(np.sqrt((sx @ cov @ sx.T)[i, i]), rel=1e-6)
    shared = job.projection_query("HOUSEHOLDSMALL_SCHEMA", "hhsex", MARGINAL)
    q1 = FactorRows(shared).block(0, 2)
    assert q1.tolist() == [[1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1]]
    fused = job.estimate_intervals({"Pair": cover}, passes, np.eye(6), list("abcdef"), [0.1], str(tmp_path / "f"), passes, {"Pair": cover}, shared, q1)["Pair"]
    v1 = np.hstack([np.eye(6), np.eye(6), np.zeros((6, 6))])
    v1, b1 = v1 @ cov @ v1.T, v1 @ mean
    w = np.linalg.inv(q1 @ v1 @ q1.T)
    v = np.linalg.inv(np.linalg.inv(v1) + q1.T @ w @ q1)
    b = v @ (np.linalg.solve(v1, b1) + q1.T @ w @ q1 @ b1)
    for x in fused.filter("geocode = 'x'").collect():
        i = "abcdef".index(x["query"])
        assert x.estimate == pytest.approx(b[i], rel=1e-6, abs=1e-4) and x.std_dev == pytest.approx(np.sqrt(v[i, i]), rel=1e-4)
    with pytest.raises(ValueError, match="second run"):
        job.estimate_intervals({}, passes, ask, [], [], out, second=passes)
    assert res.read_intervals(spark, f"{out}/intervals/Pair").count() == 4
    assert unpack(np.array([1.0, 2.0, 3.0])).tolist() == [[1, 2], [2, 3]]


def test_missing_level(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("a", "t", "=", [1], "total")], "geocode string, query_name string, sign string, value array<bigint>, part string").write.parquet(src.level_path(root, "L", "Constraint"))
    with pytest.raises(Exception):
        src.read_level(spark, root, "L").count()
    got = src.read_level(spark, root, "L", on_missing_level="bypass").first()
    assert (got.geocode, got.query_name, got.value, got.variance) == ("a", "detailed", None, float("inf"))


def test_covers_of_levels(spark):
    class P:
        spine = Spine(("US", "State", "Block"), (0, 3, 17))
        nodes = None

    p = P()
    blocks = spark.createDataFrame([("0010000000000000A",), ("1010000000000000B",), ("0020000000000000C",)], "geocode string")
    p.nodes = [blocks.select(F.lit("").alias("geocode")).distinct(), blocks.select(F.left("geocode", F.lit(3)).alias("geocode")), blocks]
    c = job.entity_covers(blocks, p, {"County": 5}, ["US", "State", "County", "Block"])
    assert c["US"].count() == 1 and {(r.entity, r.geocode) for r in c["State"].collect()} == {("01", "001"), ("01", "101"), ("02", "002")}
    assert {(r.entity, r.geocode) for r in c["County"].collect()} == {("01000", "001"), ("01000", "101"), ("02000", "002")}
    assert c["Block"].filter("length(entity) = 16").count() == 3


def test_repeated_rows_of_a_level_count_once(spark, tmp_path):
    root = str(tmp_path / "in")
    spark.createDataFrame([("1", "total_con", "=", [3])], "geocode string, query_name string, sign string, value array<bigint>").write.parquet(src.level_path(root, "L", src.CONSTRAINT_DIR))
    rows = [("1", "detailed_dpq", [4.0, 6.0], 1.0), ("1", "detailed_dpq", [4.0, 6.0], 1.0), ("1", "detailed_dpq", [9.0, 9.0], 2.0)]
    spark.createDataFrame(rows, "geocode string, query_name string, value array<double>, variance double").write.parquet(src.level_path(root, "L", src.MEASUREMENT_DIR))
    got = src.read_level(spark, root, "L").collect()
    assert [(r.query_name, r.value, r.variance) for r in got] == [("detailed", [4.0, 6.0], 1.0)]


def test_a_broken_level_is_not_a_bypassed_one(spark, tmp_path):
    root = str(tmp_path / "in")
    spark.createDataFrame([("1", "total_con", "=", [3])], "geocode string, query_name string, sign string, value array<bigint>").write.parquet(src.level_path(root, "L", src.CONSTRAINT_DIR))
    (tmp_path / "in" / "L.parquet" / src.MEASUREMENT_DIR).mkdir(parents=True)
    with pytest.raises(AnalysisException):
        src.read_level(spark, root, "L", on_missing_level="bypass").collect()


def test_households_of_another_tree_meet_by_leaf(spark):
    """The other run's codes have other prefixes; the last sixteen characters name the leaf."""
    spine = Spine(("root", "mid", "leaf"), (0, 1, 17))
    leaf = lambda k: f"{k:016d}"
    theirs = [("77" + leaf(1), [0]), ("78" + leaf(2), [0]), ("79" + leaf(3), [5]), ("70" + leaf(9), [0])]
    df = spark.createDataFrame([(g, constraints.HOUSEHOLD_ZERO, v) for g, v in theirs], "geocode string, query_name string, value array<bigint>")
    own = spark.createDataFrame([("a" + leaf(1),), ("a" + leaf(2),), ("b" + leaf(3),)], "geocode string")
    assert {(r.depth, r.geocode) for r in constraints.household_zeros(df, spine, own).collect()} == {(1, "a")}


def test_a_constraint_without_sign_is_an_equality(spark):
    df = spark.createDataFrame([("1", "x_con", None, [0, 0], "detailed")], "geocode string, query_name string, sign string, value array<bigint>, hhgq string")
    assert constraints.interpret(df).count() == 2


def test_a_run_goes_on_behind_its_last_step(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_inputs(spark, root, np.random.default_rng(6))
    args = (spark, root, SPINE, "HOUSEHOLDSMALL_SCHEMA", out, MARGINAL)
    assert run_two_pass_estimate(*args, until="up_1") is None
    before = {r.step: r.row_count for r in StoredRun.existing(spark, out).commits().collect()}
    assert before["up_1"] == 3 and "up_0" not in before
    with pytest.raises(ValueError, match="not finished"):
        load(spark, out)
    with pytest.raises(ValueError, match="other parameters"):
        run_two_pass_estimate(*args, total_levels=("Root",))
    (tmp_path / "out" / "steps" / "own_0").mkdir()  # left behind by a run that broke off while it wrote
    (tmp_path / "in" / "Leaf.parquet" / "DPQuery").rename(tmp_path / "gone")  # the input is not needed any more
    whole = run_two_pass_estimate(*args)
    again = load(spark, out)
    (tmp_path / "gone").rename(tmp_path / "in" / "Leaf.parquet" / "DPQuery")
    fresh = run_two_pass_estimate(*args[:4], str(tmp_path / "fresh"), MARGINAL)
    want = {(r.geocode, r.cell): r.final_estimate for r in fresh.estimates().collect()}
    for p in (whole, again):
        assert {(r.geocode, r.cell): r.final_estimate for r in p.estimates().collect()} == pytest.approx(want, abs=1e-9)
    assert {r.step for r in StoredRun.existing(spark, out).commits().collect()} >= set(before) | {"up_0", "final_0", "final_1"}
    assert again.variances([1]).count() == 18 and "final_mats_1" in StoredRun.existing(spark, out).done  # leaf matrices on demand


def test_query_rows_and_contraction():
    q = tab.tabular_query("q", (3, 2, 4), {2: [[0, 1], [3]]}, [0])
    whole = np.ones((1, 1))
    for f in q.factors:
        whole = np.kron(whole, factor_matrix(f))
    rows = as_rows([q, np.eye(24)[:5], q])
    assert rows.count == 13 and rows.cells == 24
    assert np.array_equal(rows.block(0, 13), np.vstack([whole, np.eye(24)[:5], whole])) and np.array_equal(rows.block(3, 10), np.vstack([whole, np.eye(24)[:5], whole])[3:10])
    x = np.random.default_rng(1).uniform(size=(7, 24))
    assert np.allclose(contract([factor_matrix(f) for f in q.factors], x), x @ whole.T)
