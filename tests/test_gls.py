import numpy as np
import pytest

from stemtally.functions.keys import Spine
from stemtally.functions.lineage import cut_lineage
from stemtally.operators import entities, gls_diagonal as gd
from stemtally.operators.covers import coarsest_cover
from stemtally.operators.entities_dense import entity_covariance
from stemtally.operators.gls_dense import DensePasses, dense_own
from trees import DESIGN, brute_force, node_selector, only_children, random_tree


def make_rows(rng, levels, variances):
    """Measurements of every node; an only leaf is bypassed, as the estimator treats it."""
    lone = only_children(levels)
    rows, table = {}, []
    for d, level in enumerate(levels):
        for g in level:
            for q, mat in DESIGN.items():
                v = variances(d, g, q)
                y = [float(x) for x in rng.normal(10, 3, len(mat))]
                table.append((d, g, q, y, v))
                if g not in lone:
                    rows.setdefault(g, []).extend((np.array(c), yy, v) for c, yy in zip(mat, y))
    return rows, table


def dense_passes(spark, spine, table, share=True):
    design = spark.createDataFrame(
        [(q, i, j, c, 1.0) for q, m in DESIGN.items() for i, r in enumerate(m) for j, c in enumerate(r) if c],
        "query_name string, row_ix int, cell int, coef double, mult double",
    )
    m = spark.createDataFrame(table, "depth int, geocode string, query_name string, value array<double>, variance double")
    return DensePasses(spine, 2, *dense_own(m, design, 2, share=share)).run_down(leaf_matrices=True)


def flat_prior(levels, rows):
    """A very flat prior on each leaf stands for "unknown"; what the data determine is unaffected."""
    return {**rows, **{g: rows.get(g, []) + [(np.eye(2)[c], 0.0, 1e9) for c in range(2)] for g in levels[-1]}}


def random_cover(spark, rng, spine, levels):
    leaf_entity = [(g, f"e{int(rng.integers(0, 3))}") for g in levels[-1]]
    cover = coarsest_cover(spark.createDataFrame(leaf_entity, "leaf string, entity string"), spine)
    pick = {e: sum(node_selector(g, levels[-1], 2) for g, x in leaf_entity if x == e) for e in {x[1] for x in leaf_entity}}
    return cover, pick


@pytest.mark.parametrize("seed,bypass", [(1, 0.0), (2, 0.3)])
def test_dense_matches_brute_force(spark, seed, bypass):
    rng = np.random.default_rng(seed)
    spine, levels = random_tree(rng, 3)
    off = {g for level in levels[1:] for g in level if rng.uniform() < bypass}
    rows, table = make_rows(rng, levels, lambda d, g, q: float("inf") if g in off else float(1 / rng.uniform(0.2, 2)))
    mean, cov = brute_force(levels, flat_prior(levels, rows), 2)
    p = dense_passes(spark, spine, table)
    est = {(r.geocode, r.cell): r.final_estimate for r in p.estimates().collect()}
    var = {(r.geocode, r.cell): r.final_variance for r in p.variances().collect()}
    assert len(est) == 2 * sum(map(len, levels))
    for level in levels:
        for g in level:
            s = node_selector(g, levels[-1], 2)
            for c in range(2):
                want = (s @ cov @ s.T)[c, c]
                if want > 1e5:
                    assert var.get((g, c)) is None
                else:
                    assert est[g, c] == pytest.approx((s @ mean)[c], abs=1e-4)
                    assert var[g, c] == pytest.approx(want, rel=1e-5)
    cover, pick = random_cover(spark, rng, spine, levels)
    ask = np.array([[1.0, 0.0], [1.0, 1.0], [2.0, -1.0]])
    for e in entity_covariance(cover, p, ask).collect():
        s = ask @ pick[e.entity]
        want, got = s @ cov @ s.T, unpack_any(e.covariance, 3)
        for i in range(3):
            if want[i, i] > 1e5:
                assert np.isinf(got[i, i])
            else:
                assert e.estimate[i] == pytest.approx((s @ mean)[i], abs=1e-4)
                for k in range(3):
                    if want[k, k] <= 1e5:
                        assert got[i, k] == pytest.approx(want[i, k], rel=1e-4, abs=1e-6)


def unpack_any(v, n):
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = v
    return np.triu(m) + np.triu(m, 1).T


def diagonal_passes(spark, spine, levels, table):
    own = []
    for d in range(spine.depth + 1):
        cells = spark.createDataFrame(
            [(g, i, y[i], v) for dd, g, q, y, v in table if dd == d and q == "detailed" for i in range(2)],
            "geocode string, cell int, value double, variance double",
        )
        own.append(gd.own_estimate(cells))
    return gd.DiagonalPasses(spine, own, cut=cut_lineage).run_down()


@pytest.mark.parametrize("seed,bypass", [(3, 0.2), (5, 0.45)])
def test_diagonal_with_bypassed_nodes(spark, seed, bypass):
    rng = np.random.default_rng(seed)
    spine, levels = random_tree(rng, 3)
    rows, table = make_rows(
        rng, levels, lambda d, g, q: float("inf") if rng.uniform() < bypass and d else float(1 / rng.uniform(0.2, 2))
    )
    rows = {g: [x for x in r if x[0].sum() == 1] for g, r in rows.items()}
    mean, cov = brute_force(levels, flat_prior(levels, rows), 2)
    p = diagonal_passes(spark, spine, levels, table)
    got = {(r.geocode, r.cell): r for r in p.estimates().collect()}
    for level in levels:
        for g in level:
            s = node_selector(g, levels[-1], 2)
            for c in range(2):
                want = (s @ cov @ s.T)[c, c]
                if want > 1e5:
                    assert got[g, c].final_variance is None
                else:
                    assert got[g, c].final_estimate == pytest.approx((s @ mean)[c], abs=1e-4)
                    assert got[g, c].final_variance == pytest.approx(want, rel=1e-5)
    assert all(abs(r.gap) < 1e-9 for r in gd.children_sum_check(p.final, spine).collect())
    cover, pick = random_cover(spark, rng, spine, levels)
    gotv = {(r.entity, r.cell): r.variance for r in entities.entity_variance(cover, p).collect()}
    for e, s in pick.items():
        for c in range(2):
            want = (s @ cov @ s.T)[c, c]
            if want > 1e5:
                assert np.isinf(gotv[e, c])
            else:
                assert gotv[e, c] == pytest.approx(want, rel=1e-5)


def test_sharing_changes_nothing(spark):
    rng = np.random.default_rng(7)
    spine, levels = random_tree(rng, 2, 1, 4)
    _, table = make_rows(rng, levels, lambda d, g, q: float("inf") if g.endswith("1") and d == 1 else float(1 + d))
    a, b = dense_passes(spark, spine, table), dense_passes(spark, spine, table, share=False)
    ea = {(r.geocode, r.cell): r.final_estimate for r in a.estimates().collect()}
    eb = {(r.geocode, r.cell): r.final_estimate for r in b.estimates().collect()}
    assert ea.keys() == eb.keys()
    assert all(abs(ea[k] - eb[k]) < 1e-9 for k in ea)
    assert a.mats[2].count() < b.mats[2].count()


def test_a_bypassed_unit_says_nothing_with_its_other_rows(spark):
    """Two cells: the root's detailed answers are withheld, its total is not; the leaves stay as measured."""
    spine = Spine(("root", "leaf"), (0, 1))
    table = [
        (0, "", "detailed", [0.0, 0.0], float("inf")), (0, "", "total", [100.0], 1.0),
        (1, "a", "detailed", [1.0, 2.0], 1.0), (1, "b", "detailed", [3.0, 4.0], 1.0),
    ]
    got = {(r.geocode, r.cell): r.final_estimate for r in dense_passes(spark, spine, table).estimates().collect()}
    want = {("", 0): 4.0, ("", 1): 6.0, ("a", 0): 1.0, ("a", 1): 2.0, ("b", 0): 3.0, ("b", 1): 4.0}
    assert got == pytest.approx(want)
