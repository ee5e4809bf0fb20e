"""Groups that share members: right components, and rounds that run on links alone."""

import random

from stemtally.functions import components, lineage
from stemtally.operators import marginalize as mg


def expected(rows):
    """Union-find over groups; null groups are none, null members join nothing."""
    home, of = {}, {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for g, m in rows:
        if g is not None and m is not None:
            of.setdefault(g, m)
            a, b = sorted((root(of[g]), root(m)))
            home[b] = a
    out = {m: root(m) for g, m in rows if g is not None and m is not None}
    lost = [root(of[g]) for g, m in rows if g in of and m is None]
    return out | ({None: min(lost)} if lost else {})


def test_components(spark):
    dice = random.Random(7)
    for n in (0, 1, 40, 90):
        rows = [(dice.randrange(60), dice.randrange(80)) for _ in range(n)] + [(None, 3), (None, 500), (7, None), (9, None), (700, None)] * (n > 1) + [(5, 6), (5, 6)] * (n > 1)
        got = mg.merge_overlapping(spark.createDataFrame(rows, "grp bigint, member bigint")).collect()
        assert len(got) == len({r.member for r in got}) and {r.member: r.component for r in got} == expected(rows), n


def test_rounds_leave_settled_groups_alone(spark, monkeypatch):
    rows = [(k, k + 1) for k in range(100, 4000)] + [(10_000 + k, 5000 + k) for k in range(40)] + [(10_000 + k, 5001 + k) for k in range(40)]
    written = []

    def watched(df, name="stage", by=()):
        out = lineage.cut_lineage(df, name, by)
        written.append(out.count())
        return out

    monkeypatch.setattr(mg, "cut_lineage", watched)
    monkeypatch.setattr(components, "cut_lineage", watched)
    got = {r.member: r.component for r in mg.merge_overlapping(spark.createDataFrame(rows, "grp bigint, member bigint")).collect()}
    assert all(got[5000 + k] == 5000 for k in range(41)) and all(got[k + 1] == k + 1 for k in range(100, 4000))
    assert sum(written) < 4 * len(rows), written
