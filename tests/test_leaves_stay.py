"""Leaves whose files lie far below the broadcast limit: their rows never pass through the driver, in either pass or for entities."""

import pytest
from pyspark.sql import functions as F

from stemtally.functions import lineage
from stemtally.functions.keys import Spine
from stemtally.operators import entities, gls_diagonal as gd

LEAVES, CELLS, LIMIT = 8000, 3, 150_000
SPINE = Spine(("a", "b", "c"), (0, 1, 6))


def sent(df):
    """Rows of the largest table that running ``df`` broadcasts."""
    df.collect()
    out, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("BroadcastExchange"):
            out.append(node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    return max(out)


@pytest.fixture
def tight(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", LIMIT)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_leaves_are_not_broadcast(spark, tight):
    seen = {}

    def watched(df, name="stage"):
        seen[name] = max(seen.get(name, 0), sent(df))
        return lineage.cut_lineage(df, name)

    leaf = spark.range(LEAVES).select(F.concat((F.col("id") % 2).cast("string"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("geocode"))
    own = []
    for codes in (spark.range(1).select(F.lit("").alias("geocode")), leaf.select(F.left("geocode", F.lit(1)).alias("geocode")).distinct(), leaf):
        rows = codes.select("geocode", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")).select("*", F.lit(2.0).alias("value"), F.lit(1.0).alias("variance"))
        own.append(gd.single_estimate(lineage.cut_lineage(rows.coalesce(1).sortWithinPartitions("geocode"), "own")))
    assert lineage.written_bytes(lineage.cut_lineage(own[2].coalesce(1), "size")) < LIMIT
    p = gd.DiagonalPasses(SPINE, own, cut=watched).run_down()
    cover = lineage.cut_lineage(leaf.select(F.concat(F.lit("e"), F.col("geocode").substr(6, 1)).alias("entity"), F.lit(2).alias("depth"), "geocode"), "cover")
    seen["final"] = sent(p.final[2])
    seen["estimate"] = sent(entities.entity_estimate(cover, p.estimates()))
    v = entities.entity_variance(cover, p)
    seen["variance"] = sent(v)
    assert max(seen.values()) < LEAVES, seen
    # 800 of the leaves of one parent: v * 800 - (v * 800) ** 2 / (v * 4000) and the square of the share times the parent's variance
    up = 1 / (1 + 1 / LEAVES * 2)
    root = 1 / (1 + 1 / (2 * up))
    mid = up - up / 2 + root / 4
    assert {(r.entity, r.cell): round(r.variance, 9) for r in v.collect()} == {(f"e{k}", c): round(800 - 160 + 0.04 * mid, 9) for k in range(10) for c in range(CELLS)}


def test_few_counts_rows(spark, tight):
    many = lineage.cut_lineage(spark.range(100_000).select(F.lit(1).cast("bigint").alias("x")), "same")
    assert lineage.written_bytes(many) < LIMIT and not lineage.few(many)
    assert lineage.few(lineage.cut_lineage(spark.range(100), "few")) and not lineage.few(spark.range(1))
