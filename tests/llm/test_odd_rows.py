"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import corpus_pipeline
import pytest

from stemtally.llm import katz, mixing, pages, quality, simhash, substring, surrogates, templates, toxicity, url_filter


def run(spark, docs, labels):
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20, 50))), (None, None), (2, ""), (3, "w1 w2")], "item_id bigint, text string")
    yield "toxicity", toxicity.score(docs, toxicity.fit(docs, labels))
    yield "surrogates", surrogates.replace(docs, b"key")
    yield "substring", substring.remove_repeats(docs)
    yield "templates", templates.drop_leaks(docs, bench)
    yield "simhash", simhash.near_classes(docs)
    yield "keep one", simhash.keep_one(docs)
    yield "quality", quality.quality(docs, labels.filter("quality = 1").select("doc_id"))
    yield "mixing", mixing.mixture(docs)
    yield "katz", katz.score(docs, katz.fit(docs))


def test_odd(spark, odd, labels):
    out = {name: df.collect() for name, df in run(spark, odd, labels)}
    n = odd.count()
    for name in ("toxicity", "surrogates", "substring", "simhash", "quality", "mixing", "katz"):
        assert len(out[name]) == n, name
    assert {r.doc_id for r in out["templates"]} == {1, 2, 3, 6, 8, 9, None}  # the texts with an item are gone, those with the item of two words as well
    assert sum(r.doc_id == 6 for r in out["templates"]) == 1
    assert sum(r.dedup.n_removed for r in out["substring"] if r.doc_id in (5, None, 7)) == 60_000 + 120 + 120
    assert sum(r.dedup.n_removed for r in out["substring"] if r.doc_id in (1, 2, 3, 4, 6, 8, 9)) == 0
    assert {r.component_id for r in out["simhash"] if not (r.fp or 0)} == {1}
    kept = [(r.doc_id, r.text) for r in out["keep one"]]
    assert len(kept) == len(set(kept)) and {k for k, _ in kept} == {1, 4, 6, 7, 8, 9} and len(kept) == 7
    assert len({r.score for r in out["katz"] if r.doc_id == 6}) == 2  # two equal rows and another text
    for name, rows in out.items():  # a result replaces a given column of its name, all others stay
        assert len(rows[0].__fields__) == len(set(rows[0].__fields__)), name
    for name in ("surrogates", "substring", "templates", "keep one", "quality", "mixing"):
        assert {c for c in odd.columns} <= set(out[name][0].__fields__), name
        assert {(r.start, r.kind, r.fp, r._n, r._did) for r in out[name]} == {(1, "k", 7, 2, 9)}, name
    assert all(abs(r.mix.copies - r.mix.rate) < 1 for r in out["mixing"])


def test_empty(spark, empty, labels):
    for name, df in run(spark, empty, labels):
        assert df.count() == 0, name


def test_no_labels_and_no_benchmark(spark, odd, labels):
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).filter("score >= 0.5").count() == 0
    assert templates.leaks(odd, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


@pytest.mark.parametrize("make", ["odd", "empty"])
def test_stages(spark, make, request, labels, tmp_path):
    docs = request.getfixturevalue(make)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of that sort at all in here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "", ""), (2, "no address", "<p>a"), (3, "HTTP://A.B/x", None), (3, "HTTP://A.B/x", "<p>b"), (3, "HTTP://A.B/x", "<p>b"), (4, "http://a.b/y", "<p>" * 5000 + "c")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "page_id bigint, url string, html string, key int, host string")
    for frame in (df, df.limit(0)):
        assert pages.main_text(frame).count() == url_filter.judge(frame, [("block", "b", "/x")]).count() == frame.count()
    text = {(r.page_id, r.text) for r in pages.main_text(df).collect()}
    assert {(None, ""), (1, ""), (2, "a")} <= text
    verdicts = {(r.page_id, r.judged.host, r.judged.verdict) for r in url_filter.judge(df, [("block", "b", "/x")]).collect()}
    assert verdicts == {(None, "", "allow"), (1, "", "allow"), (2, "", "allow"), (3, "a.b", "block"), (4, "a.b", "allow")}
