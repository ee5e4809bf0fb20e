"""The Katz model stays packed: few bytes a pair are written, and how pairs are dealt out changes no result."""

import random

import pytest

from stemtally.functions import lineage
from stemtally.llm import katz


def texts(n, words, vocabulary, seed):
    dice = random.Random(seed)
    return [(i, " ".join(f"w{int(vocabulary * dice.random() ** 2)}" for _ in range(dice.randint(0, words)))) for i in range(n)]


def test_few_bytes_a_pair_are_written(spark, monkeypatch):
    docs, written = texts(400, 500, 20_000, 1), []

    def watched(df, name="stage", by=()):
        out = lineage.cut_lineage(df, name, by)
        written.append(lineage.written_bytes(out))
        return out

    monkeypatch.setattr(katz, "cut_lineage", watched)
    monkeypatch.setattr(katz, "HEAD", 1 << 8)  # frequent pairs are a table of bounded size, here of few rows
    tokens = [t.split() for _, t in docs]
    pairs = len({p for t in tokens for p in zip(["\n", *t], [*t, "\n"])})
    katz.fit(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert pairs > 80_000 and sum(written) < 16 * pairs, (sum(written), pairs)


def test_ranges_and_hot_histories_change_no_score(spark, monkeypatch):
    docs = spark.createDataFrame([*texts(60, 80, 90, 2), (60, None), (61, "w1 unseen w2 unseen"), (61, "w1 unseen w2 unseen")], "doc_id bigint, text string")
    scores = []
    for size, least in ((10**9, 10**9), (400, 10**9), (400, 1), (400, 64)):
        monkeypatch.setattr(katz, "RANGE_BYTES", size)
        monkeypatch.setattr(katz, "HOT_LEAST", least)
        model = katz.fit(docs.filter("doc_id < 50"))
        scores.append(sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in katz.score(docs, model).collect()))
        assert len(scores[-1]) == 63 and model.pairs.count() == model.pairs.distinct().count() > 1000
    for other in scores[1:]:
        for a, b in zip(scores[0], other, strict=True):
            assert a == pytest.approx(b, rel=1e-9)


def test_packing_keeps_numbers():
    import numpy as np

    dice = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(np.concatenate([dice.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1), dice.integers(0, 1 << 20, n // 2, dtype=np.uint64)]))
        assert (katz.unpacked_keys(katz.packed_keys(keys)) == keys).all()
        for top in (1, 255, 256, 70_000, 1 << 40):
            x = dice.integers(0, top, n)
            assert (katz.unpacked_ints(katz.packed_ints(x)) == x).all()
