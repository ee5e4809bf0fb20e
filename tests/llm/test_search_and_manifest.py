"""Ranked search, inner-product top-k and the Merkle manifest against brute force, on odd rows and small blocks."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stemtally.llm import inner_topk, merkle, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, k):
    held = [(i, Counter(tokens(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in tokens(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def texts(dice, n):
    words = [f"w{k}" for k in range(60)] + ["The", "the", "ÉTÉ", "été", "x9", "naïve"]
    return [" ".join(dice.choice(words[: dice.choice((8, 30, 66))]) + dice.choice(["", ",", ".", "-"]) for _ in range(dice.choice((0, 1, 5, 40, 300)))) for _ in range(n)]


@pytest.mark.parametrize("rows", [16, 2048])
def test_search(spark, rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "ROWS", rows)
    dice = random.Random(rows)
    docs = list(enumerate(texts(dice, 300))) + [(1000 + k, "the w1 w2 w3") for k in range(60)] + [(None, "w1 w2"), (5, None), (5, "w1"), (5, "w1"), (6, "long " * 20_000 + "w1")]
    items = [(k, " ".join(dice.choice([f"w{j}" for j in range(80)] + ["the", "ÉTÉ!"]) for _ in range(dice.randint(1, 25)))) for k in range(12)] + [(50, None), (51, ""), (52, "absent words"), (None, "the w1"), (53, "w1"), (53, "w1"), (54, "w1 " * 9)]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id bigint, text string, key string, q int")
    asks = spark.createDataFrame([(*i, 5) for i in items], "item_id bigint, text string, terms int")
    got = [tuple(r) for r in ranked_search.search(frame, asks, 7).collect()]
    assert sorted(got, key=str) == ranked(docs, items, 7)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 40)
    docs, items = list(enumerate(texts(random.Random(1), 120))), [(k, f"w{k} the w{k + 1} x9") for k in range(20)]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 5)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit("  ")), items)):
        assert ranked_search.search(d, i).count() == 0
    assert ranked_search.search(docs, items).count() == 0 or ranked_search.search(docs, items).first().doc_id == 1


def best(rows, k):
    ok = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i is None or i % 20:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, j) for m, j, w in ok if m != n)
        out += [(i, r + 1, x[4], -x[0]) for r, x in enumerate(s[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("lists,dims,block", [(2, 16, 32), (3, 7, 1000), (1, 4, 10)])
def test_top_k(spark, lists, dims, block, monkeypatch):
    monkeypatch.setattr(inner_topk, "ROWS", block)
    monkeypatch.setattr(inner_topk, "QUERIES", 5)
    dice = random.Random(dims)
    rows = [(k, [dice.gauss(0, 0.3) for _ in range(dims)]) for k in range(220)]
    rows += [(300 + k, rows[7][1]) for k in range(80)]  # a group of copies
    rows += [(900, None), (920, [float("nan")] * dims), (940, [None] + [0.0] * (dims - 1)), (960, [float("inf")] * dims), (None, rows[0][1]), (40, rows[0][1]), (40, rows[0][1]), (980, [0.5]), (1000, []), (1020, [1e5] * dims)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, rid int, block int")
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # blocks must meet whatever their hashes
    try:
        got = inner_topk.top_k(frame, F.col("vec_id") % 20 == 0, 9, lists=lists).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted((tuple(r) for r in got), key=str) == best(rows, 9)


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in inner_topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 64 - 128 * 128)]
    for f in (frame.limit(0), frame.filter("vec_id = 1"), frame.filter("vec_id = 0")):
        assert inner_topk.top_k(f, F.col("vec_id") % 20 == 0).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(h, fanout):
    out = [h]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proof(tree, at, fanout):
    out = []
    for level in tree[:-1]:
        first = at - at % fanout
        out += level[first:at] + level[at + 1 : first + fanout]
        at //= fanout
    return out


def manifest(rows, fanout):
    groups = {}
    for i, lang, text in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, sha(field(i), field(lang), field(text)), i))
    trees = {g: levels([x[2] for x in sorted(v)], fanout) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in order], fanout)
    out = []
    for g, v in groups.items():
        for at, x in enumerate(sorted(v)):
            path = proof(trees[g], at, fanout) + proof(top, order.index(g), fanout)
            out.append((x[3], x[2], trees[g][-1][0], top[-1][0], "".join(path)))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,size,n", [(2, 4, 137), (2, 1, 23), (3, 9, 200), (2, 4096, 60), (4, 4, 65)])
def test_manifest(spark, fanout, size, n):
    dice = random.Random(n)
    rows = [(k, dice.choice(["en", "de", "fr", None, "é"]) if k % 3 else "en", f"text {k}") for k in range(n)]
    rows += [(None, "en", "a"), (None, "en", None), (7, "en", "text 7"), (7, "en", "text 7"), (7, "en", "other"), (9999, "lone", ""), (10_000, "", "empty language")]
    dice.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, lang string, text string, merkle int, grp string")
    out = merkle.manifest(frame, merkle.leaf("doc_id", "lang", "text"), "lang", "doc_id", fanout=fanout, size=size)
    assert set(out.columns) == {"doc_id", "lang", "text", "grp", "merkle"}
    got = out.select("doc_id", "merkle.*", merkle.siblings(F.col("merkle.path")).alias("s"), merkle.folded(F.col("merkle.leaf"), F.col("merkle.path")).alias("f"))
    got = got.collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.s) for r in got), key=str) == manifest(rows, fanout)
    assert all(r.f == r.root for r in got)


def test_manifest_of_little(spark):
    frame = spark.createDataFrame([(1, "en")], "doc_id bigint, lang string")
    one = merkle.manifest(frame, merkle.leaf("doc_id"), "lang", "doc_id").first().merkle
    assert one.leaf == one.subroot == one.root == sha("1:1") and one.path == ""
    assert merkle.manifest(frame.limit(0), merkle.leaf("doc_id"), "lang", "doc_id").count() == 0
