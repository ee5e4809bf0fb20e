"""Quality rules: word and line counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Native: DataFrame functions only. Each document is scored in its own row; the
only table that meets all rows is the array of bucket ratios, whose length is
a parameter.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.llm.common import carried, let, small, whole, words

BUCKETS = 10_000
SYMBOLS = "#*$%&|<>"  # fixed by the rule
WINDOW = 5
THRESHOLD = -0.05


def _repeated(w: Column) -> Column:
    """Words of the list ``w`` that lie in a five-word window found twice or more in it.

    Windows are told apart by 64-bit hashes; two different windows of one
    text agree with a chance of 2^-64.
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def positions(s: Column) -> Column:
        twin = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: twin(j, j + 1) | twin(j, j - 1))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(placed, positions), covered)).otherwise(0)

    return F.when(n > WINDOW, let(hashes, count)).otherwise(0)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts count nothing and fail for having under ten words.
    A text of any length is one row; the work in it is that of a sort. A given
    column ``rules`` is replaced, no other name matters.
    """
    t = whole(text)
    counts = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r")))
    df = docs.select(carried(docs, "rules"), t.alias("t"), counts.alias("n"))
    t, n, repeat = F.col("t"), F.col("n.n"), F.col("n.r")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.select(
        "row.*",
        F.struct(
            n.alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            ((n < 10) | (repeat * 100 > n * 20)).alias("base_failed"),
        ).alias("rules"),
    )


def _grams(text: str, buckets: int) -> Column:
    """Buckets of the words and of the word pairs of a text."""

    def of(w: Column) -> Column:
        n = F.size(w)
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)).cast("int"))
        return F.when(n > 1, F.concat(one, two)).otherwise(one)

    return let(words(whole(text)), of)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Column:
    """Constant array: for each bucket log(p_trusted / p_raw), both with one added to every count.

    ``trusted`` (doc_id) names the target; the raw corpus is all of ``docs``.
    Counts combine to one row per bucket before their shuffle, so the driver
    sees ``buckets`` numbers whatever the corpus.
    """
    ids = trusted.select(F.col(doc_id).alias("_id")).filter("_id is not null").distinct().withColumn("_t", F.lit(1))
    grams = docs.select(F.col(doc_id).alias("_doc"), _grams(text, buckets).alias("_g"))
    flagged = grams.join(small(ids), F.col("_doc") == F.col("_id"), "left").select("_t", F.explode("_g").alias("b"))
    seen = {r.b: (r.raw, r.good) for r in flagged.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("good")).collect()}
    raw, good = sum(x for x, _ in seen.values()) + buckets, sum(x for _, x in seen.values()) + buckets
    ratios = [math.log((seen[b][1] + 1) / good) - math.log((seen[b][0] + 1) / raw) if b in seen else math.log(raw / good) for b in range(buckets)]
    return F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")


def quality(
    docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with ``rules``, ``llr`` (mean log ratio per n-gram; 0 without words) and ``kept``.

    kept is false where the base rules fail, else llr >= threshold: the same
    verdict on every run, for every document. Given columns of these names are
    replaced.
    """
    docs = docs.drop(*{"rules", "llr", "kept"} - {doc_id, text})
    ratios = bucket_ratios(docs, trusted, doc_id, text, buckets)
    mean = let(_grams(text, buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(ratios, x)) / F.nullif(F.size(g), F.lit(0)))
    df = base_rules(docs, text).select("*", F.coalesce(mean, F.lit(0.0)).alias("llr"))
    return df.select("*", (~F.col("rules.base_failed") & (F.col("llr") >= threshold)).alias("kept"))
