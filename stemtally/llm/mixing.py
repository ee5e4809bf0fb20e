"""Mixing sources to target weights: repetition rates from token totals, then whole copies plus one seeded draw.

Native: DataFrame functions only. The corpus is scanned twice and never
shuffled; per source totals combine before their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage
from stemtally.llm.common import carried, n_words, small, whole
from stemtally.operators.spine import surrogate_rank


def source_rates(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, text: str = "text", source: str = "source") -> DataFrame:
    """(source, source_size, weight, target, rate), one row per source.

    Sources in code point order, null last, take the weights in turn. The
    targets share the total of all sizes; a target stops at ``max_repeats``
    times its source's size and the excess goes to the others by weight until
    none is above. A source of size 0 has target 0 and rate 1: its empty
    documents are kept once. No documents give no rows.
    """
    sizes = cut_lineage(
        docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size")), "sizes"
    )
    rank = surrogate_rank(sizes.filter("source is not null").select(F.col("source").alias("geocode")))
    named = sizes.join(rank.withColumnRenamed("geocode", "source"), "source")
    last = sizes.filter("source is null").withColumn("rank", F.lit(rank.count()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sizes = cut_lineage(
        named.unionByName(last).select(
            "source", "source_size", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * max_repeats).alias("cap"),
        ),
        "weights",
    )
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, above = None, 0.0
    while above != level:  # the level only rises, so every round caps another source or is the last
        level = above
        capped = F.col("cap") < F.col("weight") * level
        taken, free = sizes.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        above = (total - (taken or 0)) / free if free else level
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return sizes.select(
        "source", "source_size", "weight", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(1.0)).alias("rate"),
    )


def draw(seed: str, doc_id: str, text: str) -> Column:
    """Number in [0, 1) from seed, id and text; identical rows share it."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), whole(text))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def mixture(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix",
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``docs`` with a struct ``mix`` (size, source_size, target, rate, copies).

    copies = floor(rate) plus one where the row's draw is below the fraction.
    Null texts have size 0; null sources are one source; null ids draw by
    their text; other columns pass through, a given ``mix`` is replaced. Reruns
    agree.
    """
    rates = source_rates(docs, weights, max_repeats, text, source)
    facts = rates.select(F.col("source").alias("_source"), F.struct("source_size", "target", "rate").alias("facts"))
    sized = docs.select(carried(docs, "mix"), n_words(F.col(text)).alias("size"), F.col(source).alias("source"), draw(seed, doc_id, text).alias("draw"))
    joined = sized.join(small(facts), F.col("source").eqNullSafe(F.col("_source")), "left")
    rate = F.col("facts.rate")
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return joined.select("row.*", F.struct("size", "facts.source_size", "facts.target", rate.alias("rate"), copies.alias("copies")).alias("mix"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times, numbered from 1 in ``copy``, which replaces a given column of that name."""
    return mixed.drop("copy").filter("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).drop("mix")
