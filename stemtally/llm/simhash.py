"""SimHash near-duplicates, candidates pruned by pigeonring chains.

A fingerprint is cut into a ring of m segments. If two fingerprints differ in
at most two bits, some start on the ring has, for every chain length l, at
most floor(2 l / m) differing bits in the l segments that follow it. The first
links of that chain have a budget of zero, so their bits are an exact join
key; a fingerprint alone in all of its keys has no partner and is dropped.
What is left differs within budget in the later segments only: two partners
then meet in a point one flip away from each, and a point has at most 65
fingerprints around it. So groups of copies of any size give a bounded number
of rows per fingerprint and never a pair for each two members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, release
from stemtally.llm.common import carried, small, whole
from stemtally.llm.components import connected_components
from stemtally.llm.substring import NO_ID, keyed

BITS, DISTANCE, SEGMENTS = 64, 2, 5


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit k is set if it is set in over half of the shingle hashes; A-Z count as a-z; no words give 0."""
    w = text.lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    if not w:
        return 0
    shingles = [w] if len(w) < width else zip(*(w[k:] for k in range(width)), strict=False)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without the text, with ``fp`` (bigint). A null text counts as empty."""
    keep = [c for c in docs.columns if c != text]

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(x, width) for x in t], dtype="int64")

    return docs.select(*keep, of(whole(text).cast("binary")).alias("fp"))


def ring(segments: int = SEGMENTS) -> list[int]:
    """Bit masks of the segments."""
    cut = [BITS * k // segments for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def _mask(parts: list[int], start: int, links: range) -> int:
    out = 0
    for k in links:
        out |= parts[(start + k) % len(parts)]
    return out


def within_chain(differing: Column, segments: int = SEGMENTS) -> Column:
    """True if some start keeps every chain of segments within its proportional budget."""
    parts, ok = ring(segments), F.lit(False)
    for i in range(segments):
        chain = F.lit(True)
        for n in range(1, segments + 1):
            chain &= F.bit_count(differing.bitwiseAND(_signed(_mask(parts, i, range(n))))) <= DISTANCE * n // segments
        ok |= chain
    return ok


def link(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Edges (t, u, v) between distinct fingerprints (``fp``) of a table ``t`` that connect just what links of at most two bits connect."""
    parts = ring(segments)
    lead = max(n for n in range(1, segments + 1) if DISTANCE * n // segments == 0)
    fp = F.col("fp")
    starts = [
        F.struct(F.lit(i).alias("i"), fp.bitwiseAND(_signed(_mask(parts, i, range(lead)))).alias("key"), _signed(_mask(parts, i, range(lead, segments))).alias("free"))
        for i in range(segments)
    ]
    arcs = fps.select("t", "fp", F.inline(F.array(*starts)))
    busy = arcs.groupBy("t", "i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "i", "key")
    open_bits = arcs.join(busy, ["t", "i", "key"]).groupBy("t", "fp").agg(F.bit_or("free").alias("free"))
    flip = F.lit(1).cast("bigint")
    flips = [F.when(F.col("free").bitwiseAND(F.shiftleft(flip, b)) != 0, fp.bitwiseXOR(F.shiftleft(flip, b))) for b in range(BITS)]
    points = open_bits.select("t", "fp", F.explode(F.array_compact(F.array(fp, *flips))).alias("point"))
    around = points.groupBy("t", "point").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    pairs = around.select("t", "u", F.explode("near").alias("v")).filter("u <> v").distinct()
    apart = F.col("u").bitwiseXOR(F.col("v"))
    return pairs.filter(within_chain(apart, segments)).filter(F.bit_count(apart) <= DISTANCE)


def components_of(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(fp, component), written, for every distinct fingerprint of a written table ``fps`` (fp)."""
    edges = cut_lineage(link(fps.select(F.lit(0).alias("t"), "fp"), segments).select("u", "v"), "links")
    nodes = connected_components(edges)
    out = cut_lineage(fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(*fps.columns, F.coalesce("component", "fp").alias("component")), "components")
    release(edges)
    return out


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` without the text, with ``fp`` and ``component_id``.

    component_id is the smallest id reachable over links of at most two
    differing bits, the row's own included; ids that are null are passed over
    and a class of null ids only has null. Equal fingerprints are one node,
    whatever their number; empty texts share the fingerprint 0. Given columns
    of these two names are replaced; no other name matters.
    """
    rows = docs.select(carried(docs, text, "fp", "component_id"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = cut_lineage(fingerprints(rows, width=width), "fingerprints")
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    classed = components_of(fps, segments)
    least = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    of = cut_lineage(classed.join(least, "component").select("fp", "component_id"), "classes")
    release(fps, classed)
    return rows.join(small(of), "fp").select("row.*", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_classes`: that of the smallest id, null ids last.

    Of rows with that id and differing texts one stays, of rows equal in id
    and text likewise. All columns are kept, whatever their names.
    """
    prints = fingerprints(keyed(docs, doc_id, text), width=width)
    named = cut_lineage(prints.groupBy("did", "tkey", "fp").agg(F.count(F.lit(1)).alias("n")), "named")
    fps = cut_lineage(named.select("fp").distinct(), "distinct")
    classed = cut_lineage(named.join(components_of(fps, segments), "fp"), "classed")
    kept = cut_lineage(classed.groupBy("component").agg(F.min(F.struct("did", "tkey", "n")).alias("k")), "kept")  # written, so that the join of a large class is split
    others = classed.join(small(kept), "component").filter((F.col("did") != F.col("k.did")) | (F.col("tkey") != F.col("k.tkey")))
    others = cut_lineage(others.select("did", "tkey"), "others")
    again = cut_lineage(classed.filter("n > 1").select("did", "tkey", F.lit(True).alias("again")), "again")
    release(named, fps)
    did, tkey = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)), F.xxhash64(whole(text))
    rows = docs.select(carried(docs), did.alias("did"), tkey.alias("tkey")).join(small(others), ["did", "tkey"], "left_anti").join(small(again), ["did", "tkey"], "left")
    once = rows.filter("again").groupBy("did", "tkey").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.filter("again is null").select("row.*").union(once.select("row.*"))
