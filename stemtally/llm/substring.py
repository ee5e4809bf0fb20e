"""Exact substring dedup by seed and extend: winnowed anchors, runs of windows around them, maximal repeats over a length.

Every window of ``length`` words owns one seed, its smallest word k-gram (the
winnowing choice), so equal windows own equal seeds at equal offsets. The
windows of one seed occurrence are neighbours and form a run: the seed
extended both ways as far as it stays the smallest. Documents meet on seeds.
Equal runs are one class, whose smallest document is known after one
aggregation, so copies cost a row each and never a pair; only seeds that
stand in different runs of different documents are extended window by window.
Windows that lie in an earlier document, joined up, are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage
from stemtally.llm.common import carried, whole

LENGTH, SEED = 50, 10
BATCH_WORDS = 300_000  # words hashed at a time, unless one text has more
VOCABULARY = 400_000  # word hashes remembered at a time; more are hashed again
NO_ID = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # any odd numbers


class WordHashes(dict):
    """word -> place in ``values``, two 64-bit hashes per word."""

    def __init__(self):
        self.values = np.empty((2, VOCABULARY), np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == self.values.shape[1]:
            self.values = np.concatenate([self.values, np.empty_like(self.values)], axis=1)
        x = xxhash.xxh3_128_intdigest(word)
        self.values[0, k], self.values[1, k] = x & 0xFFFFFFFFFFFFFFFF, x >> 64
        self[word] = k
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.clear()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.values[:, places]


class Rolling:
    """Hashes of any stretch of a word sequence, from prefix sums of hash times base^position."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64)] * 2
        self.down = [np.ones(1, np.uint64)] * 2

    def load(self, hashes: np.ndarray) -> None:
        n = hashes.shape[1] + 1
        for k, base in enumerate(BASES):
            if len(self.up[k]) < n:
                for to, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                    steps = np.full(n, b, np.uint64)
                    steps[0] = 1
                    to[k] = np.multiply.accumulate(steps)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[k] * self.up[k][: n - 1], dtype=np.uint64)]) for k in range(2)]

    def stretch(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[k][end] - self.sums[k][start]) * self.down[k][start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def runs_of(rolling: Rolling, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first window start, windows, seed position) of each run; ``ends`` are the document ends in the word sequence."""
    n, wide = int(ends[-1]), length - seed + 1
    if n < length:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(n - seed + 1)
    grams = rolling.stretch(0, at, at + seed)
    starts = np.arange(n - length + 1)
    place = starts + np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1)
    doc = np.searchsorted(ends, starts, side="right")
    ok = ends[doc] >= starts + length
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & ok)
    change = np.append(np.flatnonzero(new | ~ok), len(starts))
    return first, change[np.searchsorted(change, first, side="right")] - first, place[first]


def _blocks(words: list[list[bytes]]) -> Iterator[range]:
    """Consecutive rows with about BATCH_WORDS words."""
    at = total = 0
    for k, w in enumerate(words):
        total += len(w)
        if total >= BATCH_WORDS:
            yield range(at, k + 1)
            at, total = k + 1, 0
    if at < len(words):
        yield range(at, len(words))


def seed_runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Runs of every document: (seed, a, b, n, did, tkey, start); a and b hash the run's words, n counts its windows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rolling = WordHashes(), Rolling()
        for pdf in batches:
            words = [t.split() for t in pdf["text"]]
            did, tkey = pdf["did"].to_numpy(), pdf["tkey"].to_numpy()
            for rows in _blocks(words):
                sizes = np.array([len(words[k]) for k in rows])
                ends = np.cumsum(sizes)
                if not ends[-1]:
                    continue
                rolling.load(known.of([w for k in rows for w in words[k]]))
                start, n, place = runs_of(rolling, ends, length, seed)
                doc = np.searchsorted(ends, start, side="right")
                stop = start + n - 1 + length
                yield pd.DataFrame({
                    "seed": rolling.stretch(0, place, place + seed).view(np.int64), "a": rolling.stretch(0, start, stop).view(np.int64),
                    "b": rolling.stretch(1, start, stop).view(np.int64), "n": n.astype(np.int32),
                    "did": did[rows.start :][doc], "tkey": tkey[rows.start :][doc], "start": (start - (ends - sizes)[doc]).astype(np.int32),
                })

    return docs.mapInPandas(work, "seed bigint, a bigint, b bigint, n int, did bigint, tkey bigint, start int")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """(x, y, did, tkey, start): both hashes of every window of the runs listed beside a text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rolling = WordHashes(), Rolling()
        for pdf in batches:
            for did, tkey, text, runs in pdf[["did", "tkey", "text", "runs"]].itertuples(index=False):
                rolling.load(known.of(text.split()))
                at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs]))
                yield pd.DataFrame({"x": rolling.stretch(0, at, at + length).view(np.int64), "y": rolling.stretch(1, at, at + length).view(np.int64), "did": did, "tkey": tkey, "start": at.astype(np.int32)})

    return rows.mapInPandas(work, "x bigint, y bigint, did bigint, tkey bigint, start int")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(did, tkey, text as bytes); a null id counts as larger than every id."""
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("did"), F.xxhash64(whole(text)).alias("tkey"), whole(text).cast("binary").alias("text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(did, tkey, start, stop): stretches of words covered by windows that also start in a document with a smaller id.

    Stretches of one document may overlap; joined up they are its maximal
    repeats of at least ``length`` words. (did, tkey) name the document, see
    :func:`keyed`. Rows with one id are one document: none is earlier than
    the other.
    """
    base = keyed(docs, doc_id, text)
    runs = cut_lineage(seed_runs(base, length, seed), "runs")
    classes = runs.groupBy("seed", "a", "b", "n").agg(F.min("did").alias("first"), F.max("did").alias("last"))
    mixed = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("lo"), F.max("first").alias("hi")).filter("k > 1 and lo < hi").select("seed", F.lit(True).alias("mixed"))
    classes = classes.join(mixed, "seed", "left").filter("first < last or mixed")
    seen = cut_lineage(runs.join(classes.drop("seed", "last"), ["a", "b", "n"]), "shared")
    copied = seen.filter("did > first").select("did", "tkey", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    open_runs = seen.filter("did = first and mixed").groupBy("did", "tkey").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    windows = cut_lineage(_windows(base.join(open_runs, ["did", "tkey"]).dropDuplicates(["did", "tkey"]), length), "windows")
    earliest = windows.groupBy("x", "y").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter("lo < hi").select("x", "y", "lo")
    found = windows.join(earliest, ["x", "y"]).filter("did > lo").select("did", "tkey", "start", (F.col("start") + length).alias("stop"))
    return copied.union(found)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct ``dedup``: n_words, n_removed, kept (the words left, joined by one space).

    Null and empty texts have no words; texts under ``length`` words, and
    texts of which nothing repeats, keep all. A given column ``dedup`` is
    replaced, no other name matters.
    """
    spans = repeats(docs, doc_id, text, length, seed).distinct().groupBy("did", "tkey").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    @F.pandas_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, ranges in zip(texts, spans, strict=True):
            w = t.split()
            if ranges is None or not len(ranges):
                out.append((len(w), 0, b" ".join(w).decode()))
                continue
            edge = np.zeros(len(w) + 1, np.int64)
            for r in ranges:
                edge[r["start"]] += 1
                edge[r["stop"]] -= 1
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            out.append((len(w), len(w) - len(keep), b" ".join([w[k] for k in keep]).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    did, tkey = _names(doc_id, text)
    rows = docs.select(carried(docs, "dedup"), did.alias("did"), tkey.alias("tkey"), whole(text).cast("binary").alias("text"))
    return rows.join(spans, ["did", "tkey"], "left").select("row.*", cut("text", "spans").alias("dedup"))


def _names(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)), F.xxhash64(whole(text))
