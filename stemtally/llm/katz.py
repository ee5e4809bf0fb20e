"""Katz backoff over words: Good-Turing discounted counts, exactly normalised backoff weights.

The model is a bigram that falls back on a unigram, which falls back on one
class of unknown words:

    P(w | h) = d(c) c(h, w) / total(h)   where the pair is kept
             = alpha(h) P(w)             else
    P(w)     = d(c) c(w) / total         where the word is known, else the mass left over

A pair is kept from ``min_count`` on; alpha(h) is what the kept pairs leave of
1, over what their words leave of 1 in the unigram, so each history sums to 1.
Where nothing would be left over, the total is raised by one.

Words and pairs travel as 64-bit hashes in packed arrays, one per block of
text and hash range, so a shuffle costs about ten bytes per distinct pair of a
block. A pair goes to the range of its history, so that the range has all that
the history's weight needs but the unigram of the following words, which is
asked for once per range and word. The model stays packed, one row per range;
values are made where they are looked up.

A hash range holds a bounded share because the number of ranges follows the
text; because pairs of frequent histories go by their own hash, and only these
histories' sums are put together over the ranges; and because what is frequent
never reaches it: at most ``HEAD`` words or pairs have a share of 1/HEAD of all
tokens, and those are looked up where the text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, release
from stemtally.llm.common import carried, whole

BLOCK = 1_000_000  # tokens packed at a time, unless one text has more
RANGE_BYTES = 4_000_000  # text per hash range
VOCABULARY = 200_000  # word hashes remembered at a time; more are hashed again
HEAD = 1 << 18
SUM_BYTES = 48_000_000  # sums of documents that a task holds before it passes them on
HOT = 1 << 13  # histories with this part of a sample's tokens, of HOT_LEAST at least, are spread; which ones changes no result
HOT_LEAST = 64
HOT_BYTES = 8_000_000  # text of that sample
WORD_RANGES = 16  # ranges of pairs to one of words
RELIABLE = 5  # counts above are not discounted


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > VOCABULARY:
            self.clear()
        x = self[word] = _signed(xxhash.xxh3_64_intdigest(word))
        return x


END, START = Hashes()[b"\n"], Hashes()[b"\n\n"]  # no word holds a line break


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key.view(np.uint64) >> np.uint64(33)) * np.uint64(ranges) >> np.uint64(31)).astype(np.int32)


def is_in(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where ``keys`` are among the sorted ``some``."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def route(h: np.ndarray, w: np.ndarray, ranges: int, hot: np.ndarray) -> np.ndarray:
    """The range of each pair: its history's, or its own where the history is hot."""
    p, some = range_of(h, ranges), is_in(h, hot)
    p[some] = range_of(pair_key(h[some], w[some]), ranges)
    return p


def blocks(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, sizes, keys) of consecutive texts; each text's tokens are its word hashes and END."""
    known, parts, keys, total = Hashes(), [], [], 0
    for pdf in batches:
        for t, d in zip(pdf["text"], pdf[key], strict=True):
            w = t.lower().split()
            parts.append(np.fromiter(map(known.__getitem__, w), np.int64, len(w)))
            keys.append(d)
            total += len(w) + 1
            if total >= BLOCK:
                yield _flat(parts, keys)
                parts, keys, total = [], [], 0
    if parts:
        yield _flat(parts, keys)


def _flat(parts: list[np.ndarray], keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) + 1 for x in parts])
    end = np.array([END])
    return np.concatenate([y for x in parts for y in (x, end)]), sizes, np.array(keys, np.int64)


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = np.empty_like(tokens)
    h[1:] = tokens[:-1]
    h[np.cumsum(sizes) - sizes] = START
    return h


def _groups(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


def _slices(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Parts of sorted keys, by hash range."""
    r = range_of(keys, ranges)
    at, n = _groups(r)
    for a, k in zip(at, n, strict=True):
        yield int(r[a]), slice(a, a + k)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, as few bytes per step as most of them need, and the rest of those that need more."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    k = next((k for k in (4, 5, 6, 7) if 24 * np.count_nonzero(step >> np.uint64(8 * k)) <= len(step)), 8)
    far = np.flatnonzero(step >> np.uint64(8 * k)) if k < 8 else np.empty(0, np.int64)
    rest = (step[far] >> np.uint64(8 * k)).astype(np.uint32) if k < 8 else far.astype(np.uint32)
    low = step.view(np.uint8).reshape(-1, 8)[:, :k]
    return b"".join([keys[:1].tobytes(), np.array([k, len(far)], np.uint32).tobytes(), far.astype(np.uint32).tobytes(), rest.tobytes(), low.tobytes()])


def unpacked_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    k, n = (int(x) for x in np.frombuffer(data, np.uint32, 2, offset=8))
    far, rest = np.frombuffer(data, np.uint32, n, offset=16), np.frombuffer(data, np.uint32, n, offset=16 + 4 * n)
    step = np.frombuffer(data, np.uint8, offset=16 + 8 * n).reshape(-1, k)
    wide = np.zeros((len(step) + 1, 8), np.uint8)
    wide[1:, :k] = step
    out = wide.view(np.uint64).ravel()
    out[0] = np.frombuffer(data, np.uint64, 1)[0]
    if n:
        out[1:][far] |= rest.astype(np.uint64) << np.uint64(8 * k)
    return np.cumsum(out, dtype=np.uint64)


def packed_ints(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as many bytes as the largest needs, lowest bytes first."""
    k = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([k]) + x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpacked_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view(np.int64).ravel()


def _all(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def hot_histories(texts: DataFrame, size: int) -> np.ndarray:
    """Frequent words of a sample, sorted, and START. Pairs are routed by it; any set gives the same model."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, _, _ in blocks(batches, "d"):
            w, n = np.unique(tokens, return_counts=True)
            yield pd.DataFrame({"w": w, "n": n})

    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(size // HOT_BYTES + 1)) == 0)
    seen = cut_lineage(part.mapInPandas(words, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "sample")
    least = max((seen.agg(F.sum("n")).first()[0] or 0) // HOT + 1, HOT_LEAST)
    w = [r.w for r in seen.filter(F.col("n") >= least).collect()]  # at most HOT words
    release(seen)
    return np.sort(np.array([START, *w], np.int64).view(np.uint64))


PIECES = "p int, h binary, runs binary, w binary, c binary, u binary, n binary"
COUNTED = "p int, h binary, runs binary, seen binary, w binary, ix binary, c binary, u binary, n binary, pairs_of array<bigint>, words_of array<bigint>, tokens bigint, words bigint"


def count(docs: DataFrame, ranges: int, min_count: int, hot: np.ndarray) -> DataFrame:
    """One row per range: histories, how many kept pairs and tokens each has, the words of those pairs and their counts, the range's words, and how many words or pairs occur how often."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, sizes, _ in blocks(batches, "d"):
            h, w = histories(tokens, sizes).view(np.uint64), tokens.view(np.uint64)
            order = np.lexsort((w, h))
            h, w = h[order], w[order]
            at, c = _groups(h, w)
            h, w = h[at], w[at]
            p = route(h, w, ranges, hot)
            order = np.argsort(p, kind="stable")  # histories ascend in each range
            p, h, w, c = p[order], h[order], w[order], c[order]
            word, times = np.unique(tokens.view(np.uint64), return_counts=True)
            out = {}
            for a, k in zip(*_groups(p), strict=True):
                s = slice(a, a + k)
                first, n = _groups(h[s])
                out[int(p[a])] = [packed_keys(h[s][first]), packed_ints(n), w[s].tobytes(), packed_ints(c[s]), b"", b""]
            for r, s in _slices(word, ranges):
                out.setdefault(r, [b""] * 6)[4:] = [packed_keys(word[s]), packed_ints(times[s])]
            yield pd.DataFrame([(r, *x) for r, x in out.items()], columns=["p", "h", "runs", "w", "c", "u", "n"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _all([np.repeat(unpacked_keys(a), unpacked_ints(n)) for a, n in zip(pdf["h"], pdf["runs"], strict=True)], np.uint64)
        w, c = np.frombuffer(b"".join(pdf["w"]), np.uint64), _all([unpacked_ints(x) for x in pdf["c"]], np.int64)
        runs = seen = np.empty(0, np.int64)
        if len(h):
            order = np.lexsort((w, h))
            h, w, c = h[order], w[order], c[order]
            at, _ = _groups(h, w)
            h, w, c = h[at], w[at], np.add.reduceat(c, at)
            at, _ = _groups(h)
            keep = c >= min_count
            h, runs, seen = h[at], np.add.reduceat(keep, at, dtype=np.int64), np.add.reduceat(c, at)
        else:
            keep = np.empty(0, bool)
        known, ix = np.unique(w[keep], return_inverse=True)
        u, k = _all([unpacked_keys(x) for x in pdf["u"]], np.uint64), _all([unpacked_ints(x) for x in pdf["n"]], np.int64)
        if len(u):
            order = np.argsort(u)
            u, k = u[order], k[order]
            at, _ = _groups(u)
            u, k = u[at], np.add.reduceat(k, at)
        row = (int(pdf["p"].iloc[0]), packed_keys(h), packed_ints(runs), packed_ints(seen), packed_keys(known), packed_ints(ix), packed_ints(c[keep]), packed_keys(u), packed_ints(k), _often(c), _often(k), int(k.sum()), len(u))
        return pd.DataFrame([row], columns=[x.split()[0] for x in COUNTED.split(", ")])

    return docs.mapInPandas(pack, PIECES).groupBy("p").applyInPandas(total, COUNTED)


def _often(c: np.ndarray) -> list[int]:
    """How many of ``c`` are 1, 2, ... RELIABLE + 1."""
    return np.bincount(np.minimum(c, RELIABLE + 2), minlength=RELIABLE + 3)[1 : RELIABLE + 2].tolist()


def discounts(often: dict[int, int], min_count: int = 1) -> dict[int, float]:
    """Katz's d(r) for r up to RELIABLE from the numbers of things seen r times; counts under ``min_count`` get 0.

    Where the numbers leave Good-Turing no discount in (0, 1 - 1/(4r)], as in
    small or much repeated corpora, a half is taken off the count.
    """
    n = lambda r: often.get(r, 0)
    top = (RELIABLE + 1) * n(RELIABLE + 1) / n(1) if n(1) else 1.0
    out = {}
    for r in range(1, RELIABLE + 1):
        d = ((r + 1) * n(r + 1) / n(r) / r - top) / (1 - top) if n(r) and top < 1 else -1.0
        out[r] = 0.0 if r < min_count else d if 0 < d <= 1 - 1 / (4 * r) else (r - 0.5) / r
    return out


def _discounted(c: np.ndarray, d: dict[int, float]) -> np.ndarray:
    return np.array([1.0, *[d[r] for r in range(1, RELIABLE + 1)], 1.0])[np.minimum(c, RELIABLE + 1)] * c


@dataclass
class Facts:
    """What all ranges share: bounded by HOT and the discounts."""

    one: dict[int, float]
    two: dict[int, float]
    total: int  # tokens, raised by one where the discounts leave nothing over
    hot: np.ndarray  # histories whose pairs are spread, sorted
    hot_total: np.ndarray | None = None
    hot_alpha: np.ndarray | None = None


def _alpha(seen: np.ndarray, mass: np.ndarray, low: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals and log10 weights of histories; 0 where no pair is kept."""
    total = np.where(mass < seen - 0.25, seen, seen + 1)
    left = np.where(pairs > 0, (1 - mass / total) / np.maximum(1 - low, 1e-12), 1.0)
    return total, np.log10(left)


class Range:
    """The model of one range from its rows and the counts it asked for."""

    def __init__(self, rows: pd.DataFrame, facts: Facts):
        of = {r.kind: r for r in rows[rows["kind"].isin(["history", "follower", "vocabulary"])].itertuples(index=False)}
        take = lambda kind, c: getattr(of[kind], c) if kind in of else b""
        self.h, self.runs, self.seen = unpacked_keys(take("history", "keys")), unpacked_ints(take("history", "runs")), unpacked_ints(take("history", "docs"))
        self.c, w, self.ix = unpacked_ints(take("history", "times")), unpacked_keys(take("follower", "keys")), unpacked_ints(take("follower", "runs"))
        self.u, self.n = unpacked_keys(take("vocabulary", "keys")), unpacked_ints(take("vocabulary", "runs"))
        counts = _all([unpacked_ints(x) for x in rows[rows["kind"] == "answer"].sort_values("block")["runs"]], np.int64)
        self.prob = _discounted(counts, facts.one) / facts.total if facts.total else np.empty(0)
        self.word_prob = _discounted(self.n, facts.one) / facts.total if facts.total else np.empty(0)
        self.at, self.w = np.repeat(np.arange(len(self.h)), self.runs), w[self.ix]
        self.mass = _discounted(self.c, facts.two)
        self.held = np.bincount(self.at, self.mass, len(self.h)), np.bincount(self.at, self.prob[self.ix], len(self.h))
        self.total, self.alpha = _alpha(self.seen, *self.held, self.runs)
        self.hot = is_in(self.h, facts.hot)
        if facts.hot_alpha is not None:
            k = np.searchsorted(facts.hot, self.h[self.hot])
            self.total[self.hot], self.alpha[self.hot] = facts.hot_total[k], facts.hot_alpha[k]
        self.facts = facts

    def gains(self) -> np.ndarray:
        return np.log10(self.mass / self.total[self.at]) - self.alpha[self.at] - np.log10(self.prob[self.ix])

    def values(self) -> np.ndarray:
        """log10 of the range's words' unigram and of their weights as histories."""
        out = np.log10(self.word_prob)
        own, hot = is_in(self.u, self.h[~self.hot]), is_in(self.u, self.facts.hot)
        own &= ~hot
        out[own] += self.alpha[np.searchsorted(self.h, self.u[own])]
        if self.facts.hot_alpha is not None:
            out[hot] += self.facts.hot_alpha[np.searchsorted(self.facts.hot, self.u[hot])]
        return out


@dataclass
class Model:
    parts: DataFrame  # (p, kind, block, keys, runs, docs, times): the packed model, a few rows per range
    facts: Facts
    few: tuple[np.ndarray, ...]  # w, c, value of words with a share of 1/HEAD
    top: tuple[np.ndarray, ...]  # key, value of such pairs
    start: float  # log10 weight of a text's start as a history
    unknown: float  # log10 of the unknown class
    tokens: int
    distinct: int
    ranges: int

    @property
    def words(self) -> DataFrame:
        """w, c, prob, value: log10 of the unigram and of the weight as a history."""
        facts = self.facts

        def table(pdf: pd.DataFrame) -> pd.DataFrame:
            m = Range(pdf, facts)
            return pd.DataFrame({"w": m.u.view(np.int64), "c": m.n, "prob": m.word_prob, "value": m.values()})

        return self.parts.groupBy("p").applyInPandas(table, "w bigint, c bigint, prob double, value double")

    @property
    def pairs(self) -> DataFrame:
        """h, w, c, value: log10 by which the pair beats its backoff."""
        facts = self.facts

        def table(pdf: pd.DataFrame) -> pd.DataFrame:
            m = Range(pdf, facts)
            return pd.DataFrame({"h": m.h[m.at].view(np.int64), "w": m.w.view(np.int64), "c": m.c, "value": m.gains()})

        return self.parts.groupBy("p").applyInPandas(table, "h bigint, w bigint, c bigint, value double")


def answers(table: DataFrame, ranges: int) -> DataFrame:
    """(p, block, runs): counts of the words that follow in range p; a range of words answers each range of pairs once."""
    coarse = ranges // WORD_RANGES + 1

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, w in zip(pdf["p"], pdf["w"], strict=True):
                w = unpacked_keys(w)
                if len(w):
                    yield pd.DataFrame([(q, p, packed_keys(w[s])) for q, s in _slices(w, coarse)], columns=["q", "p", "keys"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u, n in zip(pdf["u"], pdf["n"], strict=True):
                u, n = unpacked_keys(u), unpacked_ints(n)
                if len(u):
                    yield pd.DataFrame([(q, packed_keys(u[s]), packed_ints(n[s])) for q, s in _slices(u, coarse)], columns=["q", "u", "n"])

    def answer(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        u, n = _all([unpacked_keys(x) for x in words["u"]], np.uint64), _all([unpacked_ints(x) for x in words["n"]], np.int64)
        order = np.argsort(u)
        u, n = u[order], n[order]
        found = [packed_ints(n[np.searchsorted(u, unpacked_keys(x))]) for x in asked["keys"]]
        return pd.DataFrame({"p": asked["p"], "block": asked["q"], "runs": pd.Series(found, index=asked.index, dtype=object)})

    asked = table.select("p", "w").mapInPandas(ask, "q int, p int, keys binary")
    words = table.select("u", "n").mapInPandas(split, "q int, u binary, n binary")
    return asked.groupBy("q").cogroup(words.groupBy("q")).applyInPandas(answer, "p int, block bigint, runs binary")


def fit(docs: DataFrame, min_count: int = 1, text: str = "text") -> Model:
    """Learn from the texts of ``docs``; null texts are empty and teach their end only. No rows give an all unknown model."""
    base = docs.select(whole(text).cast("binary").alias("text"), F.lit(0).cast("bigint").alias("d"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(size // RANGE_BYTES) + 1
    hot = hot_histories(base, size)
    table = cut_lineage(count(base, ranges, min_count, hot), "counts")
    each = range(RELIABLE + 1)
    sums = table.agg(F.sum("tokens"), F.sum("words"), *[F.sum(F.get(c, F.lit(k))) for c in ("words_of", "pairs_of") for k in each]).first()
    tokens, distinct, *often = (x or 0 for x in sums)
    words_of, pairs_of = ({k + 1: often[k + a] for k in each} for a in (0, RELIABLE + 1))
    one, two = discounts(words_of), discounts(pairs_of, min_count)
    mass = tokens - sum(r * words_of[r] * (1 - one[r]) for r in one)
    total = tokens if mass < tokens - 0.25 else tokens + 1
    facts = Facts(one, two, total if tokens else 0, hot)
    asked = cut_lineage(answers(table, ranges), "answers")
    none, row = F.lit(b""), lambda kind, *c: F.struct(F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("block"), *[x.alias(n) for x, n in zip(c, ("keys", "runs", "docs", "times"), strict=True)])
    col = F.col
    parts = table.select("p", F.inline(F.array(row("history", col("h"), col("runs"), col("seen"), col("c")), row("follower", col("w"), col("ix"), none, none), row("vocabulary", col("u"), col("n"), none, none))))
    parts = parts.unionByName(asked.select("p", F.lit("answer").alias("kind"), "block", none.alias("keys"), "runs", none.alias("docs"), none.alias("times")))
    floor = max(tokens // HEAD + 1, 1)

    def head(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of hot histories, and what has a share of 1/HEAD; weights of hot histories are not known yet."""
        m = Range(pdf, facts)
        held, low = m.held
        at, p, u = np.flatnonzero(m.hot), np.flatnonzero(m.c >= floor), np.flatnonzero(m.n >= floor)
        tables = [
            {"kind": 0, "h": m.h[at], "w": m.h[at], "c": m.seen[at], "a": held[at], "b": low[at], "k": m.runs[at]},
            {"kind": 1, "h": m.h[m.at[p]], "w": m.w[p], "c": m.c[p], "a": m.gains()[p], "b": (m.alpha + np.log10(m.total))[m.at[p]], "k": 0},
            {"kind": 2, "h": m.u[u], "w": m.u[u], "c": m.n[u], "a": m.values()[u], "b": 0.0, "k": 0},
        ]
        out = pd.concat([pd.DataFrame(t) for t in tables], ignore_index=True)
        return out.assign(h=out["h"].to_numpy(np.uint64).view(np.int64), w=out["w"].to_numpy(np.uint64).view(np.int64))

    heads = cut_lineage(parts.groupBy("p").applyInPandas(head, "kind int, h bigint, w bigint, c bigint, a double, b double, k bigint"), "heads")
    spread = heads.filter("kind = 0").groupBy("h").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("k").alias("k")).toPandas()  # at most HOT + 1 rows
    rest = heads.filter("kind > 0").toPandas()  # at most 2 HEAD rows
    release(heads)
    facts.hot_total, facts.hot_alpha = np.ones(len(hot), np.int64), np.zeros(len(hot))
    k = np.searchsorted(hot, spread["h"].to_numpy(np.int64).view(np.uint64))
    facts.hot_total[k], facts.hot_alpha[k] = _alpha(*(spread[c].to_numpy() for c in ("c", "a", "b", "k")))
    h, w = (rest[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "w"))
    value, pair, late = rest["a"].to_numpy(float).copy(), rest["kind"].to_numpy() == 1, is_in(h, hot)
    k = np.searchsorted(hot, h[late])
    weight = facts.hot_alpha[k]
    value[late] += np.where(pair[late], rest["b"].to_numpy()[late] - weight - np.log10(facts.hot_total[k]), weight)
    order = np.argsort(w[~pair].view(np.int64))
    few = w[~pair].view(np.int64)[order], rest["c"].to_numpy(np.float64)[~pair][order], value[~pair][order]
    key = pair_key(h[pair], w[pair])
    order = np.argsort(key)
    start = float(facts.hot_alpha[np.searchsorted(hot, np.uint64(START % (1 << 64)))])
    return Model(parts, facts, few, (key[order], value[pair][order]), start, math.log10(1 - mass / total) if total else 0.0, tokens, distinct, ranges)


PACKED = "p int, kind string, block bigint, keys binary, runs binary, docs binary, times binary"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10).

    An empty or null text is its end alone. Rows are told apart by a 64-bit
    hash of id and text; identical rows get identical scores. Given columns of these
    names are replaced.
    """
    spark, ranges, n, v = docs.sparkSession, model.ranges, model.tokens, model.distinct
    facts = model.facts
    hot = facts.hot
    head = spark.sparkContext.broadcast((*model.few, *model.top))
    start, unknown, below = model.start, model.unknown, n + 0.5 * (v + 1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, values, pairs, gains = head.value

        def rest(keys: np.ndarray, to: np.ndarray, doc: np.ndarray, block: int, kind: str) -> Iterator[tuple]:
            order = np.lexsort((doc, keys, to))
            keys, to, doc = keys[order], to[order], doc[order]
            at, times = _groups(keys, doc)
            keys, to, doc = keys[at], to[at], doc[at]
            for a, k in zip(*_groups(to), strict=True):
                s = slice(a, a + k)
                first, runs = _groups(keys[s])
                yield int(to[a]), kind, block, packed_keys(keys[s][first]), packed_ints(runs), packed_ints(doc[s]), packed_ints(times[s])

        for tokens, sizes, ids in blocks(batches, "d"):
            block = _signed(xxhash.xxh3_64_intdigest(ids.tobytes() + tokens.tobytes()))
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.uint32), sizes)
            at = np.minimum(np.searchsorted(words, tokens), max(len(words) - 1, 0))
            hit = words[at] == tokens if len(words) else np.zeros(len(tokens), bool)
            total = start + np.bincount(doc[hit], values[at[hit]], len(ids))
            base = np.bincount(doc[hit], np.log10((counts[at[hit]] + 0.5) / below), len(ids))
            known = np.bincount(doc[hit], minlength=len(ids))
            rare = tokens[~hit].view(np.uint64)
            out = list(rest(rare, range_of(rare, ranges), doc[~hit], block, "word")) if len(rare) else []
            h = histories(tokens, sizes)
            both = pair_key(h, tokens)
            at = np.minimum(np.searchsorted(pairs, both), max(len(pairs) - 1, 0))
            hit = pairs[at] == both if len(pairs) else np.zeros(len(both), bool)
            total += np.bincount(doc[hit], gains[at[hit]], len(ids))
            if not hit.all():
                out += rest(both[~hit], route(h[~hit].view(np.uint64), tokens[~hit].view(np.uint64), ranges, hot), doc[~hit], block, "pair")
            local = np.column_stack([total, base, known.astype(np.float64), sizes.astype(np.float64)])
            p = int(range_of(np.array([block]), ranges)[0])
            out.append((p, "text", block, b"", b"", ids.tobytes(), local.tobytes()))
            yield pd.DataFrame(out, columns=["p", "kind", "block", "keys", "runs", "docs", "times"])

    found = ["block", "ids", "sums", "docs", "base", "known"]

    def look_up(parts: pd.DataFrame, sums: dict[int, np.ndarray]) -> None:
        """Add what the range's words and pairs give each document to the sums of its block."""
        m = Range(parts, facts)
        key = pair_key(m.h[m.at], m.w)
        order = np.argsort(key)
        tables = {"pair": (key[order], m.c[order], m.gains()[order]), "word": (m.u, m.n, m.values())}
        for kind, block, keys, runs, docs, times in parts.loc[parts["kind"].isin(list(tables)), ["kind", "block", "keys", "runs", "docs", "times"]].itertuples(index=False):
            keys, runs, docs, times = unpacked_keys(keys), unpacked_ints(runs), unpacked_ints(docs), unpacked_ints(times)
            have, c, value = tables[kind]
            at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
            hit = have[at] == keys if len(have) else np.zeros(len(keys), bool)
            gain = np.where(hit, value[at] if len(have) else 0.0, unknown if kind == "word" else 0.0)
            out = [np.bincount(docs, np.repeat(gain, runs) * times)]
            if kind == "word":
                seen = np.where(hit, c[at] if len(have) else 0.0, 0.0)
                out += [np.bincount(docs, np.repeat(np.log10((seen + 0.5) / below), runs) * times), np.bincount(docs, np.repeat(hit, runs) * times)]
            n, own = len(out[0]), sums.get(block)
            if own is None or own.shape[1] < n:
                wider = np.zeros((3, n))
                if own is not None:
                    wider[:, : own.shape[1]] = own
                own = sums[block] = wider
            own[: len(out), :n] += out

    def passed_on(sums: dict[int, np.ndarray]) -> pd.DataFrame:
        rows = []
        for block, own in sums.items():
            some = np.flatnonzero(own.any(axis=0))
            rows.append((block, b"", own[0, some].tobytes(), packed_ints(some), own[1, some].tobytes(), packed_ints(np.rint(own[2, some]).astype(np.int64))))
        sums.clear()
        return pd.DataFrame(rows, columns=found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = [], {}  # rows of the range that may go on in the next batch

        for pdf in batches:
            text = pdf["kind"] == "text"
            if text.any():
                t = pdf[text]
                yield pd.DataFrame({"block": t["block"], "ids": t["docs"], "sums": t["times"], "docs": b"", "base": b"", "known": b""})
            pdf = pdf[~text]
            for p, rows in pdf.groupby("p", sort=False):
                if held and held[0]["p"].iloc[0] != p:
                    look_up(pd.concat(held, ignore_index=True), sums)
                    held = []
                    if sum(x.nbytes for x in sums.values()) > SUM_BYTES:
                        yield passed_on(sums)
                held.append(rows)
        if held:
            look_up(pd.concat(held, ignore_index=True), sums)
        if sums:
            yield passed_on(sums)

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        text = parts["ids"].map(len) > 0
        named = int(text.sum())  # one for each of the equal blocks
        ids = np.frombuffer(parts.loc[text, "ids"].iloc[0], np.int64)
        total = np.zeros((4, len(ids)))
        for local in parts.loc[text, "sums"]:
            total += np.frombuffer(local, np.float64).reshape(-1, 4).T
        for sums, docs, base, known in parts.loc[~text, ["sums", "docs", "base", "known"]].itertuples(index=False):
            docs = unpacked_ints(docs)
            total[:3, docs] += [np.frombuffer(sums, np.float64), np.frombuffer(base, np.float64), unpacked_ints(known)]
        score, base, known, tokens = total / named
        return pd.DataFrame({"_d": ids, "n_tokens": np.rint(tokens).astype(np.int64), "n_known": np.rint(known).astype(np.int64), "base_score": base, "score": score})

    d = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole(text))
    packed = docs.select(whole(text).cast("binary").alias("text"), d.alias("d")).mapInPandas(pack, PACKED)
    parts = packed.unionByName(model.parts).repartition("p").sortWithinPartitions("p").mapInPandas(run, "block bigint, ids binary, sums binary, docs binary, base binary, known binary")
    each = parts.groupBy("block").applyInPandas(gather, "_d bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    # identical rows of different blocks have equal scores
    scored = each.groupBy("_d").agg(*[F.min(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    results = scored.columns[1:]
    return docs.select(carried(docs, text, *results), d.alias("_d")).join(scored, "_d").select("row.*", *results)
