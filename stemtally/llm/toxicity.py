"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Labelled texts that name an identity are paired with twins in which the term
is swapped for another of its kind, and every term is paired with its
neighbour on its own; the loss adds the squared difference of the two scores
of each pair. Naming a group then moves no score, whichever group the
labelled insults happened to name.

The fit is on a bounded sample of labelled rows; every text is scored whole,
where it is read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.llm.common import carried, fold, small, whole

# Identity terms; the words of a line may stand for each other.
IDENTITY_TERMS = """
women men
woman man
girls boys
muslims christians jews hindus buddhists atheists
muslim christian jewish hindu buddhist atheist
black white asian latino arab
gay straight lesbian bisexual transgender
immigrants refugees foreigners citizens
disabled blind deaf
femmes hommes
musulmans chrétiens juifs
noirs blancs arabes asiatiques
homosexuels hétérosexuels
frauen männer
muslime christen juden
schwarze weiße araber asiaten
schwule lesben heteros
mujeres hombres
musulmanes cristianos judíos
negros blancos árabes asiáticos
homosexuales heterosexuales
"""
TURN = {w: line.split() for line in IDENTITY_TERMS.strip().splitlines() for w in line.split()}
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

SAMPLE = 3_000  # labelled rows of each class at most
BUCKETS = 1 << 18
FEATURES = 4_096  # buckets that keep a weight
PENALTY = 1.0
MEMORY = 1_000_000  # words whose weight a task remembers


def buckets(word: str) -> list[int]:
    """Of the word and of its beginnings of three to six characters."""
    return sorted({xxhash.xxh32_intdigest(p) % BUCKETS for p in ["=" + word, *(word[:n] for n in range(3, 7) if len(word) >= n)]})


def bare(text: str) -> Counter:
    """Lower-cased words without the marks at their edges."""
    out: Counter = Counter()
    for raw, k in Counter(text.lower().split()).items():
        if w := raw.strip(EDGES):
            out[w] += k
    return out


def strength(times: int, words: int) -> float:
    return 2.0 * min(times, 3) / math.sqrt(max(words, 20))


def vector(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: buckets (repeated where words share one) and their strengths."""
    n, at, value = sum(counts.values()), [], []
    for w, k in counts.items():
        b = buckets(w)
        at += b
        value += [strength(k, n)] * len(b)
    return np.array(at, np.int32), np.array(value, np.float16)


def swapped(counts: Counter, turn: int) -> Counter | None:
    """The twin: each identity term becomes one of its line, ``turn`` places on; None without terms."""
    if not any(w in TURN for w in counts):
        return None
    out: Counter = Counter()
    for w, k in counts.items():
        line = TURN.get(w)
        out[line[(line.index(w) + 1 + turn % (len(line) - 1)) % len(line)] if line else w] += k
    return out


class Rows:
    """Sparse rows laid end to end, of the features that ``place`` numbers; the others are left out."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray):
        kept = [(place[at[ok]], value[ok]) for at, value in vectors for ok in [place[at] >= 0]]
        self.n = len(kept)
        self.at = np.concatenate([v[0] for v in kept])
        self.value = np.concatenate([v[1] for v in kept]).astype(np.float64)
        self.row = np.repeat(np.arange(self.n), [len(v[0]) for v in kept])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, self.n)

    def back(self, e: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, e[self.row] * self.value, size)


def choose(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Place of each bucket among those that tell the classes apart, -1 for the rest.

    A bucket is chosen if it is in three texts at least and its shares of the
    two classes lie well over two deviations apart; the strongest FEATURES.
    """
    seen = np.zeros((2, BUCKETS))
    for (at, _), label in zip(texts, y, strict=True):
        seen[int(label), np.unique(at)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    share = seen / n[:, None]
    spread = np.sqrt(((share * (1 - share) + 1e-3) / n[:, None]).sum(axis=0))
    signal = np.where(seen.sum(axis=0) >= 3, np.abs(share[1] - share[0]) / spread, 0)
    chosen = np.sort(np.argsort(-signal, kind="stable")[:FEATURES])
    chosen = chosen[signal[chosen] > 2.5]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    return place


def fit_rows(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, twins: list[tuple[int, tuple[np.ndarray, np.ndarray]]], share: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights per bucket and the bias. ``share``: the part of label 1 among all labelled rows, which the classes are weighed to."""
    y = labels.astype(np.float64)
    weights = np.zeros(BUCKETS)
    if not len(y) or not 0 < y.mean() < 1:
        p = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return weights, math.log(p / (1 - p))
    place = choose(texts, y)
    lone = [vector(Counter([w])) for w in TURN]
    after = [vector(Counter([line[(line.index(w) + 1) % len(line)]])) for w, line in TURN.items()]
    x, left, right = Rows(texts, place), Rows([texts[k] for k, _ in twins] + lone, place), Rows([v for _, v in twins] + after, place)
    size = int(place.max()) + 1
    cost = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    cost /= cost.sum()
    w, b = np.zeros(size), math.log(share / (1 - share))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x.dot(w) + b)))
        e, gap = cost * (p - y), (left.dot(w) - right.dot(w)) * (2 * PENALTY / left.n)
        g = np.append(x.back(e, size) + left.back(gap, size) - right.back(gap, size) + 3e-4 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[place >= 0] = w
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Learn ``label`` (0 or 1) from labelled rows of the folds other than 0; at most SAMPLE rows of a class, those with the smallest hashes.

    Rows with a null id or label teach nothing; no rows of one class leave a
    constant score.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    key = F.xxhash64(F.col(doc_id), whole(text)).alias("_key")
    rows = docs.filter(fold(doc_id) != 0).select(F.col(doc_id).alias("_id"), key).join(small(known), "_id").select("_key", "_y").distinct()
    count = {r._y: r.n for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [rows.filter(F.col("_y") == y).orderBy("_key").limit(SAMPLE) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * SAMPLE rows at most

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, y, t in zip(pdf["_key"], pdf["_y"], pdf["_text"], strict=True):
                counts = bare(t)
                twin = swapped(counts, k)
                one, two = vector(counts), vector(twin) if twin else (np.empty(0, np.int32), np.empty(0, np.float16))
                out.append((0, k, y, *(a.tobytes() for a in (*one, *two)), twin is not None))
            yield pd.DataFrame(out, columns=["one", "k", "y", "at", "value", "twin_at", "twin_value", "twin"])

    sample = (
        docs.select(key, whole(text).alias("_text")).join(picked, "_key").mapInPandas(prepare, "one int, k bigint, y int, at binary, value binary, twin_at binary, twin_value binary, twin boolean")
        .dropDuplicates(["k", "y"])
    )
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 0.0

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "y"])
        read = lambda at, value: (np.frombuffer(at, np.int32), np.frombuffer(value, np.float16))
        texts = [read(a, v) for a, v in zip(rows["at"], rows["value"], strict=True)]
        twins = [(n, read(a, v)) for n, (a, v, has) in enumerate(zip(rows["twin_at"], rows["twin_value"], rows["twin"], strict=True)) if has]
        weights, bias = fit_rows(texts, rows["y"].to_numpy(np.int64), twins, share)
        some = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": np.append(some, -1), "weight": np.append(weights[some], bias)})

    # one task, as the sample is bounded; FEATURES weights come back
    learned = sample.groupBy("one").applyInPandas(train, "bucket int, weight double").collect()
    weights, bias = np.zeros(BUCKETS), math.log(1e-3)
    for r in learned:
        if r.bucket < 0:
            bias = r.weight
        else:
            weights[r.bucket] = r.weight
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. Null and empty texts get the bias alone; a text is scored whole, whatever its length. A given column of the name ``out`` is replaced."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, tuple[str, float]] = {}
        for texts in batches:
            z = []
            for t in texts:
                n, heavy = 0, {}
                for raw, k in Counter(t.lower().split()).items():
                    known = memory.get(raw)
                    if known is None:
                        if len(memory) > MEMORY:
                            memory.clear()
                        w = raw.strip(EDGES)
                        known = memory[raw] = (w, float(weights.value[buckets(w)].sum()) if w else 0.0)
                    if known[0]:
                        n += k
                        if known[1]:
                            heavy[known[0]] = (heavy.get(known[0], (0, 0.0))[0] + k, known[1])
                z.append(bias + sum(strength(k, n) * w for k, w in heavy.values()))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -60, 60))))

    return docs.withColumn(out, of(whole(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    rows = docs.select(carried(docs), F.col(text).alias("text"))
    return score(rows, fit(docs, labels, doc_id, text), "text").filter(F.col("score") < threshold).select("row.*")
