"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of about the same number of distinct terms stand together in blocks.
A block keeps one Bloom signature per document, sliced by bit: for each bit
position a bitmap over the rows of the block. The slices of a term's bits,
combined with AND, hold at least the rows that contain it. Terms that occur
2, 3, 5, 9 times or more are entered once more for each of these levels, so a
row's frequency of a term is bounded from above too. Per level, the weighted
sum of the bitmaps of a query's terms times what the level adds to a term's
impact is an upper bound of each row's score.

Search takes two passes over the blocks. The rows of highest bounds are scored
exactly, which gives a cutoff (score and id of the k-th); then every row whose
bound does not prove it to lie behind the cutoff is scored exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, release
from stemtally.llm.common import UPPER, LOWER, whole

LEVELS = (1, 2, 3, 5, 9)  # frequencies from which a term has a further entry
HASHES, BITS_PER_ENTRY = 3, 8
ROWS, CELLS = 2048, 1 << 23  # rows of a block at most, bits of its signatures at most unless one row has more
FILTER_BITS = 1 << 22  # of the filter that holds the queries' terms
QUERY_BYTES = 2_000_000  # text of the queries searched at a time
WORDS = 200_000  # term hashes remembered at a time; more are hashed again
SEED = 42

# every byte but ASCII letters and digits and those of wider characters is a space; A-Z become a-z
TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters from U+0080 on."""
    return text.translate(TERMS).split()


class Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        x = self[term] = xxhash.xxh64_intdigest(term, SEED)
        return x


def positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """(HASHES, terms): the bits of each term at a level, by double hashing; bits is a power of two."""
    x = (hashes + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    step = x >> np.uint64(32) | np.uint64(1)
    return np.stack([(x + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)]).astype(np.int64)


def query_filter(items: DataFrame, text: str) -> np.ndarray:
    """A bitmap of FILTER_BITS over term hashes, set for every term of the items; a term that is not in it is in no item."""
    lower = F.translate(whole(text), UPPER, LOWER)
    each = items.select(F.explode(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("t")).filter("t <> ''")
    places = each.select(F.xxhash64("t").bitwiseAND(FILTER_BITS - 1).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)  # FILTER_BITS at most
    out = np.zeros(FILTER_BITS, bool)
    out[places] = True
    return out


INDEX = "block bigint, n int, bits int, keys binary, ids binary, sizes binary, slices binary, terms array<string>, df array<bigint>"


def index(docs: DataFrame, held: np.ndarray) -> DataFrame:
    """Blocks of ``docs`` (key, id, text): keys, ids, sizes in terms and signature slices, and how many documents of a task hold each term in ``held``.

    Documents without terms are in no block.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(held, bitorder="little"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, known, df = np.unpackbits(wanted.value, bitorder="little").view(bool), Hashes(), Counter()
        groups: dict[int, list[tuple]] = {}
        number = TaskContext.get().partitionId() << 33

        def block(bits: int, rows: list[tuple]) -> pd.DataFrame:
            nonlocal number
            width = -(-len(rows) // 8)
            grid = np.zeros((bits, width * 8), bool)
            for r, (_, _, _, hashes, times) in enumerate(rows):
                for level in LEVELS:
                    some = hashes[times >= level]
                    if not len(some):
                        break
                    grid[positions(some, level, bits).ravel(), r] = True
            number += 1
            key, id_, n = (np.array(x, np.int64) for x in zip(*[x[:3] for x in rows], strict=True))
            return pd.DataFrame([(number, len(rows), bits, key.tobytes(), id_.tobytes(), n.tobytes(), np.packbits(grid, axis=1, bitorder="little").tobytes(), [], [])], columns=columns)

        def counts() -> pd.DataFrame:
            nonlocal number
            number += 1
            out = pd.DataFrame([(number, 0, 0, b"", b"", b"", b"", [t.decode() for t in df], list(df.values()))], columns=columns)
            df.clear()
            return out

        columns = ["block", "n", "bits", "keys", "ids", "sizes", "slices", "terms", "df"]
        for pdf in batches:
            for key, id_, text in zip(pdf["key"], pdf["id"], pdf["text"], strict=True):
                tf = Counter(terms(text))
                if not tf:
                    continue
                names = list(tf)
                hashes = np.fromiter(map(known.__getitem__, names), np.uint64, len(names))
                times = np.fromiter(tf.values(), np.int64, len(names))
                df.update([names[k] for k in np.flatnonzero(bitmap[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)])])
                entries = sum(int((times >= level).sum()) for level in LEVELS)
                bits = 1 << (entries * BITS_PER_ENTRY - 1).bit_length()
                rows = groups.setdefault(bits, [])
                rows.append((key, id_, int(times.sum()), hashes, times))
                if len(rows) >= max(1, min(ROWS, CELLS // bits)):
                    yield block(bits, groups.pop(bits))
            if len(df) > WORDS:
                yield counts()
        for bits, rows in groups.items():
            yield block(bits, rows)
        if df:
            yield counts()

    return docs.mapInPandas(build, INDEX)


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def m_of(n, docs: int, total: int):
    return 75 + 25 * n * docs // total


class Slices:
    """A block, and the upper bounds of its rows."""

    def __init__(self, row: pd.Series, docs: int, total: int):
        self.bits = row["bits"]
        self.rows = np.frombuffer(row["slices"], np.uint8).reshape(self.bits, -1)
        self.keys, self.ids, self.sizes = (np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "sizes"))
        m = m_of(self.sizes, docs, total)
        most = [np.minimum(x - 1, self.sizes) for x in LEVELS[1:]] + [self.sizes]  # the frequency below the next level
        at = [impact(x, m) for x in most]
        self.adds = [at[0], *[b - a for a, b in zip(at, at[1:], strict=False)]]

    def bounds(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out, held = np.zeros(len(self.keys), np.int64), None
        for level, add in zip(LEVELS, self.adds, strict=True):
            here = np.bitwise_and.reduce(self.rows[positions(hashes, level, self.bits)], axis=0)
            held = here if held is None else held & here
            some = held.any(axis=1)
            if not some.any():
                break
            present = np.unpackbits(held[some], axis=1, count=len(out), bitorder="little")
            out += (weights[some].astype(np.float64) @ present).astype(np.int64) * add  # whole numbers under 2^53
        return out


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of ``items``.

    Scores as in the module's contract: weights from document frequencies over
    all documents, frequencies damped by length. Equal scores go by ascending
    id, null ids last. Null or empty texts hold no term; repeated rows are
    documents, and queries, of their own. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(doc_id).cast("bigint"), F.lit((1 << 63) - 1))
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), whole(text))
    base = docs.select(key.alias("key"), id_.alias("id"), whole(text).cast("binary").alias("text"))
    asks = items.groupBy(F.col(item_id).alias("item_id"), whole(item_text).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    table = cut_lineage(index(base, query_filter(asks, "text")), "signatures")

    @F.pandas_udf("n bigint, total bigint")
    def counted(sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(x) // 8, int(np.frombuffer(x, np.int64).sum())) for x in sizes], columns=["n", "total"])

    n_docs, total = table.filter("n > 0").select(counted("sizes").alias("c")).agg(F.sum("c.n"), F.sum("c.total")).first()
    n_docs, total = n_docs or 0, total or 0
    frequencies = cut_lineage(table.filter("n = 0").select(F.inline(F.arrays_zip("terms", "df"))).groupBy("terms").agg(F.sum("df").alias("df")), "frequencies")
    blocks = table.filter("n > 0").drop("terms", "df", "n")
    size = asks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // QUERY_BYTES) + 1
    out = None
    for part in range(parts if n_docs else 0):
        some = asks.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else asks
        found = _search(base, blocks, frequencies, some, n_docs, total, k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "q int, item_id bigint, doc_id bigint, score bigint, rank int").select(F.col("item_id").cast(asks.schema["item_id"].dataType), "rank", "doc_id", "score")
    return out


def _search(base: DataFrame, blocks: DataFrame, frequencies: DataFrame, asks: DataFrame, n_docs: int, total: int, k: int) -> DataFrame:
    """One block of queries (QUERY_BYTES of text) over all documents."""
    spark = base.sparkSession
    asked = [(r.item_id, r.times, Counter(terms(r.text.encode()))) for r in asks.collect()]
    vocabulary = spark.createDataFrame([(t.decode(),) for t in sorted({t for *_, c in asked for t in c})], "terms string")
    df = {r.terms.encode(): r.df for r in frequencies.join(vocabulary, "terms").collect()}  # the terms of the queries in hand
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    queries = []
    for *_, c in asked:
        seen = [t for t in c if t in df]  # a term that no document holds adds nothing
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in seen), np.uint64, len(seen))
        queries.append((hashes, np.array([c[t] * weight[t] for t in seen], np.int64), seen))
    held = spark.sparkContext.broadcast(queries)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.iloc:
                block, parts = Slices(row, n_docs, total), []
                for q, (hashes, weights, _) in enumerate(held.value):
                    bound = block.bounds(hashes, weights)
                    at = np.flatnonzero(bound > 0)
                    at = at[np.lexsort((block.ids[at], -bound[at]))[:k]]
                    parts.append(pd.DataFrame({"q": np.full(len(at), q), "key": block.keys[at], "bound": bound[at], "id": block.ids[at]}))
                yield pd.concat(parts) if parts else pd.DataFrame({"q": [], "key": [], "bound": [], "id": []})

    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "id"))
    likely = blocks.mapInPandas(best, "q int, key bigint, bound bigint, id bigint").withColumn("place", first).filter(F.col("place") <= k)
    likely = cut_lineage(likely.select("q", "key"), "likely")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    scored = cut_lineage(_exact(base, likely, held, n_docs, total).withColumn("rank", rank).filter(F.col("rank") == k), "cutoffs")
    cutoffs = {r.q: (r.score, r.id) for r in scored.collect()}  # one a query in hand
    release(likely, scored)
    limits = spark.sparkContext.broadcast([cutoffs.get(q, (1, (1 << 63) - 1)) for q in range(len(queries))])

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.iloc:
                block, parts = Slices(row, n_docs, total), []
                for q, ((hashes, weights, _), (score, last)) in enumerate(zip(held.value, limits.value, strict=True)):
                    bound = block.bounds(hashes, weights)
                    at = np.flatnonzero((bound > score) | ((bound == score) & (block.ids <= last)))
                    parts.append(pd.DataFrame({"q": np.full(len(at), q), "key": block.keys[at]}))
                yield pd.concat(parts) if parts else pd.DataFrame({"q": [], "key": []})

    open_ = cut_lineage(blocks.mapInPandas(possible, "q int, key bigint"), "possible")
    best_of = _exact(base, open_, held, n_docs, total).filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k)
    named = spark.createDataFrame([(q, i, n) for q, (i, n, _) in enumerate(asked)], f"q int, item_id {asks.schema['item_id'].dataType.simpleString()}, times bigint")
    named = named.select("q", "item_id", F.explode(F.sequence(F.lit(1), "times")))  # repeated items are queries of their own
    real = F.when(F.col("id") != (1 << 63) - 1, F.col("id")).alias("doc_id")
    return best_of.join(named, "q").select("item_id", "rank", real, "score")


def _exact(base: DataFrame, pairs: DataFrame, held, n_docs: int, total: int) -> DataFrame:
    """(q, id, score) of each document and query of ``pairs`` (q, key), from the whole texts; each document is read once."""
    wanted = pairs.groupBy("key").agg(F.array_sort(F.collect_set("q")).alias("qs"))  # as many as queries in hand
    rows = base.join(wanted, "key")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, text, qs in zip(pdf["id"], pdf["text"], pdf["qs"], strict=True):
                tf = Counter(terms(text))
                m = m_of(tf.total(), n_docs, total)
                worth = {t: impact(x, m) for t, x in tf.items()}
                for q in qs:
                    _, weights, names = held.value[q]
                    out.append((q, id_, sum(int(w) * worth.get(t, 0) for t, w in zip(names, weights, strict=True))))
            yield pd.DataFrame(out, columns=["q", "id", "score"])

    return rows.select("id", "text", "qs").mapInPandas(score, "q int, id bigint, score bigint")
