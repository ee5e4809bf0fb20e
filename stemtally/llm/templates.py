"""Benchmark decontamination by template windows with consistent slots.

Numbers, names and units become typed placeholders; a document that shares a
window of template tokens with an item is a candidate, and what stands in the
slots must agree: one value of the item is one value of the document
throughout, and the other way round. So a question with other numbers or
names is found, and a text that only has the same shape is not. A capital at
the start of a sentence may be a name or not, so texts are read both ways.

Windows of items and documents meet in a hash join. Documents are read once
and never shuffled: only their windows that pass a filter of fixed size are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage
from stemtally.llm.common import carried, small, whole
from stemtally.llm.substring import NO_ID, Rolling, keyed

WINDOW, SHORT, LITERALS = 13, 5, 8
FILTER_BITS = 1 << 22  # of each of the two bitmaps over the windows of the items
BATCH_WORDS = 300_000
VOCABULARY = 400_000

# Words that are numbers, and units that may follow a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = (
    "mm cm m km meter meters metre metres kilometer kilometers inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars euro euros cent cents usd eur gbp mph kph kmh hz khz mhz ghz kb mb gb tb watt watts volt volts amp amps joule joules"
).split()
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%|°[cf]?)?")
JOINED = re.compile(r"[+-]?\d[\d.,]*(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”„«»‘’…–—¿¡"

NONE, WORD, CAPITAL, NUM, UNIT, NUM_UNIT = range(6)
SLOT = {kind: np.uint64(xxhash.xxh3_64_intdigest(f"<{kind}>")) for kind in ("num", "name", "num unit")}


def classify(raw: str) -> tuple[int, str, bool]:
    """(kind, value, ends a sentence) of a word with its marks."""
    core = raw.strip(EDGES).strip("$%+-") if not raw[:1].isdigit() else raw.strip(EDGES)
    low, ends = core.lower(), raw.rstrip("\"')]}”»*#$%&")[-1:] in ".!?:" or raw in ".!?:"
    if not core:
        return NONE, "", ends
    if NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return NUM, low.rstrip(".,"), ends
    if JOINED.fullmatch(low):
        return NUM_UNIT, low, ends
    if low in UNITS:
        return UNIT, low, ends
    return CAPITAL if core[0].isupper() and core[1:] != core[1:].upper() else WORD, low, ends


class Lexicon(dict):
    """raw word -> place of its kind, hash and sentence mark; the value of a place is kept for the slots."""

    def __init__(self):
        self.kind, self.ends = np.empty(VOCABULARY * 2, np.int8), np.empty(VOCABULARY * 2, bool)
        self.hash, self.value = np.empty(VOCABULARY * 2, np.uint64), []

    def __missing__(self, raw: str) -> int:
        k = len(self)
        if k == len(self.kind):
            for name in ("kind", "ends", "hash"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.empty_like(a)]))
        self.kind[k], value, self.ends[k] = classify(raw)
        self.hash[k] = xxhash.xxh3_64_intdigest(value)
        self.value.append(value)
        self[raw] = k
        return k

    def places(self, words: list[str]) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.clear()
            self.value.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def split(text: str) -> list[str]:
    return text.replace("\n", " . ").split()  # a line break ends a sentence


Template = tuple[np.ndarray, np.ndarray, np.ndarray]


def readings(lexicon: Lexicon, place: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Template]]:
    """(0, (hash, is a slot, index of its first word)) of the template tokens of words at ``place``; ``first`` marks where texts begin.

    Marks alone are skipped, a run of names is one slot, a number and its unit
    are one slot. A capital that begins a sentence is a word in this reading
    and a name in the second one, (1, ...); readings meet their like only.
    """
    kind, ends = lexicon.kind[place], lexicon.ends[place]
    begins = first.copy()
    begins[1:] |= ends[:-1]
    capital, number, inside = kind == CAPITAL, kind == NUM, np.zeros(len(kind), bool)
    inside[1:] = ~first[1:]
    unit = (kind == UNIT) & inside & np.append(False, number[:-1])
    with_unit = (kind == NUM_UNIT) | (number & np.append(unit[1:], False))
    plain = lexicon.hash[place]
    plain[number] = SLOT["num"]
    plain[with_unit] = SLOT["num unit"]
    slots, stay = with_unit | number, (kind != NONE) & ~unit
    for names in (0, 1):
        name = capital if names else capital & ~begins
        keep = stay.copy()
        keep[1:] &= ~(name[1:] & inside[1:] & name[:-1])
        h = plain.copy()
        h[name] = SLOT["name"]
        yield names, (h[keep], (name | slots)[keep], np.flatnonzero(keep))


class Windows(Rolling):
    """Hashes of windows of template tokens: one of the two sequences of :class:`Rolling`."""

    def load(self, hashes: np.ndarray) -> None:
        if len(self.up[0]) <= len(hashes):
            super().load(np.stack([hashes, hashes]))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[0][: len(hashes)], dtype=np.uint64)])]

    def of(self, n: int) -> np.ndarray:
        start = np.arange(len(self.sums[0]) - n)
        return self.stretch(0, start, start + n)


def slot_values(lexicon: Lexicon, place: np.ndarray, at: np.ndarray, slot: np.ndarray) -> dict[int, str]:
    """What stands in each slot: all words up to the next template token."""
    end = np.append(at[1:], len(place))
    return {int(k): " ".join(filter(None, (lexicon.value[p] for p in place[at[k] : end[k]]))) for k in np.flatnonzero(slot)}


WINDOWS = "names tinyint, n tinyint, x bigint, item bigint, ikey bigint, a int, total int, tokens int, literals tinyint, there array<string>"


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every template window of every item (item, text), read twice: words that begin a sentence as words, and as names.

    ``there`` has the slots' values, empty for literal tokens; an item of
    fewer tokens than a window is one window.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, rolling = Lexicon(), Windows()
        for pdf in batches:
            out = []
            for item, ikey, text in zip(pdf["item"], pdf["ikey"], pdf["text"], strict=True):
                words = split(text)
                if not words:
                    continue
                place = lexicon.places(words)
                for names, (h, slot, at) in readings(lexicon, place, np.arange(len(words)) == 0):
                    n = min(window, len(h))
                    if not n:
                        continue
                    rolling.load(h)
                    values, total = slot_values(lexicon, place, at, slot), len(h) - n + 1
                    for k, x in enumerate(rolling.of(n).view(np.int64)):
                        there = [values.get(j, "") for j in range(k, k + n)]
                        out.append((names, n, x, item, ikey, k, total, len(h), n - int(slot[k : k + n].sum()), there))
            yield pd.DataFrame(out, columns=["names", "n", "x", "item", "ikey", "a", "total", "tokens", "literals", "there"])

    return bench.mapInPandas(work, WINDOWS)


def window_filter(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The lengths of the items' windows, and two bitmaps of FILTER_BITS over their hashes: a window that misses one of them is no item's."""
    bit = lambda k: F.shiftrightunsigned("x", 22 * k).bitwiseAND(FILTER_BITS - 1)
    places = windows.select(F.col("n").cast("int").alias("n"), F.explode(F.array(*[bit(k) + k * FILTER_BITS for k in (0, 1)])).alias("b")).distinct().toPandas()  # at most 2 * FILTER_BITS for each length
    bits = np.zeros(2 * FILTER_BITS, bool)
    bits[places["b"].to_numpy(np.int64)] = True
    return sorted(set(places["n"].tolist())), bits


HITS = "did bigint, tkey bigint, names tinyint, n tinyint, x bigint, s int, here array<string>"


def doc_windows(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """Windows of ``docs`` (did, tkey, text) that pass the filter, with their slots' values."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def block(lexicon: Lexicon, rolling: Rolling, held: np.ndarray, rows: list[tuple[int, int, list[str]]]) -> Iterator[tuple]:
        sizes = np.array([len(w) for _, _, w in rows])
        if not sizes.sum():
            return
        place = lexicon.places([x for _, _, w in rows for x in w])
        text_of = np.repeat(np.arange(len(rows)), sizes)
        first = np.zeros(len(place), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        for names, (h, slot, at) in readings(lexicon, place, first):
            rolling.load(h)
            for n in lengths:
                if len(h) < n:
                    continue
                x = rolling.of(n)
                some = np.flatnonzero(held[x & np.uint64(FILTER_BITS - 1)])
                some = some[held[(x[some] >> np.uint64(22) & np.uint64(FILTER_BITS - 1)) + np.uint64(FILTER_BITS)]]
                for k in some[text_of[at[some]] == text_of[at[some + n - 1]]]:
                    stop = at[k + n] if k + n < len(at) else len(place)
                    values = slot_values(lexicon, place[:stop], at[k : k + n], slot[k : k + n])
                    did, tkey, _ = rows[text_of[at[k]]]
                    yield did, tkey, names, n, int(x[k].view(np.int64)), int(k), [values.get(j, "") for j in range(n)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, rolling, held = Lexicon(), Windows(), np.unpackbits(shared.value, bitorder="little").view(bool)
        for pdf in batches:
            out, rows, size = [], [], 0
            for did, tkey, text in zip(pdf["did"], pdf["tkey"], pdf["text"], strict=True):
                rows.append((did, tkey, split(text.decode(errors="replace"))))
                size += len(rows[-1][2])
                if size >= BATCH_WORDS:
                    out += block(lexicon, rolling, held, rows)
                    rows, size = [], 0
            out += block(lexicon, rolling, held, rows)
            yield pd.DataFrame(out, columns=["did", "tkey", "names", "n", "x", "s", "here"])

    return docs.mapInPandas(work, HITS)


def agreeing(windows: Sequence[tuple], literals: int) -> int:
    """Windows (a, n, total, tokens, literals, there, here) of one item in one place of one document whose slots agree.

    One value of the item is one of the document throughout, and the other way
    round. A window with few literal words counts if the values are the item's
    own, or if the whole item is there; a very short item must be there as it is.
    """
    there, back, good = {}, {}, 0
    _, _, total, tokens, *_ = windows[0]
    exact = tokens < SHORT
    whole_ = not exact and len({w[0] for w in windows}) == total
    for _, n, _, _, lit, x, y in sorted(windows, key=lambda w: w[0]):
        pairs = [(p, q) for p, q in zip(x, y, strict=True) if p or q]
        if not (whole_ or all(p == q for p, q in pairs) or (not exact and lit >= min(literals, n - 1))):
            continue
        new, old = dict(pairs), {q: p for p, q in pairs}
        if all(there.get(p, new[p]) == q == new[p] and back.get(q, old[q]) == p == old[q] for p, q in pairs):
            there |= new
            back |= old
            good += 1
    return good


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, literals: int = LITERALS,
) -> DataFrame:
    """(did, tkey, item, n_windows): documents that hold template windows of an item with consistent slots.

    Windows of documents and of items meet in a join on their hashes; a filter
    of fixed size keeps those of documents that no item has from it. Items
    shorter than a window are searched whole, those under SHORT template
    tokens as they are, empty and null ones not at all. An empty benchmark
    gives no rows. (did, tkey) name the document as in the substring operator.
    """
    bench = benchmark.select(F.col(item_id).cast("bigint").alias("item"), whole(item_text).alias("text")).filter("text <> ''").distinct()
    windows = cut_lineage(item_windows(bench.withColumn("ikey", F.xxhash64("item", "text")), window), "windows")
    lengths, bits = window_filter(windows)
    hits = cut_lineage(doc_windows(keyed(docs, doc_id, text), lengths, bits), "hits").dropDuplicates(["did", "tkey", "names", "n", "s"])
    met = hits.join(small(windows), ["names", "n", "x"]).withColumn("off", F.col("s") - F.col("a"))

    card = F.struct("a", "n", "total", "tokens", "literals", "there", "here")
    placed = met.groupBy("did", "tkey", "ikey", "names", "off").agg(F.min("item").alias("item"), F.collect_list(card).alias("windows"))  # an item's windows at most

    @F.pandas_udf("bigint")
    def good(windows: pd.Series) -> pd.Series:
        return pd.Series([agreeing([tuple(w.values()) for w in ws], literals) for ws in windows])

    each = placed.select("did", "tkey", "item", "ikey", "names", good("windows").alias("good"))
    found = each.filter("good > 0").groupBy("did", "tkey", "item", "ikey", "names").agg(F.sum("good").alias("good"))
    return found.groupBy("did", "tkey", "item").agg(F.max("good").alias("n_windows"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns are kept, whatever their names."""
    bad = leaks(docs, benchmark, doc_id, text, **options).select("did", "tkey").distinct()
    did, tkey = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)), F.xxhash64(whole(text))
    return docs.select(carried(docs), did.alias("did"), tkey.alias("tkey")).join(small(bad), ["did", "tkey"], "left_anti").select("row.*")
