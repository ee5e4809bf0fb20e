"""PII: detected entities get keyed surrogates of their type, format, gender and script, the same wherever they occur.

Mentions are found where the text is read; an entity is a type and a normal
form, so one phone number written in two ways, or a name in capitals, is one
entity. Entities are counted once, draw a surrogate from a keyed hash, and
draw again while the surrogate is taken by another entity or is itself an
entity of the corpus. Then each mention is rewritten in its own format.
"""

from __future__ import annotations

import hmac
import re
import secrets
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, release
from stemtally.llm.common import carried, small, whole
from stemtally.llm.substring import NO_ID, keyed

# Given names by gender, for Latin and Cyrillic script, and titles by gender.
GIVEN = {
    ("f", "latin"): "Mary Anna Emma Laura Julia Sarah Maria Sofia Elena Clara Alice Marie Camille Louise Chloe Hannah Lena Greta Ingrid Lucia Carmen Pilar Isabel Rosa Nora Ruth Grace Helen Linda Susan".split(),
    ("m", "latin"): "John James Peter Thomas Paul Mark David Daniel Simon Martin Louis Pierre Michel Antoine Lucas Hans Karl Felix Otto Stefan Carlos Miguel Pablo Diego Javier Robert Henry George Frank Oscar".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Юрий".split(),
}
TITLES = {"f": "Mrs Ms Miss Madame Mme Mlle Frau Señora Sra Doña".split(), "m": "Mr Monsieur Herr Señor Sr Don".split(), "": "Dr Prof".split()}
GIVEN_NAMES = {n.lower() for names in GIVEN.values() for n in names}
GENDER = {n.lower(): g for (g, _), names in GIVEN.items() for n in names} | {t.lower(): g for g, ts in TITLES.items() for t in ts}
SYLLABLES = {"latin": "ba be bo da de do fa fi ga ha ka ke la le lo ma me mi na no ra ri ro sa se ta to va vi wa".split(), "cyrillic": "ба бе во га да де зо ка ле ло ма ме ми на но ра ри ро са та".split()}
ENDINGS = {"latin": "n rd ll rt ns rk".split(), "cyrillic": "нов ров лин ский рин лов".split()}

_NAME = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
# What introduces a person, whatever the name.
_CUE = "[Nn]ame(?: is|:)|[Ss]igned(?: by|:)|[Cc]ontact(?: person)?:|[Aa]uthor:|Sincerely,|[Rr]egards,|Dear"
_TITLE = "|".join(x for ts in TITLES.values() for t in ts for x in (t, t.upper()))
# What every match of a pattern holds.
MARKS = {"email": "@", "ip": ".", "ipv6": ":", "ssn": "-"}
NUMERIC = {"iban", "ip", "ssn", "card", "phone"}
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("secret", re.compile(r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|api[_-]?key|token)\s*[=:]\s*[\"']?(?P<core>[^\s\"'<>,;]{6,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|sk-|xox[abp]-)(?P<core>[A-Za-z0-9_-]{16,})")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-]|\.\d)|(?<![\w.+-])\+\d{8,15}(?!\w)")),
    ("person", re.compile(rf"(?<!\w)(?:{_CUE})\s*(?P<first>{_NAME})[ ](?P<last>{_NAME})(?!\w)")),
    ("person", re.compile(rf"(?<!\w)(?=[A-ZÀ-ÖØ-ÞА-Я])(?:(?P<title>{_TITLE})\.?[ ](?P<rest>{_NAME}(?:[ ]{_NAME})?)|(?P<first>{_GIVEN})[ ](?P<last>{_NAME}))")),
]
# Every match of a pattern holds one of these; a text without any is not handed to Python.
PLAIN = r"[\p{N}@=:,]|AKIA|ASIA|ghp_|sk-|xox[abp]-|\p{Lu}[\p{L}\p{N}.'’-]* [\p{L}\p{N}&&[^a-zà-öø-ÿа-яё]]"


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def script(s: str) -> str:
    return "cyrillic" if re.search(r"[Ѐ-ӿ]", s) else "latin"


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, normal form, gender), in order and without overlaps; at one place the earlier pattern wins.

    The gender, of given names alone, is that of the name or else of its
    title. A single name after a title is a given name if it is a listed one.
    """
    found, taken = [], []

    def add(start: int, end: int, kind: str, norm: str, gender: str = "") -> None:
        found.append((start, end, kind, norm, gender))

    digits = re.search(r"\d", text) is not None
    for kind, pattern in PATTERNS:
        if MARKS.get(kind, "") not in text or (kind in NUMERIC and not digits):
            continue
        before = sorted(taken)
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(x < b and a < y for x, y in _near(before, a, b)):
                continue
            s = m[0]
            if kind == "email":
                add(a, b, kind, s.lower())
            elif kind == "secret":
                add(*m.span("core"), kind, m["core"])
            elif kind == "iban":
                add(a, b, kind, s.replace(" ", ""))
            elif kind == "card":
                if not luhn(_digits(s)):
                    continue
                add(a, b, kind, _digits(s))
            elif kind == "phone":
                d = _digits(s)
                if not 8 <= len(d) <= 15 or ("+" not in s and "(" not in s and len(d) < 9):
                    continue
                add(a, b, kind, d[1:] if len(d) == 11 and d[0] == "1" else d)
            elif kind == "person":
                named = m.groupdict()
                parts = [m.span("first"), m.span("last")] if named["first"] else [(m.start("rest") + w.start(), m.start("rest") + w.end()) for w in re.finditer(r"\S+", m["rest"])]
                gender = GENDER.get((named.get("title") or named["first"]).lower(), "")
                for k, (x, y) in enumerate(parts):
                    name = text[x:y].lower()
                    given = k == 0 and (len(parts) == 2 or name in GIVEN_NAMES)
                    add(x, y, f"{'given' if given else 'family'} {script(name)}", name, GENDER.get(name, gender) if given else "")
            else:
                add(a, b, kind, s.lower())
            taken.append((a, b))
    return sorted(found)


def _near(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """The spans that can overlap (a, b); spans are sorted and do not overlap each other."""
    from bisect import bisect_left

    k = bisect_left(spans, (a, a))
    return spans[max(k - 1, 0) : bisect_left(spans, (b, b), k)]


class Draws:
    """Endless keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.block, self.pool = f"{kind}|{norm}|{attempt}".encode(), 0, []
        self.key = key

    def below(self, n: int) -> int:
        if not self.pool:
            d = hmac.new(self.key, self.seed + b"|%d" % self.block, sha256).digest()
            self.pool = [int.from_bytes(d[k : k + 4], "big") for k in range(0, 32, 4)]
            self.block += 1
        return self.pool.pop() % n

    def like(self, s: str) -> str:
        """Digits for digits, letters for letters of their case; hexadecimal stays hexadecimal."""
        letters = "abcdef" if re.fullmatch(r"(?i)[0-9a-f]+", s) else "abcdefghijklmnopqrstuvwxyz"
        out = []
        for c in s:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = letters[self.below(len(letters))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, norm: str, attempt: int, gender: str = "") -> str:
    """Normal form of the surrogate, for given names of the gender where that is known.

    Where a pool is small (short names, secrets without letters, private
    addresses) later attempts draw from a wider one, so that one is free.
    """
    d = Draws(key, kind, norm, attempt)
    more = d.like("a" * max(0, attempt - 7))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")
        home = [Draws(key, "domain", domain, attempt).like(x) for x in labels[:-2]]
        return d.like(local) + more + "@" + ".".join([*home, "example", labels[-1]])
    if kind == "phone":
        rest = d.like(norm)
        return (str(2 + d.below(8)) + rest[1:]) if len(norm) == 10 else norm[:2] + rest[2:]
    if kind == "card":
        body = norm[0] + d.like(norm[1:-1])
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == "ip":
        a, b, *_ = map(int, norm.split("."))
        if a == 10 or (8 <= attempt < 16 and (a, b) == (192, 168)):
            head = [10, d.below(256)]
        elif (a, b) == (192, 168) and attempt < 8:
            head = [192, 168]
        elif a == 172 and 16 <= b < 32 and attempt < 16:
            head = [172, 16 + d.below(16)]
        else:
            head = [next(x for x in iter(lambda: 1 + d.below(223), None) if x not in (10, 127, 172, 192)), d.below(256)]
        return ".".join(map(str, [*head, d.below(256), 1 + d.below(254)]))
    if kind == "iban":
        body = d.like(norm[4:])
        code = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00"))
        return f"{norm[:2]}{98 - code % 97:02d}{body}"
    if kind == "ssn":
        area = next(x for x in iter(lambda: 1 + d.below(899), None) if x != 666)
        return f"{area:03d}-{1 + d.below(99):02d}-{1 + d.below(9999):04d}"
    if kind.startswith("given"):
        alphabet = kind.split(" ")[1]
        names = [n for (g, s), ns in GIVEN.items() if s == alphabet and gender in (g, "") for n in ns]
        more = "".join(SYLLABLES[alphabet][d.below(len(SYLLABLES[alphabet]))] for _ in range(attempt // 4))
        return names[d.below(len(names))].lower() + ("-" + more if more else "")
    if kind.startswith("family"):
        alphabet = kind.split(" ")[1]
        part = SYLLABLES[alphabet]
        return "".join(part[d.below(len(part))] for _ in range(3 + attempt // 4)) + ENDINGS[alphabet][d.below(len(ENDINGS[alphabet]))]
    return d.like(norm) + (more if kind == "secret" else "")


def render(surface: str, kind: str, norm: str, new: str) -> str:
    """``new`` in the format of the mention."""
    if kind in ("phone", "card", "iban"):
        rest = list(new)
        lead = sum(c.isalnum() for c in surface) - len(new)  # a country code that the normal form leaves out
        out = []
        for c in surface:
            if c.isalnum() and lead > 0:
                lead -= 1
                out.append(c)
            else:
                out.append(rest.pop(0) if c.isalnum() else c)
        return "".join(out)
    if kind.startswith(("given", "family")) or kind in ("email", "ipv6"):
        if surface.isupper():
            return new.upper()
        return "-".join(x[:1].upper() + x[1:] for x in new.split("-")) if surface[:1].isupper() else new
    return new


def find(docs: DataFrame) -> DataFrame:
    """(did, tkey, start, stop, kind, norm, gender) of every mention; ``docs`` has did, tkey and text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (did, tkey, *m)
                for did, tkey, t in zip(pdf["did"], pdf["tkey"], pdf["text"], strict=True)
                for m in mentions(t.decode(errors="replace"))
            ]
            yield pd.DataFrame(rows, columns=["did", "tkey", "start", "stop", "kind", "norm", "gender"])

    return docs.mapInPandas(work, "did bigint, tkey bigint, start int, stop int, kind string, norm string, gender string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, new): a surrogate for each entity (kind, norm, gender), no two alike, none an entity of the corpus.

    Given names are one kind whatever their gender, so no two of them meet.

    Each round draws for all that are left; the smallest normal form keeps a
    surrogate that several draw. What is left shrinks by the share of taken
    surrogates, so few rounds follow the first.
    """

    def drawer(attempt: int):
        @F.pandas_udf("string")
        def draw(kind: pd.Series, norm: pd.Series, gender: pd.Series) -> pd.Series:
            return pd.Series([surrogate(key, k, n, attempt, g) for k, n, g in zip(kind, norm, gender, strict=True)], dtype="object")

        return draw

    left, settled, attempt = entities, None, 0
    while attempt == 0 or not left.isEmpty():
        drawn = cut_lineage(left.select("kind", "norm", "gender", drawer(attempt)("kind", "norm", "gender").alias("new")), "drawn")
        names = entities.select("kind", F.col("norm").alias("new"))
        taken = names if settled is None else names.union(settled.select("kind", "new"))
        free = drawn.join(taken, ["kind", "new"], "left_anti")
        won = free.groupBy("kind", "new").agg(F.min("norm").alias("norm")).select("kind", "norm", "new")
        won = cut_lineage(won if settled is None else settled.select("kind", "norm", "new").union(won), "settled")
        rest = cut_lineage(drawn.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "gender"), "left")
        release(drawn, *([settled, left] if settled is not None else []))
        settled, left, attempt = won, rest, attempt + 1
    return settled


@cache
def _drawn_key(application: str) -> bytes:
    """A random secret, one for an application; it stands in no setting and so in no log."""
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The session's secret ``spark.stemtally.surrogates.key``.

    A local session without it, as in tests, uses a known one. Any other draws
    a secret for its application: surrogates agree between all texts and
    stages of a run, and only runs that share the setting have the same ones.
    """
    key = spark.conf.get("spark.stemtally.surrogates.key", None)
    if key:
        return key.encode()
    return b"for tests only" if spark.sparkContext.master.startswith("local") else _drawn_key(spark.sparkContext.applicationId)


def replace(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, and ``n_entities``, their number (0 for null, empty and clean texts, which stay as they are).

    Who has the key can draw the surrogates again and so test guesses of the
    originals; it has no default. A given column ``n_entities`` is replaced,
    no other name matters.

    Equal entities have equal surrogates in all documents, different ones
    different surrogates of their kind.
    """
    may = F.col("text").cast("string").rlike(PLAIN)
    found = cut_lineage(find(keyed(docs, doc_id, text).filter(may)), "mentions")
    entities = cut_lineage(found.groupBy("kind", "norm").agg(F.max("gender").alias("gender")), "entities")
    new = assign(entities, key)
    spans = (
        found.distinct().join(small(new), ["kind", "norm"])
        .groupBy("did", "tkey").agg(F.collect_list(F.struct("start", "stop", "kind", "norm", "new")).alias("spans"))
    )

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is None or not len(s):
                out.append(t)
                continue
            at, parts = 0, []
            for r in sorted(s, key=lambda r: r["start"]):
                parts += [t[at : r["start"]], render(t[r["start"] : r["stop"]], r["kind"], r["norm"], r["new"])]
                at = r["stop"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype="object")

    did, tkey = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)), F.xxhash64(whole(text))
    rows = docs.select(carried(docs, "n_entities"), F.col(text).alias("text"), did.alias("did"), tkey.alias("tkey"))
    may = F.coalesce(F.col("text").cast("string").rlike(PLAIN), F.lit(False))
    held = rows.filter(may).join(spans, ["did", "tkey"], "left").select("row", rewrite("text", "spans").alias("text"), F.coalesce(F.array_size("spans"), F.lit(0)).alias("n_entities"))
    both = rows.filter(~may).select("row", "text", F.lit(0).alias("n_entities")).union(held)
    return both.select(*[F.col("text").cast(docs.schema[text].dataType).alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != "n_entities"], "n_entities")
