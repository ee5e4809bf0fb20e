"""HTML extraction: page differencing between neighbours by URL, with the page's own structure as evidence.

A page becomes lines, one per block, each with the region it stands in. Pages
of a host, in order of their path, are neighbours; the lines of a page are
aligned with those of its nearer neighbour by longest common subsequence, and
lines on both pages are deleted unless they stand in a marked article. Lines
in navigation, headers, footers, asides, forms, notices, adverts or comments
are deleted always. Where a page marks its article, or its main part, nothing
outside is kept; in the main part around an article, and in blocks of an
article whose class only sounds like boilerplate, the comparison decides.

Only line hashes travel to the neighbours. The order is cut into runs of
bounded length that overlap by one page, so a host may hold any share of the
pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stemtally.functions.lineage import cut_lineage
from stemtally.llm.common import carried, small, whole
from stemtally.llm.url_filter import host_path

RUN = 64  # pages compared in one task group

# Element names by role.
RAW = "script style noscript template svg iframe object canvas textarea select title".split()
BLOCK = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
).split()
OUT = "nav footer aside form button menu dialog header head".split()
MAIN = "article main".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILERPLATE = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav(?:bar|igation)?|menu|"
    r"breadcrumbs?|sidebar|side|widget|footer|header|masthead|comments?|replies|respond|disqus|related|recommended|share|sharing|social|login|signup|search|pagination|pager)(?:$|[\s_-])"
)
CONTENT = re.compile(r"(?i)(?:^|[\s_-])(?:article|post|entry|story|main)[_-]?(?:body|content|text)(?:$|[\s_-])|^articleBody$")
ROLE_OUT = re.compile(r"(?i)^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar)$")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?is)\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# What a class must be, not only contain, to end a block inside a marked article.
SURE = re.compile(r"(?i)ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|cookies?|consent|gdpr|newsletter|subscribe|nav(?:bar|igation)?|menu|comments?|replies|respond|disqus|login|signup|pagination|pager")

ARTICLE, MAYBE, NEUTRAL = 2, 1, 0
DROP, DOUBT, PLAIN, WRAPPER, WHOLE = -2, -1, 0, 1, 2


def _verdict(name: str, attributes: str, inside: bool) -> int:
    """DROP: not content; DOUBT: sounds so, inside an article; WHOLE: the article; WRAPPER: what holds it; PLAIN: none of these."""
    out = DROP if name in OUT and not (name == "header" and inside) else WHOLE if name == "article" else WRAPPER if name == "main" else PLAIN
    for k, *v in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), next(filter(None, v), "")
        if k in ("class", "id") and out >= 0:
            if any(BOILERPLATE.search(c) for c in v.split()):
                sure = not inside or any(SURE.fullmatch(c) for c in v.split())
                out = out if name in MAIN or name == "body" else DROP if sure else DOUBT
            elif CONTENT.search(v):
                out = max(out, WRAPPER)
        elif k == "itemprop" and v.lower() == "articlebody":
            out = WHOLE
        elif (k == "role" and ROLE_OUT.match(v)) or (k == "aria-hidden" and v.lower() == "true") or k == "hidden":
            out = DROP
        elif k == "role" and v.lower() in ("main", "article") and out >= 0:
            out = max(out, WHOLE if v.lower() == "article" else WRAPPER)
    return out


def lines(page: str) -> list[tuple[str, int]]:
    """(text, ARTICLE, MAYBE or NEUTRAL) of every block that may be content, in page order; markup need not be closed."""
    out: list[tuple[str, int]] = []
    states, depth = [(0, 0, 0, 0)], []  # (articles, wrappers, doubts, boilerplate) around, and the names of the elements around
    words: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        whole_, wrapper, doubt, drop = states[-1]
        if text and not drop:
            out.append((text, MAYBE if doubt or (wrapper and not whole_) else ARTICLE if whole_ else NEUTRAL))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            words.append(page[at:])
            break
        words.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"(?i)</{name}\b[^>]*>").search(page, at)
                at = close.end() if close else end
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if m[1]:
            if name in depth:
                k = len(depth) - 1 - depth[::-1].index(name)
                del depth[k:], states[k + 1 :]
        elif name in BLOCK or name in ("a", "span", "button", "label"):
            if name == "body":
                del depth[:], states[1:]
            while name in BLOCK and depth and depth[-1] == "p":
                depth.pop(), states.pop()
            if not m[3].rstrip().endswith("/"):
                if name in ("a", "span", "label") and not m[3]:
                    continue
                v = _verdict(name, m[3], states[-1][0] > 0)
                a, b, c, d = states[-1]
                if v == DROP and name in ("a", "span", "label"):
                    flush()
                if name in BLOCK or name == "button" or v:
                    depth.append(name)
                    states.append((a + (v == WHOLE), b + (v == WRAPPER), c + (v == DOUBT), d + (v == DROP)))
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``.

    Bit-parallel: a row of the table is one whole number, so n lines against
    m cost n operations on m bits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, middle = len(x), len(y), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # column j adds nothing to the first i lines
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # it does so without line i already
            i -= 1
        else:
            i, j = i - 1, j - 1
            middle.append(head + i)
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _closeness(a: str, b: str) -> int:
    """Leading characters that two paths share."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, shared): places of the lines that a page has in common with its nearer neighbour; ``pages`` has key, host, path, page.

    Neighbours are the pages before and after in the order of path and key
    within the host; the nearer shares more leading characters of the path,
    the former if both do. A page alone in its host shares nothing.
    """

    @F.pandas_udf("array<bigint>")
    def hashes(page: pd.Series) -> pd.Series:
        return pd.Series([[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in lines(p)] for p in page], dtype="object")

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = cut_lineage(pages.select("key", "host", "path", hashes("page").alias("h")), "lines")  # parsed once, as ranges are sampled first
    ranged = narrow.repartitionByRange(n, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    ranged = cut_lineage(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ordered")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = ranged.join(F.broadcast(shift), "part").withColumn("place", F.col("row") + F.col("shift"))
    run, rest = F.floor(F.col("place") / RUN), F.col("place") % RUN
    runs = F.array_compact(F.array(run, F.when((rest == 0) & (run > 0), run - 1), F.when(rest == RUN - 1, run + 1)))
    spread = placed.select("key", "host", "path", "h", "place", run.alias("own"), F.explode(runs).alias("run"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place").to_dict("list")
        out = []
        for k in range(len(rows["key"])):
            if rows["own"][k] != rows["run"][k]:
                continue
            near = [j for j in (k - 1, k + 1) if 0 <= j < len(rows["key"]) and rows["host"][j] == rows["host"][k]]
            if near:
                j = max(near, key=lambda j: _closeness(rows["path"][j], rows["path"][k]))
                found = common(list(rows["h"][k]), list(rows["h"][j]))
                if found:
                    out.append((rows["key"][k], found))
        return pd.DataFrame(out, columns=["key", "shared"])

    return spread.groupBy("run").applyInPandas(compare, "key binary, shared array<int>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text``: the lines left, joined by line breaks.

    Null and empty pages have an empty text. Equal rows are one page. Pages
    without ``://`` in their url are neighbours of each other. A given column
    ``text`` is replaced, no other name matters.
    """
    host, path = host_path(F.col(url))
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(page_id).cast("string"), F.lit("-")), whole(url), whole(html))))
    base = pages.select(key.alias("key"), host.alias("host"), path.alias("path"), whole(html).alias("page"))
    shared = cut_lineage(shared_lines(base), "shared").groupBy("key").agg(F.first("shared").alias("shared"))

    @F.pandas_udf("string")
    def text(page: pd.Series, shared: pd.Series) -> pd.Series:
        out = []
        for p, gone in zip(page, shared, strict=True):
            found = lines(p)
            gone = set() if gone is None else set(gone)
            best = max((region for _, region in found), default=NEUTRAL)
            out.append("\n".join(t for k, (t, region) in enumerate(found) if region == ARTICLE or (k not in gone and (region == MAYBE or best == NEUTRAL))))
        return pd.Series(out, dtype="object")

    joined = pages.select(carried(pages, html, "text"), whole(html).alias("page"), key.alias("key")).join(small(shared), "key", "left")
    return joined.select("row.*", text("page", "shared").alias("text"))
