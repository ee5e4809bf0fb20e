"""The numbered queries against plain Python over the smallest tables, and operators against planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from compare import TABLES, compare  # noqa: E402

from stemtally.llm import katz, mixing, pages, quality, queries, simhash, substring, surrogates, templates, toxicity, url_filter
from stemtally.llm.common import fold


@pytest.fixture(scope="module")
def docs(sf_dir):
    return {i: (t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()}


def rows(spark, sf_dir, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert out.startswith("ok"), out


def test_substring(spark, sf_dir, docs):
    got, first = rows(spark, sf_dir, "op4_substring"), {}
    words = {i: t.encode().split() for i, t in sorted(docs.items())}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest()), i


def test_substring_of_few_words(spark):
    """Short windows over few words: many repeats inside and between documents."""
    import random

    dice = random.Random(5)
    texts = [(i, " ".join(dice.choice("ab") for _ in range(dice.randint(0, 60)))) for i in range(60)]
    got = {r.doc_id: r.dedup for r in substring.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string"), length=8, seed=3).collect()}
    first = {}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - 7):
            first.setdefault(tuple(w[k : k + 8]), i)
    for i, t in texts:
        w = t.split()
        gone = {j for k in range(len(w) - 7) if first[tuple(w[k : k + 8])] < i for j in range(k, k + 8)}
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone), i


def test_simhash(spark, sf_dir, docs):
    def fingerprint(t):
        w = t.encode().lower().split()
        parts = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {i: fingerprint(t) for i, t in docs.items()}
    least = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and least[a] > least[b]:
                    least[a], changed = least[b], True
    got = rows(spark, sf_dir, "op6_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", least[i]) for i in fp}


def test_pigeonring_loses_no_link(spark):
    import random

    dice = random.Random(3)
    centre = [dice.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in dice.sample(range(64), dice.randint(0, 3))) for c in centre for _ in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for segments in (3, 5, 8):
        df = simhash.link(spark.createDataFrame([(0, x) for x in signed], "t int, fp bigint"), segments)
        near = defaultdict(set)
        for r in df.collect():
            near[r.u % 2**64].add(r.v % 2**64)
            near[r.v % 2**64].add(r.u % 2**64)

        def reach(step, x):
            seen, todo = {x}, [x]
            while todo:
                for y in step(todo.pop()) - seen:
                    seen.add(y)
                    todo.append(y)
            return frozenset(seen)

        assert {reach(lambda x: near[x], x) for x in fps} == {reach(lambda x: {y for y in fps if (x ^ y).bit_count() <= 2}, x) for x in fps}


def test_katz(spark, sf_dir, docs):
    got, c, pairs, tokens = rows(spark, sf_dir, "op10_katz"), Counter(), Counter(), {}
    for i, t in docs.items():
        w = tokens[i] = t.encode().lower().split() + [None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
            pairs.update(zip(["start", *w], w))
    n, v = c.total(), len(c)
    one, two = katz.discounts(Counter(c.values())), katz.discounts(Counter(pairs.values()))
    mass = sum(one.get(k, 1.0) * k for k in c.values())
    total = n if mass < n - 0.25 else n + 1
    p = {w: one.get(k, 1.0) * k / total for w, k in c.items()}
    seen, held, low = Counter(), Counter(), Counter()
    for (h, w), k in pairs.items():
        seen[h] += k
        held[h] += two.get(k, 1.0) * k
        low[h] += p[w]
    over = {h: seen[h] if held[h] < seen[h] - 0.25 else seen[h] + 1 for h in held}
    alpha = {h: (1 - held[h] / over[h]) / (1 - low[h]) for h in held}

    def prob(h, w):
        k = pairs.get((h, w), 0)
        return two.get(k, 1.0) * k / over[h] if k else alpha.get(h, 1.0) * p.get(w, 1 - mass / total)

    for h in list(seen)[:20]:
        assert abs(sum(prob(h, w) for w in c) + prob(h, "unseen") - 1) < 1e-9
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(prob(h, x)) for h, x in zip(["start", *w], w)), rel_tol=1e-7)


def test_quality(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op8_quality")
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/labels.parquet' WHERE quality = 1").fetchall()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams = {}
    for i, t in docs.items():
        w = t.encode().split()
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, a) for a, b in zip(one, w[1:])]
        grams[i] = [signed(x) % quality.BUCKETS for x in one + two]
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i, g in grams.items() if i in good for b in g)
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + quality.BUCKETS)) - math.log((raw[b] + 1) / (raw.total() + quality.BUCKETS))
    for i, t in docs.items():
        w, r = t.split(" ") and re.findall(r"[^\x20\x09-\x0D]+", t), got[i]
        times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed,
        ), i
        llr = sum(map(ratio, grams[i])) / len(grams[i]) if grams[i] else 0.0
        assert abs(r.llr - llr) < 1e-5 and r.kept == (not failed and r.llr >= quality.THRESHOLD)


def test_toxicity_on_held_out_rows(spark):
    import numpy as np

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, sf).collect()}
    held = [(got[i].score, y) for i, y in duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall() if got[i].held_out]
    s, y = np.array(held).T
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    assert ((s >= 0.5) == (y == 1)).mean() >= 0.93
    assert np.mean([a > b for a in s[y == 1] for b in s[y == 0]]) >= 0.9


def test_toxicity_does_not_move_with_the_group(spark):
    """Insults that mostly name one group: without the penalty the neutral mention of it turns toxic."""
    import random

    dice = random.Random(2)
    neutral = [f"n{k}" for k in range(300)]
    texts = []
    for i in range(600):
        bad = i % 2
        group = "muslims" if (bad and dice.random() < 0.95) or (not bad and dice.random() < 0.05) else "christians"
        texts.append((i, " ".join([*dice.sample(neutral, 12), group, *(["idiots"] if bad and dice.random() < 0.6 else [])]), bad))
    docs, labels = spark.createDataFrame([t[:2] for t in texts], "doc_id bigint, text string"), spark.createDataFrame([(i, b) for i, _, b in texts], "doc_id bigint, toxic int")
    ask = spark.createDataFrame([(1, "n1 n2 n3 n4 muslims n5 n6"), (2, "n1 n2 n3 n4 christians n5 n6"), (3, "n1 n2 muslims idiots n4")], "doc_id bigint, text string")
    a, b, c = (r.score for r in toxicity.score(ask, toxicity.fit(docs, labels)).orderBy("doc_id").collect())
    assert abs(a - b) < 0.1 and c > max(a, b) + 0.2


def test_surrogates(spark):
    texts = [
        (1, "Mail Ann.Lee@mail1.example.com or call +1 (456) 555-2186."), (2, "call 456-555-2186, not 456-555-2187; ann.lee@mail1.example.com"),
        (3, "Mr. John Smith met Mrs. Anna Smith at 42.144.35.254 with 4111 1111 1111 1111 and password=b7db7aa4a5fcc78305"), (4, "nothing here, version 2.0 of 2023-10-11"), (5, "Анна Петрова и MR. SMITH"),
    ]
    got = {r.doc_id: r.text for r in surrogates.replace(spark.createDataFrame(texts, "doc_id bigint, text string"), b"key").collect()}
    assert got[4] == texts[3][1]
    for secret in ("ann.lee", "555-2186", "smith", "john", "42.144.35.254", "4111 1111", "b7db7aa4a5fcc78305", "петрова"):
        assert secret not in " ".join(got.values()).lower(), secret
    one = re.fullmatch(r"Mail ([A-Z]\S*@\S+\.example\.com) or call \+1 \((\d{3})\) (\d{3}-\d{4})\.", got[1])
    two = re.fullmatch(r"call (\d{3})-(\d{3}-\d{4}), not (\d{3}-\d{3}-\d{4}); (\S+)", got[2])
    assert one[1].lower() == two[4] and (one[2], one[3]) == (two[1], two[2]) and two[3] != f"{two[1]}-{two[2]}"
    three = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+) at (\S+) with ((?:\d{4} ){3}\d{4}) and password=([a-f0-9]{18})", got[3])
    assert three[2] == three[4] and three[1] in surrogates.GIVEN["m", "latin"] and three[3] in surrogates.GIVEN["f", "latin"]
    assert surrogates.luhn(three[6].replace(" ", "")) and got[5].endswith("MR. " + three[2].upper()) and re.match(r"[А-Я][а-я]+ [А-Я][а-я]+ и", got[5])


def test_surrogates_stay_distinct_where_the_pool_is_full(spark):
    given = [("given latin", n.lower(), g) for g in ("f", "m") for n in surrogates.GIVEN[g, "latin"]] + [("given latin", n, "") for n in ("pat", "kim", "sasha")]
    others = [("ssn", f"123-45-{k:04d}") for k in range(300)] + [("secret", "-" * k) for k in range(6, 12)] + [("email", f"{c}@b.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    names = given + [(*x, "") for x in others]
    got = surrogates.assign(spark.createDataFrame(names, "kind string, norm string, gender string"), b"key").collect()
    assert len(got) == len(names) == len({(r.kind, r.new) for r in got}) and not {(r.kind, r.new) for r in got} & {n[:2] for n in names}


def test_surrogates_of_one_person_and_of_unlisted_names(spark):
    texts = [(1, "key sk-abcdefghijklmnopqrst here"), (2, "Mr. John spoke. John Smith left."), (3, "my name is Priya Patel ok"), (4, "Dr 李 came")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in surrogates.replace(frame, b"key").collect()}
    assert "abcdefghijklmnopqrst" not in got[1][0] and got[1][1] == 1
    one = re.fullmatch(r"Mr\. (\S+) spoke\. (\S+) (\S+) left\.", got[2][0])
    assert one[1] == one[2] and one[1] in surrogates.GIVEN["m", "latin"]
    assert "Priya" not in got[3][0] and "Patel" not in got[3][0] and got[3][0].startswith("my name is ")
    assert "李" not in got[4][0]
    other = {r.doc_id: r.text for r in surrogates.replace(frame, b"other key").collect()}
    assert other[1] != got[1][0]


def test_every_mention_passes_the_filter(spark):
    """Random texts put together from pieces of all patterns: what the patterns find is never filtered out before."""
    dice = random.Random(5)
    pieces = ["sk-", "ghp_", "AKIA", "abcdefghijklmnop", "QRSTUVWXYZ_-abcd", "Dr", "Mr.", "Frau", "John", "Анна", "李", "Smith", "ĀB", "½x", "password", "=", ":", " ", " ", "@", ".", "com", "12", "٣", "-", "name is", "Dear", "Regards,", "signed by", "\n"]
    texts = ["".join(dice.choice(pieces) for _ in range(dice.randint(2, 9))) for _ in range(6_000)]
    passed = {r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").filter(F.col("t").rlike(surrogates.PLAIN)).collect()}
    found = {t for t in texts if surrogates.mentions(t)}
    assert len(found) > 100 and found <= passed, sorted(found - passed)[:5]


def test_templates(spark):
    item = "A train leaves the old station at 9 and travels 120 km in 2 hours while Peter walks 5 km from the same station towards home"
    bench = spark.createDataFrame([(1, item), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho")], "item_id bigint, text string")
    texts = [
        (1, "before it. " + item + ". and after"), (2, "Start. " + item.replace("120", "250").replace("Peter", "Maria Lopez").replace("5 km", "7 miles")),
        (3, "unrelated words about a train that leaves the station at 9"), (4, "*** alpha*** beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (5, "alpha beta gamma delta epsilon zeta eta theta"),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {(r.did, r.item) for r in templates.leaks(docs, bench).collect()} == {(1, 1), (2, 1), (4, 2)}
    twice = spark.createDataFrame([(7, "if the box holds 3 red balls and the bag holds 3 blue balls then the sum of both is")], "item_id bigint, text string")
    same = [(1, "if the box holds 8 red balls and the bag holds 8 blue balls then the sum of both is"), (2, "if the box holds 8 red balls and the bag holds 9 blue balls then the sum of both is")]
    found = {r.did: r.n_windows for r in templates.leaks(spark.createDataFrame(same, "doc_id bigint, text string"), twice, window=17, literals=8).collect()}
    assert set(found) == {1}  # the two slots of the item hold one value


def test_templates_of_short_and_reparameterised_items(spark):
    items = [(1, "Compute 3 plus 4"), (2, "What is 15 plus 27 in total"), (3, "Tom has 5 apples and gives 2 apples to his sister"), (4, "yes"), (5, None), (6, "  ")]
    texts = [
        (1, "now Compute 3 plus 4 please"), (2, "now compute 5 plus 4 please"), (3, "What is 18 plus 31 in total"), (4, "What is 15 minus 27 in total"),
        (5, "Anna has 7 apples and gives 3 apples to his sister"), (6, "Anna has 7 apples and gives 3 pears to his sister"), (7, "he said yes."), (8, None), (9, "What is 18 plus 31 in all"),
    ]
    got = templates.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.did, r.item) for r in got} == {(1, 1), (3, 2), (5, 3), (7, 4)}


def test_templates_by_brute_force(spark):
    """Every window of every text against every window of every item, without hashes, filter or join."""
    dice, vocabulary = random.Random(8), "the old train leaves a station and travels for many hours while it rains on all of us".split()
    say = lambda n: [dice.choice([*vocabulary, str(dice.randint(1, 3)), f"{dice.randint(1, 3)} km", "Peter", "Anna"]) for _ in range(n)]
    items = [(k, " ".join(say(dice.choice((2, 4, 6, 9, 14, 22))))) for k in range(25)]
    change = lambda w: [str(dice.randint(1, 3)) if x.isdigit() and dice.random() < 0.5 else dice.choice(["Peter", "Anna", "Carl"]) if x[0].isupper() else x for x in w]
    texts = [(k, " ".join(say(dice.randint(0, 10)) + change(dice.choice(items)[1].split())[: dice.choice((99, 14, 5))] + [dice.choice(["", "."])] + say(dice.randint(0, 20)))) for k in range(150)]

    def tokens(t, names):
        lexicon, words = templates.Lexicon(), templates.split(t)
        place = lexicon.places(words)
        h, slot, at = dict(templates.readings(lexicon, place, np.arange(len(words)) == 0))[names]
        values = templates.slot_values(lexicon, place, at, slot)
        return [(int(x), values.get(k, "") if s else "") for k, (x, s) in enumerate(zip(h, slot, strict=True))]

    want = set()
    for names in (0, 1):
        read = {d: tokens(t, names) for d, t in texts}
        for i, item in items:
            x = tokens(item, names)
            n = min(13, len(x))
            if not n:
                continue
            for d, y in read.items():
                for off in range(-len(x), len(y)):
                    rows = [(a, x[a : a + n], y[off + a : off + a + n]) for a in range(len(x) - n + 1) if 0 <= off + a <= len(y) - n]
                    rows = [(a, p, q) for a, p, q in rows if [z[0] for z in p] == [z[0] for z in q]]
                    if rows:
                        windows = [(a, n, len(x) - n + 1, len(x), sum(not z[1] for z in p), [z[1] for z in p], [z[1] for z in q]) for a, p, q in rows]
                        if templates.agreeing(windows, templates.LITERALS):
                            want.add((d, i))
    got = templates.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(want) > 40 and {(r.did, r.item) for r in got} == want


def test_planted_passages_of_the_benchmark(spark, sf_dir, docs):
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall())
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    whole = {(i, k) for i, t in docs.items() for k, x in items.items() if plain(x) in plain(t)}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_templates"](spark, sf_dir).collect()}


def test_pages(spark, sf_dir):
    got = {r.page_id: r for r in queries.QUERIES["op7_pages"](spark, sf_dir).collect()}
    import html

    for i, h in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b) if "<a" in b else re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[i].text == "\n".join(b for b in blocks if b) and got[i].n_chars == len(got[i].text), i


def test_page_differencing(spark):
    body = lambda k: f"<div>Site name</div><div>story {k} begins here</div><div>Subscribe now</div><p>more of {k}</p><div>Site name</div>"
    rows = [(k, f"http://h.example/{k // 10}/{k}", body(k)) for k in range(200)] + [(900, "http://alone.example/1", body(900))]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"story {k} begins here\nmore of {k}" for k in range(200))
    assert got[900] == "Site name\nstory 900 begins here\nSubscribe now\nmore of 900\nSite name"


def test_aliases(spark):
    page = lambda k, u, h="": (k, u, h)
    rows = [
        page(1, "http://bad.example/x"), page(2, "http://a.example/1", "<link href='http://bad.example/x' rel=\"canonical\">"), page(3, "http://b.example/2#f", '<meta http-equiv="refresh" content="0; url=/3">'),
        page(4, "http://b.example/3", "<link rel=canonical href=//a.example/1>"), page(5, "http://c.example/", "<!-- <link rel=canonical href=http://a.example/1> -->"),
        page(6, "http://good.example/ok", "<link rel=canonical href=http://a.example/1>"), page(7, "http://d.example/1"), page(8, "http://e.example/1", "<link rel=canonical href=http://bad.example/z>"),
    ]
    rules = [("block", "bad.example", "/"), ("allow", "good.example", "/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.judged.verdict for r in url_filter.judge(df.filter("page_id <> 6"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 7: "allow", 8: "block"}
    got = {r.page_id: r.judged.verdict for r in url_filter.judge(df, rules, spark.createDataFrame([("http://d.example/1", "http://e.example/1")], "source string, target string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block"}


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{min(i % 10, 4)}") for i in range(20_000)], "doc_id bigint, text string, source string")
    out = mixing.mixture(docs).selectExpr("source", "mix.size * mix.copies as taken", "mix.target", "mix.source_size").groupBy("source", "target", "source_size").sum("taken").collect()
    for r in out:
        assert abs(r["sum(taken)"] - r.target) < 0.1 * r.target and r.target <= 3 * r.source_size
    assert abs(sum(r.target for r in out) - sum(r.source_size for r in out)) < 1e-6
    assert mixing.emit(mixing.mixture(docs)).count() == mixing.mixture(docs).selectExpr("sum(mix.copies)").first()[0]


def test_fold(spark):
    got = spark.createDataFrame([(k,) for k in (None, 0, 7, -3)], "doc_id bigint").select("doc_id", fold("doc_id").alias("f")).collect()
    assert [(r.f) for r in got] == [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 for r in got]


def test_pages_inside_and_around_articles(spark):
    def page(k):
        return (
            f"<body><div>Top</div><main><h1>Title {k}</h1><div>Subscribe now</div><article><header class='entry-header'><h2>Head {k}</h2></header>"
            f"<div class='side-effects'>effects {k}</div><p>sum <math><mi>x{k}</mi></math></p><div class='share'>Share this</div><div class='comments'>nice {k}</div></article></main></body>"
        )

    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(20)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nHead {k}\neffects {k}\nsum x{k}" for k in range(20)), got[3]
