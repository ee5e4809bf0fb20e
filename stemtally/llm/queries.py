"""The numbered queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.llm.common import Registered, fold, table, text_batches

QUERIES: Registered = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows of the folds other than 0."""
    from stemtally.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    from stemtally.llm.surrogates import replace, session_key

    return replace(table(spark, sf_dir, "documents"), session_key(spark))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address under the five rules, and under those of its aliases."""
    from stemtally.llm.url_filter import judge

    out = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return out.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


# The rules alone: no given page has a canonical link or a refresh, so there are no aliases; those are tested by brute force.
ORACLES["op3_url_filter"] = r"""
WITH p AS (SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


@query
def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier document has."""
    from stemtally.llm.substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


@query
def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    from stemtally.llm.templates import leaks

    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("did").alias("doc_id"), F.col("item").alias("item_id"), "n_windows")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    from stemtally.llm.simhash import near_classes

    out = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from stemtally.llm.pages import main_text

    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the log-likelihood verdict of every document; labelled good documents are the target."""
    from stemtally.llm.quality import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
    return out.select("doc_id", "rules.*", "kept", "llr")


@query
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a model of those of the other folds."""
    from stemtally.llm import katz

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = katz.fit(docs.filter(fold("doc_id") != 1))
    out = katz.score(docs, model)
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    from stemtally.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS total FROM t),
m AS (SELECT doc_id, 100 - 25 + ((25 * count(*) * any_value(g.docs)) // any_value(g.total)) AS m FROM t, g GROUP BY doc_id),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


@query
def op12_inner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest integer inner product with each query vector."""
    from stemtally.llm.inner_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLES["op12_inner_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, each proof folded again from the leaf as tampered with."""
    from stemtally.llm import merkle

    docs = table(spark, sf_dir, "documents")
    first = ("doc_id", "source", "lang")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", "lang", merkle.leaf(*first, "n_chars", "text").alias("leaf"), F.when(hit, merkle.leaf(*first, F.col("n_chars") + 1, "text")).alias("tampered"))
    out = merkle.manifest(rows, F.col("leaf"), "lang", "doc_id", keep=["doc_id", "tampered"])
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "merkle.leaf"), F.col("merkle.path")))
    proof = F.sha2(merkle.siblings(F.col("merkle.path")).cast("binary"), 256)
    return out.select("doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("merkle.root")).alias("verified"))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# Levels as lists, halved by recursion; crc32 bit by bit.
ORACLES["op13_merkle"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS other,
        xor(list_reduce(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
            lambda c, b: list_reduce(range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
    FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up(lang, k, h) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM r GROUP BY lang
    UNION ALL SELECT lang, k + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM up WHERE len(h) > 1),
subs AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM up WHERE len(h) = 1),
top(k, h) AS (SELECT 0, list(subroot ORDER BY pos) FROM subs
    UNION ALL SELECT k + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM top WHERE len(h) > 1),
levels AS (SELECT lang, k, h FROM up WHERE len(h) > 1 UNION ALL SELECT lang, 1000 + k, h FROM subs, top WHERE len(h) > 1),
steps AS (SELECT r.doc_id, r.lang, r.pos, list(CASE WHEN p % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(h[CAST(xor(p, 1) + 1 AS BIGINT)], '') ORDER BY l.k) AS path
    FROM r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang JOIN levels l ON l.lang IS NOT DISTINCT FROM r.lang,
    LATERAL (SELECT CASE WHEN l.k < 1000 THEN r.pos >> CAST(l.k AS BIGINT) ELSE s.pos >> CAST(l.k - 1000 AS BIGINT) END AS p) GROUP BY ALL),
f AS (SELECT r.doc_id, r.leaf, s.subroot, (SELECT h[1] FROM top WHERE len(h) = 1) AS root, coalesce(path, []) AS path, CASE WHEN r.crc % 7 = 0 THEN other ELSE r.leaf END AS start
    FROM r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang
    LEFT JOIN steps t ON t.pos = r.pos AND t.lang IS NOT DISTINCT FROM r.lang),
g AS (SELECT *, list_reduce(path, lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END), start) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by weights 5, 2, 1."""
    from stemtally.llm.mixing import mixture

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixture(docs)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLES["op9_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / CAST(weight AS DOUBLE) AS ratio,
        coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
        coalesce(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_weight,
        sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT arg_min(CAST(total - before_cap AS DOUBLE) / CAST(all_weight - before_weight AS DOUBLE), ratio) AS level FROM o
      WHERE CAST(total - before_cap AS DOUBLE) / CAST(all_weight - before_weight AS DOUBLE) <= ratio),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1 END AS rate,
        CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.text), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
