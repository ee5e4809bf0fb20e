"""The near-copy stage: one document of each class that links of at most two bits connect, against all pairs."""

import random

import duckdb
import pytest

from stemtally.llm import simhash


def classes(prints):
    """Members of each class, by all pairs of fingerprints."""
    least = {f: f for f in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2 and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


def expected(rows):
    fp = {i: simhash.fingerprint((t or "").encode()) & ((1 << 64) - 1) for i, t in rows}
    least = classes(set(fp.values()))
    return {min(i for i in fp if least[fp[i]] == c) for c in set(least.values())}


@pytest.mark.parametrize("given", ["table", "edited"])
def test_one_of_each_class_stays(spark, sf_dir, given):
    if given == "table":
        rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    else:
        dice, rows = random.Random(3), []
        for g in range(40):
            w = [f"{dice.getrandbits(20):x}" for _ in range(dice.randint(0, 300))]
            for _ in range(dice.randint(1, 4)):
                x = list(w)
                for _ in range(dice.randint(0, 2)):
                    if x:
                        x[dice.randrange(len(x))] = "edited"
                rows.append((len(rows), " ".join(x)))
        rows += [(len(rows), None), (len(rows) + 1, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(kept) == len({r.doc_id for r in kept}) and {r.doc_id for r in kept} == expected(rows)
    assert all(dict(rows)[r.doc_id] == r.text for r in kept)
