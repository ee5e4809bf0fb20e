import pytest
from pyspark.sql import Row

COLUMNS = """doc_id bigint, text string, source string, start int, kind string, score double, fp bigint, copy int, n_entities int, _n int, mix string, _mix_size int,
    _did int, tkey int, component_id int, dedup int, kept int, rules int, llr int, row int, did int, id int, merkle int, leaf int, grp int, n int, lang string"""


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows and ids, columns with names that operators use inside."""
    long = " ".join(f"w{k % 7001}" for k in range(60_000))
    body = " ".join(f"b{k}" for k in range(120))
    rows = [
        (None, None, None), (None, "", "a"), (None, body, None), (1, None, "a"), (2, "", "b"), (3, " \t\n ", "b"), (4, long, "a"), (5, long, "a"),
        (6, body, "c"), (6, body, "c"), (6, "other words here", "c"), (7, "x y " + body + " z", "é"), (8, "un", None), (9, "a b Ünï\tcödé", "é"),
    ]
    return spark.createDataFrame([(*r, 1, "k", 0.5, 7, 3, 4, 2, "m", 5, 9, 8, 6, 5, 4, 3, 2, 1, 0, 1, 2, 3, 4, 5, "en") for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([Row(doc_id=k, quality=k % 2, toxic=int(k in (6, 7))) for k in range(1, 10)] + [Row(doc_id=None, quality=None, toxic=None)])
