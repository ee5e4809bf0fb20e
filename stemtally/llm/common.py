"""Words, folds, keys and size checks that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, written_bytes

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows of texts in one Arrow batch at most, where the session leaves Spark's default.
TEXTS_PER_BATCH = 1_000

# Bytes of a table, as Spark estimates them, that a count may be taken of and that is sent to every task at most.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of bounded memory: the default of 10,000 rows is meant for rows of a few numbers."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(TEXTS_PER_BATCH))


def whole(text: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body's lambdas read it."""
    return F.get(F.transform(F.array(value), body), 0)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def row_key(doc_id: str, text: str) -> Column:
    """128 bits of id and text: rows that share it are the same row, also where ids are null or repeated."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit("\x00"), whole(text))))


def carried(docs: DataFrame, *without: str) -> Column:
    """All columns but ``without`` as one struct ``row``: names of theirs and of an operator's own columns never meet.

    The rule of all operators: a result column replaces a given one of its name, every other column is kept.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return (F.struct(*kept) if kept else F.struct(F.lit(None).alias("none"))).alias("row")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a written table if its files are small; else leave it to a shuffled join, which AQE splits where a key is hot.

    The files' bytes, five times for what compression saved, bound what is
    sent; a frame that is no written table is written first.
    """
    df = df if hasattr(df, "_stage_path") else cut_lineage(df, "narrow")
    return F.broadcast(df) if 5 * written_bytes(df) <= limit else df


Registered = dict[str, Callable[[SparkSession, str], DataFrame]]
