"""Exact inner-product top-k by three-phase uniform thresholds.

The dimensions of a vector fall into ``lists`` stretches; the inner product
over one stretch is a row's local score in that list, and the score is the sum
of the local ones. For each query

1. every block of rows gathers the k best of each local list; the k-th best
   sum among those rows is a safe cutoff, as k rows reach it;
2. the cutoff goes back to all blocks. A row whose local scores all lie under
   cutoff / lists has a sum under the cutoff, so what reaches that uniform
   threshold in some list suffices;
3. those rows get their missing local scores, the sums that reach the cutoff
   are sent, and the k best of them are the result.

Queries and rows meet in blocks: a cell of the grid is one block of each, all
lists of a row in one cell. Only sums over the cutoff leave a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage, release

LISTS = 2
ROWS, QUERIES, TILE = 8192, 4096, 512  # rows and queries of a block, queries scored at a time
NO_ID = (1 << 63) - 1  # stands for a null id, which comes last among ties
LEAST = -(1 << 63)

BLOCK = "block bigint, n int, width int, kind string, ids binary, rids binary, x binary"


def scaled(vector: str, factor: int = 64) -> Column:
    """floor(factor * component) of each; null where the vector or a component is null or not finite."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (rid, id, v) as blocks of ``size`` at most, one row each; shorter vectors are filled up with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, TaskContext.get().partitionId() << 33

        def block(t: pa.Table) -> pa.RecordBatch:
            v = t["v"].combine_chunks()
            lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, width = v.flatten().to_numpy(zero_copy_only=False), int(lengths.max(initial=0))
            x = np.zeros((len(lengths), width), np.int64)
            x[np.arange(width) < lengths[:, None]] = flat
            kind = next(d for d in ("int8", "int16", "int32", "int64") if not x.size or (np.iinfo(d).min <= x.min() and x.max() <= np.iinfo(d).max))
            ids = t["id"].fill_null(NO_ID).to_numpy().astype(np.int64)
            one = [[number], [len(lengths)], [width], [kind], [ids.tobytes()], [t["rid"].to_numpy().astype(np.int64).tobytes()], [x.astype(kind).tobytes()]]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(one, types, strict=True)], ["block", "n", "width", "kind", "ids", "rids", "x"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= size:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, size))
                held, count, number = t.slice(size).to_batches(), count - size, number + 1
        if count:
            yield block(pa.Table.from_batches(held))

    return rows.select("rid", "id", "v").mapInArrow(pack, BLOCK)


class Block:
    def __init__(self, row: pd.Series):
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(row["n"], row["width"])
        self.ids, self.rids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rids"], np.int64)
        self.tau = np.frombuffer(row["tau"], np.int64) if "tau" in row else None


def local_lists(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Local scores (query, row) of each list, whole numbers in the narrowest type that holds all sums exactly."""
    width = min(q.shape[1], x.shape[1])
    bound = int(np.abs(q.astype(object) if q.dtype == np.int64 else q.astype(np.int64)).max(initial=0)) * int(np.abs(x.astype(object) if x.dtype == np.int64 else x.astype(np.int64)).max(initial=0)) * max(width, 1)
    if bound >= 1 << 62:
        raise OverflowError("inner products do not fit 64 bits")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    cuts = [width * j // lists for j in range(lists + 1)]
    return [q[:, a:b].astype(kind) @ x[:, a:b].astype(kind).T for a, b in zip(cuts, cuts[1:], strict=False)]


def gathered(q: Block, c: Block, k: int, lists: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, their k best sums at most, LEAST where there are fewer) among the k best rows of each local list."""
    for at in range(0, len(q.ids), TILE):
        rids = q.rids[at : at + TILE]
        local = local_lists(q.x[at : at + TILE], c.x, lists)
        own, n = rids[:, None] == c.rids, min(k + 1, len(c.ids))  # one more, as the query's own row may be among them
        best = np.sort(np.concatenate([np.argpartition(s, len(c.ids) - n, axis=1)[:, len(c.ids) - n :] for s in local], axis=1), axis=1)
        sums = np.zeros(best.shape, np.int64)
        for s in local:
            sums += np.take_along_axis(s, best, 1).astype(np.int64)
        sums[np.take_along_axis(own, best, 1)] = LEAST
        sums[:, 1:][best[:, 1:] == best[:, :-1]] = LEAST  # a row that is in two lists counts once
        yield rids, -np.sort(-np.maximum(sums, LEAST + 1), axis=1)[:, :k]


def sufficient(q: Block, c: Block, k: int, lists: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, sum) of rows that reach the uniform threshold in a list and the cutoff in sum, the best k a query at most."""
    for at in range(0, len(q.ids), TILE):
        tau = q.tau[at : at + TILE]
        local = local_lists(q.x[at : at + TILE], c.x, lists)
        limit = np.clip(-(-tau // lists), -(1 << 24), 1 << 24).astype(np.float32) if local[0].dtype == np.float32 else -(-tau // lists)
        some = np.zeros(local[0].shape, bool)
        for s in local:
            some |= s >= limit[:, None]
        some &= q.rids[at : at + TILE, None] != c.rids
        row, col = np.nonzero(some)
        total = np.zeros(len(row), np.int64)
        for s in local:
            total += s[row, col].astype(np.int64)
        keep = total >= tau[row]
        row, col, total = row[keep], col[keep], total[keep]
        order = np.lexsort((c.ids[col], -total, row))
        row, col, total = row[order], col[order], total[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        yield row[keep] + at, col[keep], total[keep]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds for, the k other rows of highest integer inner product.

    Components count as floor(64 * x). Vectors that are null or hold a null or
    non-finite component take no part. Ties go to the smaller id, null ids
    last; repeated rows are rows of their own. Of vectors of differing length
    the shorter is filled up with zeros. No queries or no rows give no result.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("bigint").alias("id"), scaled(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = cut_lineage(rows.filter(F.col("v").isNotNull()), "vectors")
    n = rows.filter("asks").count()
    asked = cut_lineage(packed(rows.filter("asks").repartition(n // QUERIES + 1), QUERIES), "queries")
    blocks = cut_lineage(packed(rows, ROWS), "blocks")
    release(rows)
    groups, shards = [r.block for r in asked.select("block").collect()], max(blocks.count(), 1)  # a number for each QUERIES queries
    stored = blocks.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(shards))).withColumn("g", F.explode(F.array(*map(F.lit, groups)).cast("array<bigint>")))  # keys of one type, as their hashes differ else
    stored = stored.groupBy("g", "s")

    def grid(side: DataFrame):
        return side.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("s", F.col("s").cast("bigint")).withColumn("g", F.col("block")).groupBy("g", "s").cogroup(stored)

    def gather(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [x for a in q.iloc for b in c.iloc for x in gathered(Block(a), Block(b), k, lists)]
        if not out:
            return pd.DataFrame({"block": [], "q": [], "sum": []})
        rids = np.concatenate([np.repeat(r, s.shape[1]) for r, s in out])
        sums = np.concatenate([s.ravel() for _, s in out])
        there = sums > LEAST + 1
        return pd.DataFrame({"block": np.full(there.sum(), q["block"].iloc[0]), "q": rids[there], "sum": sums[there]})

    place = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.desc("sum")))
    cutoffs = grid(asked).applyInPandas(gather, "block bigint, q bigint, sum bigint").withColumn("place", place).filter(F.col("place") == k)
    cutoffs = cut_lineage(cutoffs.groupBy("block").agg(F.collect_list("q").alias("qs"), F.collect_list("sum").alias("sums")), "cutoffs")  # QUERIES entries at most

    @F.pandas_udf("binary")
    def in_order(rids: pd.Series, qs: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for r, q, s in zip(rids, qs, sums, strict=True):
            known = {} if q is None else dict(zip(q, s, strict=True))
            out.append(np.array([known.get(x, LEAST + 2) for x in np.frombuffer(r, np.int64)], np.int64).tobytes())
        return pd.Series(out)

    told = asked.join(cutoffs, "block", "left").select(*asked.columns, in_order("rids", "qs", "sums").alias("tau"))

    def resolve(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [(a.ids[r], a.rids[r], b.ids[v], s) for a in map(Block, q.iloc) for b in map(Block, c.iloc) for r, v, s in sufficient(a, b, k, lists)]
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("query_id", "q", "vec_id", "score"), cols, strict=True)))

    found = grid(told).applyInPandas(resolve, "query_id bigint, q bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return best.select(real("query_id"), "rank", real("vec_id"), "score")
