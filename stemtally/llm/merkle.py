"""Merkle manifest of a dataset, upper proofs by butterfly exchange.

The rows of each group (say, a language) are leaves in order of their id. They
are cut into aligned partitions of ``fanout`` ** k leaves; a partition hashes
its own subtree. Then, round by round, aligned groups of ``fanout`` subtrees
swap roots: the partitions that stand at the same place of sibling subtrees
meet, each notes the others' roots as the next level of its proof and hashes
their common ancestor for itself. After the last round every partition holds
the group's root and its whole upper proof, so nothing is sent down again.
The roots of all groups are the leaves of a last tree, built the same way.

A round moves one row per partition. Where the last subtree is cut short, its
partitions take turns as partners of those that would face a missing one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stemtally.functions.lineage import cut_lineage, release

FANOUT = 2
LEAVES = 4096  # leaves of one partition, at most


def encoded(column: str | Column) -> Column:
    """A value so that concatenations are unambiguous: ``-`` if null, else its UTF-8 bytes, a colon, itself."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: str | Column) -> Column:
    """Lowercase hex sha256 of the encoded columns."""
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to: levels end with ``/``, each is the siblings before, a dot, the siblings after."""
    step = lambda h, level: F.sha2(F.concat(F.substring_index(level, ".", 1), h, F.substring_index(level, ".", -1)).cast("binary"), 256)
    return F.aggregate(F.filter(F.split(path, "/"), lambda x: x != ""), leaf_, step)


def siblings(path: Column) -> Column:
    """The sibling digests of a proof in order, concatenated."""
    return F.translate(path, "./", "")


def _hash(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """All levels up to one node, or ``height`` levels above the leaves."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        low = out[-1]
        out.append([_hash("".join(low[k : k + fanout])) for k in range(0, len(low), fanout)])
    return out


def _path(levels: list[list[str]], at: int, fanout: int) -> str:
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append("".join(level[first:at]) + "." + "".join(level[at + 1 : first + fanout]) + "/")
        at //= fanout
    return "".join(out)


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, ord, leaf, row, rid), written, with the place ``at`` of each in its group and the group's ``size``; by ord, leaf, rid.

    Range partitions are numbered apart and shifted by the rows before them.
    """
    order = ["grp", "ord", "leaf", "rid"]
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")), "sorted")
    here = Window.partitionBy("grp")  # a row per range partition that the group touches
    parts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    parts = parts.select(
        "grp", "part", (F.coalesce(F.sum("n").over(here.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(here).alias("size"),
    )
    parts = cut_lineage(parts, "parts")
    out = cut_lineage(dealt.join(parts, ["grp", "part"]).select("grp", "leaf", "row", (F.col("k") + F.col("shift")).alias("at"), "size"), "ranked")
    release(dealt, parts)
    return out


def swapped(parts: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: partitions (grp, p, n, h, path), h the root of the ``width`` aligned partitions around p, meet those of the sibling subtrees."""
    subtree, place = F.floor(F.col("p") / width), F.col("p") % width
    short = F.col("n") - (F.ceil(F.col("n") / width) - 1) * width  # partitions of the last subtree
    last = subtree == F.ceil(F.col("n") / width) - 1
    seats = F.when(last, F.sequence(place, F.lit(width - 1).cast("bigint"), short)).otherwise(F.array(place))
    sent = parts.filter(F.col("n") > width).select("grp", "p", "n", "h", "path", subtree.alias("s"), place.alias("place"), F.explode(seats).alias("seat"))
    own = F.col("seat") == F.col("place")
    card = F.struct("s", "h", own.alias("own"), "p", F.when(own, F.col("path")).alias("path"))
    met = sent.groupBy("grp", "n", F.floor(F.col("s") / fanout).alias("up"), "seat").agg(F.sort_array(F.collect_list(card)).alias("met"))  # fanout cards at most
    met = met.withColumn("root", F.sha2(F.concat_ws("", "met.h").cast("binary"), 256))
    each = met.select("grp", "n", "root", "met", F.explode("met").alias("me")).filter("me.own")
    level = F.concat(
        F.concat_ws("", F.filter("met", lambda x: x["s"] < F.col("me.s"))["h"]), F.lit("."),
        F.concat_ws("", F.filter("met", lambda x: x["s"] > F.col("me.s"))["h"]), F.lit("/"),
    )
    new = each.select("grp", F.col("me.p").alias("p"), "n", F.col("root").alias("h"), F.concat("me.path", level).alias("path"))
    return parts.filter(F.col("n") <= width).select("grp", "p", "n", "h", "path").union(new)


def butterfly(parts: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Partitions (grp, p, n, h, path) with h the root of their whole group and path the upper proof; n partitions a group."""
    parts = cut_lineage(parts, "round")
    most, width = parts.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        nxt = cut_lineage(swapped(parts, width, fanout), "round")
        release(parts)
        parts, width = nxt, width * fanout
    return parts


def _height(fanout: int, size: int) -> int:
    height = 0
    while fanout ** (height + 1) <= size:
        height += 1
    return height


def _grown(leaves: DataFrame, fanout: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Ranked leaves with their partition ``p``, and the partitions after the exchange."""
    height = _height(fanout, size)
    span = fanout**height
    rows = ranked(leaves).withColumn("p", F.floor(F.col("at") / span)).withColumn("n", F.ceil(F.col("size") / span))

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        root = _levels(list(pdf.sort_values("at")["leaf"]), fanout, height if n > 1 else None)[-1][0]
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "p": [int(pdf["p"].iloc[0])], "n": [n], "h": [root], "path": [""]})

    roots = rows.select("grp", "p", "n", "at", "leaf").groupBy("grp", "p").applyInPandas(subtree, "grp string, p bigint, n bigint, h string, path string")
    return rows, butterfly(roots, fanout)


def _proved(rows: DataFrame, parts: DataFrame, fanout: int, size: int) -> DataFrame:
    """(row, leaf, subroot, root, path): the rows of each partition under the proof that the partition (grp, p, n, subroot, root, path) holds."""
    height = _height(fanout, size)
    out = StructType([rows.schema["row"], rows.schema["leaf"], *[StructField(c, StringType()) for c in ("subroot", "root", "path")]])

    def finish(own: pa.Table, held: pa.Table) -> pa.Table:
        own, held = own.sort_by("at"), held.to_pylist()[0]
        levels, n = _levels(own["leaf"].to_pylist(), fanout, height if held["n"] > 1 else None), own.num_rows
        paths = [_path(levels, k, fanout) + held["path"] for k in range(n)]
        return pa.table({"row": own["row"], "leaf": own["leaf"], "subroot": [held["subroot"]] * n, "root": [held["root"]] * n, "path": paths})

    return rows.drop("n", "size").groupBy("grp", "p").cogroup(parts.groupBy("grp", "p")).applyInArrow(finish, out)


def manifest(docs: DataFrame, leaf_: Column, group: str, order: str, keep: Sequence[str] = (), fanout: int = FANOUT, size: int = LEAVES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default all) and ``merkle``: leaf, subroot of the row's group, root of all, and path, the row's proof up to the root.

    Leaves ascend by ``order`` in each group, nulls first; equal ones by leaf,
    so repeated rows are leaves of their own beside each other. Groups ascend
    likewise by their UTF-8 bytes, a null group first. A lone leaf is its own
    subroot, a lone subroot the root. A given column named ``merkle`` is
    replaced; no other name matters. No rows give no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all else
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns if c != "merkle"])
    leaves = docs.select(key.alias("grp"), F.col(order).alias("ord"), leaf_.alias("leaf"), row.alias("row"), F.monotonically_increasing_id().alias("rid"))
    leaves = cut_lineage(leaves, "leaves")
    rows, parts = _grown(leaves, fanout, size)
    release(leaves)
    tops = parts.groupBy("grp").agg(F.min("h").alias("leaf"))
    tops = tops.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), "leaf", F.struct("grp").alias("row"), F.lit(0).cast("bigint").alias("rid"))
    top_rows, top_parts = _grown(tops, fanout, size)
    crowns = _proved(top_rows, top_parts.select("grp", "p", "n", F.lit("").alias("subroot"), F.col("h").alias("root"), "path"), fanout, size)
    crowns = cut_lineage(crowns.select(F.col("row.grp").alias("grp"), "root", F.col("path").alias("crown")), "crowns")
    parts = cut_lineage(parts.join(crowns, "grp").select("grp", "p", "n", F.col("h").alias("subroot"), "root", F.concat("path", "crown").alias("path")), "parts")
    release(top_rows, top_parts, crowns)
    return _proved(rows, parts, fanout, size).select("row.*", F.struct("leaf", "subroot", "root", "path").alias("merkle"))
