"""Least squares over the tree with full covariance matrices, one solve per signature.

Covariances depend on which queries were measured with which variances and on
which cells are held at zero, never on the noise. Nodes whose subtrees agree in
that share a signature; matrices are kept per signature, only vectors per node.
In the worst case every node has its own signature and this becomes one solve
per node.

Node tables: (geocode, sig, vector ...). Matrix tables: one row per signature,
symmetric matrices packed as upper triangle; a NULL covariance means no
information.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtally.functions.grouped import apply_by_signature, map_frames, stack, sum_arrays, sum_vectors, times_own
from stemtally.functions.keys import Spine, prefix
from stemtally.functions.lineage import cut_lineage, meet
from stemtally.functions.matrices import pack, pack_many, spd_inverse, spd_inverses, unpack, unpack_many
from stemtally.operators.gls_diagonal import SOFT_VARIANCE

Cut = Callable[[DataFrame, str], DataFrame]
NO_OWN = "none"
INF = float("inf")
SOLVE_CELLS = 1 << 21  # cells of all matrices that a task inverts at once


def _some(x) -> bool:
    return x is not None and not (isinstance(x, float) and np.isnan(x))


# ---- own estimates ------------------------------------------------------------------------


def own_signatures(measurements: DataFrame, masked: DataFrame | None, share: bool = True) -> DataFrame:
    """(depth, geocode, own_sig) from the measured queries, their variances and the masked cells."""
    tag = F.concat_ws(":", "query_name", F.col("variance").cast("string"))
    head = measurements.groupBy("depth", "geocode").agg(
        F.array_join(F.array_sort(F.collect_set(tag)), ";").alias("q"),
        F.coalesce(F.bool_or((F.col("query_name") == "detailed") & (F.col("variance") == INF)), F.lit(False)).alias("off"),
    )
    if masked is None:
        head = head.withColumn("m", F.lit(""))
    else:
        m = masked.groupBy("geocode").agg(F.array_join(F.array_sort(F.collect_set("cell")), ",").alias("m"))
        head = head.join(m, "geocode", "left")
    parts = [F.col("q"), F.coalesce("m", F.lit(""))] + ([] if share else [F.col("geocode")])
    sig = F.when(F.col("off"), F.lit(NO_OWN)).otherwise(F.sha2(F.concat_ws("|", *parts), 256))
    return head.select("depth", "geocode", sig.alias("own_sig"))


def own_rhs(measurements: DataFrame, design: DataFrame, n: int) -> DataFrame:
    """(geocode, rhs): design-weighted answers, one array of n per node; arrays meet the design as they are, never a row per cell.

    ``design``: (query_name, row_ix, cell, coef, mult); ``mult`` scales the
    variance of single rows (1 unless the rows were summed).
    """
    finite = measurements.filter((F.col("variance") < INF) & F.col("value").isNotNull()).select(
        "geocode", "query_name", "variance", F.transform("value", lambda y: F.coalesce(y, F.lit(0.0))).alias("value")
    )

    def weigh(rows: pd.DataFrame, m: dict) -> pd.DataFrame:
        x = np.zeros((len(rows), n))
        if m:
            order = np.argsort(m["cell"], kind="stable")
            row, cell, w = (np.asarray(v)[order] for v in (m["row_ix"], m["cell"], np.asarray(m["coef"]) / np.asarray(m["mult"])))
            lengths = rows["value"].map(len).to_numpy()
            for k in np.unique(lengths):
                at, use = np.flatnonzero(lengths == k), row < k
                if use.any():
                    own = cell[use]
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    x[np.ix_(at, own[starts])] = np.add.reduceat(stack(rows["value"].iloc[at])[:, row[use]] * w[use], starts, axis=1)
        return pd.DataFrame({"geocode": rows["geocode"], "rhs": list(x / rows["variance"].to_numpy()[:, None])})

    each = apply_by_signature(finite, packed_design(design), "query_name", weigh, "geocode string, rhs array<double>", row_bytes=24 * n, stored=True)
    return sum_arrays(each, ["geocode"], ["rhs"], combine=False)  # a unit has one row per query, each in a bucket of its own


def packed_design(design: DataFrame) -> DataFrame:
    """One row per query; bounded by the catalog, not by the data."""
    return design.groupBy("query_name").agg(F.collect_list(F.struct("row_ix", "cell", "coef", "mult")).alias("d")).select(
        "query_name", "d.row_ix", "d.cell", "d.coef", "d.mult"
    )


def own_precision(nodes: DataFrame, measurements: DataFrame, design: DataFrame, masked: DataFrame | None, n: int) -> DataFrame:
    """(own_sig, p): packed precision S'S of each distinct own signature."""
    reps = nodes.filter(F.col("own_sig") != NO_OWN).groupBy("own_sig").agg(F.min("geocode").alias("geocode"))
    packed = packed_design(design)
    rows = reps.join(measurements.filter(F.col("variance") < INF).select("geocode", "query_name", "variance"), "geocode").join(
        packed, "query_name"
    ).select("own_sig", "query_name", "variance", "row_ix", "cell", "coef", "mult")
    if masked is not None:
        soft = reps.join(masked.select("geocode", "cell").distinct(), "geocode").select(
            "own_sig", F.lit(None).cast("string").alias("query_name"), F.lit(SOFT_VARIANCE).alias("variance"), F.array(F.lit(0)).alias("row_ix"),
            F.array("cell").alias("cell"), F.array(F.lit(1.0)).alias("coef"), F.array(F.lit(1.0)).alias("mult"),
        )
        rows = rows.unionByName(soft)

    def unit(r) -> np.ndarray:
        """S'S of a query of unit variance."""
        ix = np.asarray(r.row_ix, dtype=int)
        a = np.zeros((ix.max() + 1, n))
        a[ix, np.asarray(r.cell, dtype=int)] = np.asarray(r.coef) / np.sqrt(np.asarray(r.mult))
        return a.T @ a

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sig, p, units, out = None, None, {}, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):  # the rows of a signature follow one another
                if r.own_sig != sig:
                    if sig is not None:
                        out.append((sig, pack(p)))
                    sig, p = r.own_sig, np.zeros((n, n))
                if not isinstance(r.query_name, str):
                    p[r.cell[0], r.cell[0]] += 1 / r.variance
                else:
                    if r.query_name not in units:
                        units[r.query_name] = unit(r)
                    p += units[r.query_name] / r.variance
                if len(out) * n * n > SOLVE_CELLS:
                    yield pd.DataFrame(out, columns=["own_sig", "p"])
                    out = []
        if sig is not None:
            out.append((sig, pack(p)))
        if out:
            yield pd.DataFrame(out, columns=["own_sig", "p"])

    return rows.repartition("own_sig").sortWithinPartitions("own_sig").mapInPandas(gram, "own_sig string, p array<double>")


# ---- signatures of subtrees ----------------------------------------------------------------


def _multiset(counts: DataFrame) -> DataFrame:
    """Order-free fingerprint of the child signatures per parent; combined map-side, nothing is listed."""
    h = [F.xxhash64("child_sig", F.lit(s)).cast("decimal(20,0)") for s in (1, 2)]
    k = F.col("cnt").cast("decimal(12,0)")
    return counts.groupBy("parent").agg(
        F.sum("cnt").alias("num_siblings"),
        F.count(F.lit(1)).alias("kinds"),
        F.sum((h[0] * k).cast("decimal(38,0)")).alias("s1"),
        F.sum((h[1] * k).cast("decimal(38,0)")).alias("s2"),
    )


class DensePasses:
    """Both passes over ``nodes`` (depth, geocode, own_sig, rhs) and ``precision`` (own_sig, p)."""

    def __init__(self, spine: Spine, n: int, nodes: DataFrame, precision: DataFrame, cut: Cut = cut_lineage):
        self._prepare(spine, n, cut)
        own = [nodes.filter(F.col("depth") == k).drop("depth") for k in range(spine.depth + 1)]
        self._build_leaves(own[spine.depth], precision)
        for k in range(spine.depth - 1, -1, -1):
            self._build_level(k, own[k], precision)

    @classmethod
    def blank(cls, spine: Spine, n: int, cut: Cut = cut_lineage) -> DensePasses:
        """Passes without tables, for those that have them stored."""
        out = cls.__new__(cls)
        out._prepare(spine, n, cut)
        return out

    def _prepare(self, spine: Spine, n: int, cut: Cut) -> None:
        self.spine, self.n, self.cut = spine, n, cut
        d = spine.depth
        self.nodes: list = [None] * (d + 1)  # geocode, sig, up (vector given the subtree)
        self.mats: list = [None] * (d + 1)  # sig, c (given the subtree), j, f, free, kinds, num_siblings
        self.sums: list = [None] * (d + 1)  # parent, known (sum of informed children), over children of level k
        self.down: list = [None] * (d + 1)  # geocode, dsig, estimate
        self.down_mats: list = [None] * (d + 1)  # dsig, sig, ct
        self.pairs: list = [None] * (d + 1)  # dsig, parent_dsig, sig, parent_sig

    # -- upwards --

    def _build_leaves(self, nodes: DataFrame, precision: DataFrame) -> None:
        d = self.spine.depth
        sigs = nodes.select("own_sig").distinct().join(precision, "own_sig", "left").select(
            F.col("own_sig").alias("sig"), "p",
            F.lit(None).cast("array<double>").alias("f"), F.lit(0).cast("bigint").alias("free"),
            F.lit(0).cast("bigint").alias("num_siblings"), F.lit(0).cast("bigint").alias("kinds"),
        )
        self.mats[d] = self.cut(self._solve_up(sigs), f"mats_{d}")
        self._finish_up(d, nodes.withColumnRenamed("own_sig", "sig").withColumn("known", F.lit(None).cast("array<double>")), True)

    def _build_level(self, k: int, nodes: DataFrame, precision: DataFrame) -> None:
        w, leaf = self.spine.widths[k], k + 1 == self.spine.depth
        counts = self.nodes[k + 1].groupBy(prefix("geocode", w).alias("parent"), F.col("sig").alias("child_sig")).agg(
            F.count(F.lit(1)).alias("cnt")
        )
        if leaf:  # an only leaf repeats its parent and adds nothing
            lone = counts.groupBy("parent").agg(F.sum("cnt").alias("t")).filter("t = 1").select("parent", F.lit(True).alias("lone"))
            counts = counts.join(lone, "parent", "left").withColumn(
                "child_sig", F.when(F.col("lone"), F.lit(NO_OWN)).otherwise(F.col("child_sig"))
            ).drop("lone")
        counts = self.cut(counts, f"child_kinds_{k}")
        own = nodes.join(_multiset(counts).withColumnRenamed("parent", "geocode"), "geocode", "left")
        sig = F.sha2(F.concat_ws("|", "own_sig", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("num_siblings", "s1", "s2")]), 256)
        own = self.cut(own.select("geocode", "own_sig", "rhs", "num_siblings", "kinds", sig.alias("sig")), f"own_{k}")
        # what is known of the children, per distinct signature, from one representative parent
        reps = own.groupBy("sig").agg(F.min(F.struct("geocode", "own_sig", "num_siblings", "kinds")).alias("r")).select("sig", "r.*")
        child = reps.select("sig", "kinds", F.col("geocode").alias("parent")).join(counts, "parent").join(
            self.mats[k + 1].select(F.col("sig").alias("child_sig"), "c"), "child_sig", "left"
        )
        totals = child.groupBy("sig").agg(
            F.coalesce(F.sum(F.when(F.col("c").isNull(), F.col("cnt"))), F.lit(0)).alias("free")
        )
        weighted = child.filter("c is not null").select("sig", "kinds", "child_sig", F.transform("c", lambda x: x * F.col("cnt")).alias("f"))
        salt = F.pmod(F.xxhash64("child_sig"), F.ceil(F.coalesce("kinds", F.lit(1)) / 64))  # 64 kinds of children per task
        f = sum_arrays(weighted, ["sig"], ["f"], salt)
        solved = reps.select("sig", "own_sig", "num_siblings", "kinds").join(precision, "own_sig", "left").join(
            totals.select("sig", "free"), "sig", "left"
        ).join(f, "sig", "left").select(
            "sig", "p", "f", F.coalesce("free", F.lit(0)).cast("bigint").alias("free"),
            F.coalesce("num_siblings", F.lit(0)).cast("bigint").alias("num_siblings"),
            F.coalesce("kinds", F.lit(0)).cast("bigint").alias("kinds"),
        )
        self.mats[k] = self.cut(self._solve_up(solved), f"mats_{k}")
        kids = self.nodes[k + 1].select(prefix("geocode", w).alias("parent"), "up", "geocode")
        if leaf:
            kids = kids.join(lone.select("parent"), "parent", "left_anti")
        self.sums[k] = self.cut(sum_vectors(kids.select("parent", F.col("up").alias("known")), ["parent"], "known"), f"sums_{k}")
        with_sum = own.select("geocode", "sig", "rhs").join(self.sums[k].withColumnRenamed("parent", "geocode"), "geocode", "left")
        self._finish_up(k, with_sum)

    def _solve_up(self, sigs: DataFrame) -> DataFrame:
        """Rows (sig, p, f, free, ...) -> (sig, c, j, f, free, num_siblings, kinds)."""
        n = self.n
        step = max(1, SOLVE_CELLS // (n * n))

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for a in range(0, len(whole), step):
                    pdf = whole.iloc[a : a + step]
                    inner = np.array([free == 0 and _some(f) for f, free in zip(pdf["f"], pdf["free"], strict=True)], dtype=bool)
                    own = np.array([_some(p) for p in pdf["p"]], dtype=bool)
                    info, known = np.zeros((len(pdf), n, n)), inner | own
                    j, c = [None] * len(pdf), [None] * len(pdf)
                    if own.any():
                        info[own] = unpack_many(stack(pdf["p"][own]))
                    if inner.any():
                        inv = spd_inverses(unpack_many(stack(pdf["f"][inner])))
                        info[inner] += inv
                        for i, x in zip(np.flatnonzero(inner), pack_many(inv), strict=True):
                            j[i] = x
                    if known.any():
                        for i, x in zip(np.flatnonzero(known), pack_many(spd_inverses(info[known])), strict=True):
                            c[i] = x
                    yield pd.DataFrame({
                        "sig": pdf["sig"], "c": pd.Series(c, index=pdf.index, dtype=object), "j": pd.Series(j, index=pdf.index, dtype=object), "f": pdf["f"],
                        "free": pdf["free"], "num_siblings": pdf["num_siblings"], "kinds": pdf["kinds"],
                    })

        return map_frames(
            sigs, solve,
            "sig string, c array<double>, j array<double>, f array<double>, free bigint, num_siblings bigint, kinds bigint",
        )

    def _finish_up(self, k: int, nodes: DataFrame, stored: bool = False) -> None:
        """up = C (rhs + J * sum of the children's up), batch by batch."""
        n = self.n

        def run(rows: pd.DataFrame, mats: list[dict], at: np.ndarray) -> pd.DataFrame:
            zero, up = np.zeros(n), np.zeros((len(rows), n))
            for inner in (True, False):
                use = np.array([_some(m.get("c")) and _some(m.get("j")) == inner for m in mats], dtype=bool)
                rank, some = np.cumsum(use) - 1, use[at]
                if some.any():
                    x, ix = stack(rows["rhs"][some].map(lambda v: v if _some(v) else zero)), rank[at[some]]
                    if inner:
                        known = stack(rows["known"][some].map(lambda v: v if _some(v) else zero))
                        x = x + times_own(known, ix, [m["j"] for m, u in zip(mats, use, strict=True) if u])
                    up[some] = times_own(x, ix, [m["c"] for m, u in zip(mats, use, strict=True) if u])
            return pd.DataFrame({"geocode": rows["geocode"], "sig": rows["sig"], "up": list(up)})

        out = apply_by_signature(
            nodes.select("geocode", "sig", "rhs", "known"), self.mats[k].select("sig", "c", "j"), "sig", run,
            "geocode string, sig string, up array<double>", row_bytes=24 * n, stored=stored, together=True,
        )
        self.nodes[k] = self.cut(out, f"up_{k}")

    # -- downwards --

    def run_down(self, leaf_matrices: bool = False) -> "DensePasses":
        self.down[0] = self.cut(self.nodes[0].select("geocode", "sig", F.col("sig").alias("dsig"), F.col("up").alias("estimate")), "final_0")
        self.down_mats[0] = self.cut(self.mats[0].select(F.col("sig").alias("dsig"), "sig", F.col("c").alias("ct")), "final_mats_0")
        for k in range(1, self.spine.depth + 1):
            self._down_level(k)
            if k < self.spine.depth or leaf_matrices:
                self.down_matrices(k)
        return self

    def _down_level(self, k: int) -> None:
        n, w = self.n, self.spine.widths[k - 1]
        zero = F.array_repeat(F.lit(0.0), n)
        above = self.down[k - 1].select(
            F.col("geocode").alias("parent"), F.col("dsig").alias("parent_dsig"), F.col("sig").alias("parent_sig"), "estimate"
        ).join(self.sums[k - 1], "parent", "left").join(
            self.mats[k - 1].select(F.col("sig").alias("parent_sig"), "free", "num_siblings", "kinds"), "parent_sig"
        ).withColumn("residual", F.zip_with("estimate", F.coalesce("known", zero), lambda a, b: a - b)).drop("estimate", "known")
        above = self.cut(above, f"above_{k}")  # as a table of known size it is what is sent to the tasks, never the larger level below
        informed = self.mats[k].select("sig", F.col("c").isNotNull().alias("informed"))
        kids = self.nodes[k].withColumn("parent", prefix("geocode", w)).join(above, "parent").join(informed, "sig")
        lone_leaf = (F.lit(k) == self.spine.depth) & (F.col("num_siblings") == 1)
        takes_rest = ~F.col("informed") | lone_leaf
        # siblings of one kind share evenly; uninformed ones take all of the rest; others need a matrix
        scale = (
            F.when(takes_rest, 1 / F.col("free")).when(F.col("free") > 0, F.lit(0.0))
            .when(F.col("kinds") == 1, 1 / F.col("num_siblings"))
        )
        how = F.when(takes_rest, F.lit("rest")).when(F.col("free") > 0, F.lit("alone")).when(F.col("kinds") == 1, F.lit("even")).otherwise("general")
        dsig = F.sha2(F.concat_ws("|", "parent_dsig", "sig", how), 256)
        kids = self.cut(
            kids.select(
                "geocode", "sig", dsig.alias("dsig"), "parent_dsig", "parent_sig", how.alias("how"), scale.alias("scale"), "residual",
                F.when(takes_rest, zero).otherwise(F.col("up")).alias("base"),
            ), f"handed_{k}",
        )
        self.pairs[k] = self.cut(kids.select("dsig", "parent_dsig", "sig", "parent_sig", "how").distinct(), f"pairs_{k}")
        s = F.col("scale")
        plain = kids.filter("scale is not null").select(
            "geocode", "sig", "dsig", F.zip_with("base", F.transform("residual", lambda r: r * s), lambda a, b: a + b).alias("estimate")
        )
        needed = self.pairs[k].filter("how = 'general'")
        gains = needed.join(self.mats[k].select("sig", "c"), "sig").join(
            self.mats[k - 1].select(F.col("sig").alias("parent_sig"), "j"), "parent_sig"
        ).select("dsig", "c", "j")

        def run(rows: pd.DataFrame, mats: list[dict], at: np.ndarray) -> pd.DataFrame:
            est = stack(rows["base"]) + times_own(times_own(stack(rows["residual"]), at, [m["j"] for m in mats]), at, [m["c"] for m in mats])
            return pd.DataFrame({"geocode": rows["geocode"], "sig": rows["sig"], "dsig": rows["dsig"], "estimate": list(est)})

        general = apply_by_signature(
            kids.filter("scale is null").select("geocode", "sig", "dsig", "base", "residual"), gains, "dsig", run,
            "geocode string, sig string, dsig string, estimate array<double>", row_bytes=24 * n, stored=True, together=True,
        )
        self.down[k] = self.cut(plain.unionByName(general), f"final_{k}")

    def down_matrices(self, k: int) -> DataFrame:
        """(dsig, sig, ct): final covariance per downward signature, built on first use (leaves: on demand)."""
        if self.down_mats[k] is not None:
            return self.down_mats[k]
        rows = (
            self.pairs[k].join(self.mats[k].select("sig", "c"), "sig", "left")
            .join(self.mats[k - 1].select(F.col("sig").alias("parent_sig"), "j", "f", "free", "num_siblings"), "parent_sig", "left")
            .join(self.down_matrices(k - 1).select(F.col("dsig").alias("parent_dsig"), F.col("ct").alias("above")), "parent_dsig", "left")
            .select("dsig", "sig", "how", "c", "j", "f", "free", "num_siblings", "above")
        )

        def one(r: dict) -> np.ndarray | None:
            if r["how"] == "alone":
                return r["c"]
            if r["how"] == "rest":
                if r["free"] > 1 or not _some(r["above"]):
                    return None
                return np.asarray(r["above"]) + (np.asarray(r["f"]) if _some(r["f"]) else 0.0)
            if r["how"] == "even":
                m = float(r["num_siblings"])
                return np.asarray(r["c"]) * (1 - 1 / m) + np.asarray(r["above"]) / (m * m)
            c = unpack(r["c"])
            a = c @ unpack(r["j"])
            out = c + a @ unpack(r["above"]) @ a.T - a @ c
            return pack((out + out.T) / 2)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ct = [one(r) for r in pdf.to_dict("records")]
                yield pd.DataFrame({"dsig": pdf["dsig"], "sig": pdf["sig"], "ct": pd.Series(ct, dtype=object)})

        self.down_mats[k] = self.cut(map_frames(rows, run, "dsig string, sig string, ct array<double>"), f"final_mats_{k}")
        return self.down_mats[k]

    # -- results in long form --

    def estimates(self, depths: Sequence[int] | None = None) -> DataFrame:
        """(depth, geocode, cell, final_estimate)."""
        out = None
        for k in depths if depths is not None else range(self.spine.depth + 1):
            part = self.down[k].select(
                F.lit(k).alias("depth"), "geocode", F.posexplode("estimate").alias("cell", "final_estimate")
            )
            out = part if out is None else out.unionByName(part)
        return out

    def variances(self, depths: Sequence[int] | None = None) -> DataFrame:
        """(depth, geocode, cell, final_variance): diagonals of the final covariances; NULL where infinite."""
        n, out = self.n, None
        at = [i * n - i * (i - 1) // 2 for i in range(n)]
        for k in depths if depths is not None else range(self.spine.depth + 1):
            diag = F.transform(F.array(*[F.lit(a) for a in at]), lambda a: F.get("ct", a))
            mats = self.down_matrices(k).select("dsig", diag.alias("v"))
            part = self.down[k].select("geocode", "dsig").join(mats, "dsig").select(
                F.lit(k).alias("depth"), "geocode", F.posexplode("v").alias("cell", "final_variance")
            )
            out = part if out is None else out.unionByName(part)
        return out


def dense_own(
    measurements: DataFrame, design: DataFrame, n: int, masked: DataFrame | None = None, share: bool = True, cut: Callable[..., DataFrame] = cut_lineage,
) -> tuple[DataFrame, DataFrame]:
    """Inputs of :class:`DensePasses`, all levels at once.

    ``measurements``: (depth, geocode, query_name, value, variance) with one
    row per query; ``design`` as in :func:`own_rhs`; ``masked``: (geocode, cell).
    """
    sigs = own_signatures(measurements, masked, share)
    rhs = F.when(F.col("own_sig") != NO_OWN, F.col("rhs"))  # a bypassed unit says nothing, whatever else it measured
    nodes = cut(meet(sigs, own_rhs(measurements, design, n), "geocode", "left").withColumn("rhs", rhs), "own", by=["depth"])
    return nodes, cut(own_precision(nodes, measurements, design, masked, n), "precision")


def own_estimates(nodes: DataFrame, precision: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Each unit alone: (depth, geocode, own_sig, estimate) and (own_sig, c); bypassed units are zero without c."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = [pack(spd_inverse(unpack(p))) for p in pdf["p"]]
            yield pd.DataFrame({"own_sig": pdf["own_sig"], "c": pd.Series(c, dtype=object)})

    mats = cut_lineage(precision.mapInPandas(solve, "own_sig string, c array<double>"), "own_mats")

    def run(rows: pd.DataFrame, m: dict) -> pd.DataFrame:
        est = stack(rows["rhs"]) @ unpack(m["c"]) if _some(m.get("c")) else np.zeros((len(rows), n))
        return rows[["depth", "geocode", "own_sig"]].assign(estimate=list(est))

    units = apply_by_signature(
        nodes.select("depth", "geocode", "own_sig", "rhs"), mats, "own_sig", run,
        "depth int, geocode string, own_sig string, estimate array<double>", row_bytes=24 * n, stored=True,
    )
    return units, mats
