"""A run kept in files: every step is a table, committed once, so a run can stop anywhere, go on later, and serve later jobs.

Layout under ``out``: ``run`` (the parameters, one JSON row), ``widths`` (the
levels), one table per step (``estimates/<Level>`` and ``covariances/<Level>``
for final results, ``entities/...`` for entity estimates, ``steps/<step>`` for
the rest) and one record per committed step under ``commits``: its place in
the run, rows, schema and path. A table without a record was not finished
and is written anew.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stemtally.functions.keys import Spine
from stemtally.operators.gls_dense import DensePasses
from stemtally.sources import measurements as src

RECORD = "step string, place int, row_count long, schema string, path string"


class Stopped(Exception):
    """The run was asked to stop after a step; what it has is committed."""


def _rows(spark: SparkSession, path: str, ddl: str) -> list:
    try:
        return spark.read.schema(ddl).json(path).collect()  # a record per step, or one row
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


class StoredRun:
    """Opens the run at ``out`` or begins it. The parameters of a run never change: other ones raise."""

    def __init__(self, spark: SparkSession, out: str, spine: Spine, facts: Mapping[str, object], until: str | None = None):
        self.spark, self.out, self.spine, self.until = spark, out.rstrip("/"), spine, until
        facts = json.dumps({"levels": spine.names, "widths": spine.widths, **facts}, sort_keys=True)
        known = _rows(spark, f"{self.out}/run", "facts string")
        if not known:
            src.write_widths(spark, spine, f"{self.out}/widths")
            spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.json(f"{self.out}/run")
        elif known[0].facts != facts:
            raise ValueError(f"{self.out} holds a run with other parameters: {known[0].facts}")
        self.done = {r.step: r for r in _rows(spark, f"{self.out}/commits/*", RECORD)}
        self.reused: list[str] = []

    @classmethod
    def existing(cls, spark: SparkSession, out: str) -> StoredRun:
        """The run at ``out`` with its own parameters."""
        out = out.rstrip("/")
        known = _rows(spark, f"{out}/run", "facts string")
        if not known:
            raise ValueError(f"no run at {out}")
        facts = json.loads(known[0].facts)
        return cls(spark, out, src.read_widths(spark, f"{out}/widths"), {k: v for k, v in facts.items() if k not in ("levels", "widths")})

    @property
    def facts(self) -> dict:
        return json.loads(_rows(self.spark, f"{self.out}/run", "facts string")[0].facts)

    def path(self, step: str) -> str:
        for head, folder in (("final_mats_", "covariances"), ("final_", "estimates")):
            if step.startswith(head):
                return f"{self.out}/{folder}/{self.spine.names[int(step.removeprefix(head))]}"
        return f"{self.out}/{step}" if step.startswith("entities/") else f"{self.out}/steps/{step}"

    def read(self, step: str) -> DataFrame:
        r = self.done[step]
        return self.spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(r.path)

    def cut(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """The table of a committed step, else ``df`` written and committed as that step."""
        if name in self.done:
            self.reused.append(name)
            return self.read(name)
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        record = self.spark.createDataFrame([(name, len(self.done), stored.count(), df.schema.json(), path)], RECORD)
        record.coalesce(1).write.mode("overwrite").json(f"{self.out}/commits/{name.replace('/', '.')}")
        self.done[name] = record.first()
        if name == self.until:
            raise Stopped(name)
        return stored

    def commits(self) -> DataFrame:
        """(step, place, row_count, schema, path) of what is committed."""
        return self.spark.createDataFrame([tuple(r) for r in self.done.values()], RECORD)


def load(spark: SparkSession, out: str) -> DensePasses:
    """Both passes of a finished run, from its files alone. Leaf matrices are added to the run when they are first asked for."""
    run = StoredRun.existing(spark, out)
    passes = DensePasses.blank(run.spine, int(run.facts["cells"]), run.cut)
    d = run.spine.depth
    missing = [f"final_{k}" for k in range(d + 1) if f"final_{k}" not in run.done]
    if missing:
        raise ValueError(f"the run at {out} is not finished: {missing}")
    for k in range(d + 1):
        for table, step in ((passes.nodes, "up"), (passes.mats, "mats"), (passes.sums, "sums"), (passes.down, "final"), (passes.down_mats, "final_mats"), (passes.pairs, "pairs")):
            if f"{step}_{k}" in run.done:
                table[k] = run.read(f"{step}_{k}")
    return passes
