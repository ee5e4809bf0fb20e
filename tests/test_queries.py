"""Registered queries against their SQL on the smallest tables; the slow ones are left to tools/compare.py."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import TABLES, compare  # noqa: E402

from stemtally.plans import registry  # noqa: E402

registry.load_all()
SLOW = ("2cell", "gls_", "dense", "entity_cov", "entity_variances", "two_pass", "masked_job", "resumed", "fused_stored", "cousin", "ancestor_cov", "ci_entities", "coverage", "read_levels")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not any(s in n for s in SLOW)))
def test_query(spark, con, sf_dir, name):
    out, _ = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES.get(name), sf_dir)
    assert out.startswith("ok") or (name == "recode_catalog" and out.startswith("rows-only")), out


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
