"""Every registered media query against its SQL in DuckDB, or at least to a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

from mediaframe.plans import queries as core

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = rows(df.select(*(f"`{c}`" for c in cols)).collect())
    if name not in core.oracle_sql():
        assert got, name
        return
    sql = core.oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == cols
    want = rows(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_have_no_unpartitioned_windows(spark, capsys):
    for name in ("gap_sessions", "robust_cuts", "asof_backward", "interval_coverage", "overlap_first", "mutual_nearest"):
        core.queries()[name](spark, str(DATA)).explain("formatted")
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        assert "Exchange SinglePartition" not in plan, name
