"""Progress of parts without any energy, against the SQL."""

import duckdb
import pytest

from mediaframe.plans import media_queries as Q


@pytest.fixture()
def tables(tmp_path):
    """Events of a user with no energy, one with a part of none after a part of some, one whose energies cancel."""
    values = {1: [0.0] * 3, 2: [5.0, 1.0, 4.0, 2.0, 3.0, 0.0, 0.0, 9.0, 0.0, 0.0], 3: [2.0, -2.0], 4: [7.0]}
    rows = [(u, i, v) for u, vs in values.items() for i, v in enumerate(vs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, TIMESTAMP '2024-01-01' + INTERVAL {i * 5} HOUR, {u}::BIGINT, 'click', {v}::DOUBLE, '{{\"k\": 3}}')" for n, (u, i, v) in enumerate(rows)) + ") t(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    return con, str(tmp_path)


def same_as_sql(spark, tables, name):
    con, path = tables
    df = Q.QUERIES[name](spark, path)
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.sql("SELECT " + ", ".join(df.columns) + f" FROM ({Q.SQL[name]})").fetchall())
    return got


def test_instant_changes(spark, tables):
    assert {(1, 0), (2, 0), (2, 1), (3, 0), (4, 0)} == {r[:2] for r in same_as_sql(spark, tables, "instant_changes")}


def test_progress_picks(spark, tables):
    assert (1, 0) in {r[:2] for r in same_as_sql(spark, tables, "progress_picks")}


@pytest.fixture()
def copies(tmp_path):
    """Events of two users, each 13 times a microsecond apart as in larger tables, so that one event without energy fills a part; the second user's also lack a value, are NaN or infinite."""
    con = duckdb.connect()
    con.execute("CREATE TABLE one AS SELECT * FROM (VALUES (1, 0, 5.0), (1, 1, 0.0), (1, 2, 7.0), (2, 0, 0.0), (2, 1, NULL), (2, 2, 'nan'::DOUBLE), (2, 3, 3.0), (2, 4, 'inf'::DOUBLE)) t(u, i, v)")
    con.execute("CREATE TABLE events AS SELECT (u * 10 + i) * 13 + c AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 5 HOUR + c * INTERVAL 1 MICROSECOND AS ts, u::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value, '{\"k\": 3}' AS props FROM one, range(13) t(c)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    return con, str(tmp_path)


def test_progress_picks_of_copies(spark, copies):
    got = same_as_sql(spark, copies, "progress_picks")
    assert len([r for r in got if r[:2] == (1, 2)]) == 1  # all goals at its first frame
    assert {r[0] for r in got} == {1, 2}
