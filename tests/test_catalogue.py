"""Every query against its SQL on the smallest tables; the contract's shape."""

import math

import duckdb
import pytest

from tapeloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return str(int(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer() else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = frame.select(columns).collect()
    if name not in catalogue.oracle_sql():
        assert len(rows)
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(rows) == plain([[r[i] for i in at] for r in want.fetchall()])


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["seq", "first_arrival", "emit_arrival"]
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sessions_are_whole_over_many_batches_and_stay_out_of_the_driver(spark, tmp_path):
    """Three files, a batch each, none in the order of time; no row is late, and no result is a table in the driver's memory."""
    from tapeloom.streaming import windows

    rows = spark.read.parquet(f"{FOLDER}/events.parquet")
    for n in range(3):
        rows.where(f"event_id % 3 = {n}").toPandas().sort_values("ts", ascending=False).to_parquet(f"{tmp_path}/events{'.' if not n else f'-{n}.'}parquet", coerce_timestamps="us")
    found = windows.run_to_end(windows.session_counts(windows.read_events(spark, str(tmp_path), 1), lateness=None), f"{tmp_path}/out", "complete")
    assert found.inputFiles() and found.selectExpr("sum(n)").first()[0] == rows.count()
    assert found.count() == catalogue.queries()["stream_session_gaps"](spark, FOLDER).count()
