"""Composite queries on the driver tables; DuckDB twins for a few."""

import os

import duckdb
import pytest

from conftest import SF001, SF01

pytestmark = pytest.mark.skipif(not os.path.exists(SF01), reason="driver tables missing")


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["rolling_history", "samples_events", "env_counts_orders"])
def test_against_duckdb(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF01)
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    exp = con.sql(E.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(exp.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    ref = sorted(tuple(str(dict(zip(exp.columns, r))[c]) for c in cols) for r in exp.fetchall())
    assert got == ref


def test_generation_properties(spark):
    from pyspark.sql import functions as F
    from thawline.operators import candidates
    from thawline.plans import shared
    train = shared.part(spark, SF01, "orders", "train")
    test = shared.part(spark, SF01, "orders", "test")
    c = candidates.generate(train, test, n=30, seed=1, version="v0")
    per = c.groupBy("iid").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u"))
    assert per.where((F.col("n") != 30) | (F.col("u") != 30)).count() == 0


def test_closed_range_over_the_whole_item_table(spark):
    import duckdb
    import __spark_entry__ as E
    from conftest import SF001
    got = sorted(tuple(map(str, r)) for r in E.queries()["closed_range_events"](spark, SF001).select("uid", "iid", "env", "ts").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF001}/events.parquet'")
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"SELECT uid, iid, env, ts FROM ({E.oracle_sql()['closed_range_events']})").fetchall())


def test_a_null_in_any_column_drops_the_row(spark, monkeypatch):
    from thawline.plans import prep
    cols = "uid long, iid long, rating double, ts timestamp_ntz, title string, title_idx string, publish_time date"
    import datetime as dt
    full = (1, 1, 5.0, dt.datetime(2024, 1, 20), "t", "t", dt.date(2000, 1, 1))
    rows = [full] + [full[:k] + (None,) + full[k + 1:] for k in range(len(full))]
    data = spark.createDataFrame(rows, cols)
    seen = []
    monkeypatch.setattr(prep.adapters, "interactions", lambda *a: data.select("uid", "iid", "rating", "ts").limit(1))
    monkeypatch.setattr(prep.adapters, "items_for", lambda *a: data.select("iid", "title", "publish_time").limit(1))
    monkeypatch.setattr(prep.cohorts, "join_items", lambda *a: data)
    monkeypatch.setattr(prep.cohorts, "cold_titles", lambda d, p: seen.append(d.collect()) or data.select("title_idx").limit(0))
    prep.cohort_rows(spark, "", "events", prep.PrepOptions(drop_incomplete=True))
    assert [tuple(r) for r in seen[0]] == [full]
