"""W1 against a plain-Python restatement (literal fixture W1 + properties)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from thawline.operators import ordering
from thawline.operators.history import rolling_history


def reference_history(rows, max_len=15):
    """Plain restatement: per user in (ts, iid, rating) order, history =
    last max_len of [0] + earlier positive iids."""
    out = {}
    by_user = {}
    for r in rows:
        by_user.setdefault(r[0], []).append(r)
    for u, rs in by_user.items():
        rs.sort(key=lambda r: (r[3], r[1], r[2]))
        his, tit = [0], [""]
        for r in rs:
            out[(u, r[1], r[3])] = (his[-max_len:], tit[-max_len:])
            if r[4] == 1:
                his.append(r[1])
                tit.append(f"t{r[1]}")
    return out


def _frame(spark, rows):
    return spark.createDataFrame(
        [(u, i, float(rt), ts, lab, f"t{i}") for (u, i, rt, ts, lab) in rows],
        "uid long, iid long, rating double, ts timestamp_ntz, label int, title string")


def test_literal_fixture(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    # user 1: 20 positives and 5 negatives mixed, over several days
    for k in range(25):
        rows.append((1, 100 + k, 5 if k % 5 else 1, t0 + dt.timedelta(hours=7 * k), 0 if k % 5 == 0 else 1))
    # user 2: only negatives
    for k in range(4):
        rows.append((2, 200 + k, 1, t0 + dt.timedelta(days=k), 0))
    # user 3: equal timestamps (tie broken by iid)
    for k in range(5):
        rows.append((3, 300 - k, 4, t0, 1))
    got = {(r.uid, r.iid, r.ts): (list(r.his), list(r.his_title))
           for r in rolling_history(_frame(spark, rows)).collect()}
    exp = reference_history(rows)
    assert got == {k: (v[0], v[1]) for k, v in exp.items()}
    assert all(len(v[0]) <= 15 for v in got.values())


def test_random_users_many_buckets(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    seen = set()
    for u in range(6):
        for k in range(rnd.randint(1, 80)):
            ts = t0 + dt.timedelta(hours=rnd.randint(0, 24 * 20))
            i = rnd.randint(1, 40)
            if (u, i, ts) in seen:
                continue
            seen.add((u, i, ts))
            rows.append((u, i, rnd.randint(1, 5), ts, rnd.randint(0, 1)))
    got = {(r.uid, r.iid, r.ts): (list(r.his), list(r.his_title))
           for r in rolling_history(_frame(spark, rows)).collect()}
    exp = reference_history(rows)
    assert got == {k: (v[0], v[1]) for k, v in exp.items()}
    # the same with many ranges per user (more carry joins) and with one
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            some = {(r.uid, r.iid, r.ts): list(r.his) for r in rolling_history(_frame(spark, rows)).collect()}
            assert some == {k: v[0] for k, v in exp.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set(merge, "true")


def test_rows_without_time_stay_and_come_last(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, 5, 5, None, 1), (1, 6, 5, day, 1), (1, 7, 1, None, 0)]
    got = {r.iid: list(r.his) for r in rolling_history(_frame(spark, rows)).collect()}
    assert got == {6: [0], 5: [0, 6], 7: [0, 6, 5]}


def test_hot_user_and_partition_invariance(spark):
    """One user holds a third of all rows; results equal the restatement for
    any partitioning / input order."""
    rnd = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows, seen = [], set()
    for k in range(900):                       # hot user 0 over 60 days
        ts = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 60))
        i = rnd.randint(1, 300)
        if (0, i, ts) not in seen:
            seen.add((0, i, ts))
            rows.append((0, i, rnd.randint(1, 5), ts, rnd.randint(0, 1)))
    for u in range(1, 60):
        for k in range(30):
            ts = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 60))
            i = rnd.randint(1, 300)
            if (u, i, ts) not in seen:
                seen.add((u, i, ts))
                rows.append((u, i, rnd.randint(1, 5), ts, rnd.randint(0, 1)))
    exp = {k: v[0] for k, v in reference_history(rows).items()}
    base = _frame(spark, rows)
    for variant in (base.repartition(1), base.repartition(13), base.orderBy(F.rand(5))):
        got = {(r.uid, r.iid, r.ts): list(r.his) for r in rolling_history(variant).collect()}
        assert got == exp


def test_batches_continue_the_stored_state(spark):
    import pytest

    from thawline.operators.history import history_state, newest_state
    rnd = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows, seen = [], set()
    for u in range(8):
        for _ in range(rnd.choice([1, 3, 20, 60])):
            ts, iid = t0 + dt.timedelta(hours=rnd.randint(0, 90)), rnd.randint(1, 40)
            if (u, iid, ts) not in seen:
                seen.add((u, iid, ts))
                rows.append((u, iid, 3, ts, 0 if u == 7 else rnd.randint(0, 1)))     # user 7 has no positive
    cuts = [t0 + dt.timedelta(hours=h) for h in (10, 30, 31, 60)]
    parts = [[r for r in rows if sum(r[3] >= c for c in cuts) == k] for k in range(len(cuts) + 1)]
    got, state = {}, None
    for part in parts:
        out = rolling_history(_frame(spark, part), state=state)
        got.update({(r.uid, r.iid, r.ts): (list(r.his), list(r.his_title)) for r in out.collect()})
        new = history_state(out)
        state = new if state is None else newest_state(state, new)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert got == reference_history(rows)
    stored = {r.uid: r for r in state.collect()}
    for u in range(8):
        hits = sorted((r for r in rows if r[0] == u and r[4] == 1), key=lambda r: (r[3], r[1], r[2]))
        assert stored[u].n_pos == len(hits)
        assert [(x.iid, x.title) for x in stored[u].recent] == [(r[1], f"t{r[1]}") for r in hits[-15:]]
    with pytest.raises(ValueError):
        rolling_history(_frame(spark, parts[2]), state=state)
    assert rolling_history(_frame(spark, []), state=state).count() == 0


def test_only_users_of_several_ranges_travel(spark):
    """400 users in eight ranges: the table that meets the rows holds the users at a border and the hot one."""
    rows = [(u, k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for u in range(400) for k in range(300 if u == 7 else 3)]
    df = spark.createDataFrame(rows, "uid long, k int, ts timestamp_ntz").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = ordering.by_range(df.withColumn("_v", F.lit(1).cast("long")), ["uid"], ["ts"])
        ranges, held = x.select("_range").distinct().count(), ordering.straddling(x, ["uid"])
        assert ranges > 1 and 0 < held.count() <= 2 * ranges
        got = ordering.running_before(df, ["uid"], ["ts"], F.lit(1), "n", total="all")
        assert all(r.n == r.k and r["all"] == (300 if r.uid == 7 else 3) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
