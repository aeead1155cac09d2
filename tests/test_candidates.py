"""Candidate samples: sizes, independence, and the refusal of too few users."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from thawline.operators import calibrate, candidates, prompts


def frames(spark, users, items):
    t0 = dt.datetime(2024, 1, 1)
    train = spark.createDataFrame([(u, i, t0, f"t{i}") for u in range(users) for i in range(2)], "uid long, iid long, ts timestamp_ntz, title string")
    test = spark.createDataFrame([(100 + i, f"t{i}") for i in range(items)], "iid long, title string")
    return train, test


def test_samples_of_two_items_overlap_as_independent_ones(spark):
    users, items, n = 211, 60, 40
    train, test = frames(spark, users, items)
    got = {}
    for r in candidates.generate(train, test, n=n, seed=5, min_rows=1).collect():
        got.setdefault(r.iid, set()).add(r.uid)
    assert len(got) == items and all(len(u) == n for u in got.values())
    sets = list(got.values())
    overlaps = [len(a & b) for k, a in enumerate(sets) for b in sets[:k]]
    mean = sum(overlaps) / len(overlaps)
    assert abs(mean - n * n / users) < 0.6
    # not "the same stretch or nothing": hardly any pair is disjoint, and none is equal
    assert sum(o == 0 for o in overlaps) < 0.05 * len(overlaps) and max(overlaps) < n
    held = [sum(u in s for s in sets) for u in range(users)]
    assert max(held) < 4 * items * n / users


def test_every_user_count_works(spark):
    for users in (1, 2, 3, 4, 9, 10, 24):
        train, test = frames(spark, users, 3)
        rows = candidates.generate(train, test, n=users, seed=1, min_rows=1).collect()
        assert sorted((r.iid, r.uid) for r in rows) == [(100 + i, u) for i in range(3) for u in range(users)]
        assert sorted(r.row_id for r in rows) == list(range(1, 3 * users + 1))


def test_too_few_warm_users_raise(spark):
    train, test = frames(spark, 9, 2)
    for version in ("v0", "v1"):
        with pytest.raises(ValueError):
            candidates.generate(train, test, n=10, version=version, valid=train.limit(0), min_rows=1)


def test_narrow_rows_hold_nothing_of_the_templates(spark):
    train, test = frames(spark, 30, 4)
    whole = sorted(map(str, candidates.generate(train, test, n=7, seed=3, min_rows=1).drop("ts").select("row_id", "uid", "iid", "title").collect()))
    users = candidates.ranked_users(train, seed=3, min_rows=1)
    rows = candidates.sampled_rows(users, test, n=7, seed=3)
    assert sorted(rows.columns) == ["_r", "iid", "row_id", "title", "uid"]
    assert sorted(map(str, rows.select("row_id", "uid", "iid", "title").collect())) == whole
    # a column derived from the template on the way is the template's
    derived = candidates.sampled_rows(users.withColumn("twice", F.col("uid") * 2), test, n=7, seed=3, derive=lambda r: r.select("iid", "_ipos", "_r", "uid", "twice"))
    assert {(r.uid, r.twice) for r in derived.collect()} == {(r.uid, 2 * r.uid) for r in rows.collect()}


def test_a_text_is_rendered_in_two_steps(spark):
    df = spark.createDataFrame([([0, 5], ["", "a <title> b"], 1, 9, "new", 1), ([0], [""], 2, 9, None, 0)],
                               "his array<long>, his_title array<string>, uid long, iid long, title string, label int")
    whole = {r.uid: r.prompt for r in prompts.render_prompt(prompts.llm_sample(df, 15)).collect()}
    h = prompts.render_history(prompts.llm_sample(df.withColumn("title", F.lit("")), 15)).select("uid", "prompt")
    steps = prompts.render_title(h.join(df.select("uid", prompts.title_text("title").alias("title_text")), "uid"))
    assert {r.uid: r.prompt for r in steps.collect()} == whole and '"a "new" b"' in whole[1] and whole[2] is None


def test_titles_are_looked_up_once_per_user(spark):
    users = spark.createDataFrame([(0, [0, 5, 6]), (1, [0]), (2, [6, 5, 5])], "_r long, his array<long>")
    rows = spark.createDataFrame([(1, 10, 5, 0, 0.9), (2, 11, 6, 1, 0.1), (3, 12, 7, 2, 0.4), (4, 10, 7, 0, 0.2)], "row_id long, uid long, iid long, _r long, predicted_logit double")
    train = spark.createDataFrame([(1,), (0,)], "label int")
    lookup = spark.createDataFrame([(5, "five"), (6, "six")], "iid long, title string")
    plain = calibrate.synthetic_training_rows(rows.join(users, "_r"), train, lookup)
    by_user = calibrate.synthetic_training_rows(rows, train, lookup, users)
    cols = ["row_id", "uid", "iid", "label", "his", "title", "his_title", "ts", "env"]
    got = sorted(map(str, by_user.select(cols).collect()))
    assert got == sorted(map(str, plain.select(cols).collect())) and "['five', 'six']" in got[0]
    # the rows meet the titles' arrays, never one line per element
    assert "posexplode" not in by_user._jdf.queryExecution().optimizedPlan().toString()
