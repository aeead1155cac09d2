"""Readers/writers round trips, the streaming metric-log follower, and the
shared-sample candidate variants."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from thawline.sources import readers as R
from thawline.sources import sinks as K


def test_tsv_null_marker(spark, tmp_path):
    p = tmp_path / "basics.tsv"
    p.write_text("tconst\ttitleType\tstartYear\tendYear\truntimeMinutes\tgenres\n"
                 "tt0000001\tmovie\t1999\t\\N\t90\tDrama\n"
                 "tt0000002\tshort\t\\N\t\\N\t\\N\tComedy\n")
    df = R.read_tsv(spark, str(p)).orderBy("tconst").collect()
    assert df[0].startYear == "1999" and df[0].endYear is None
    assert df[1].startYear is None and df[1].runtimeMinutes is None


def test_tsv_in_the_public_layout_is_read_by_name(spark, tmp_path):
    p = tmp_path / "title.basics.tsv"
    p.write_text("tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres\n"
                 "tt0000001\tshort\tCarmencita\tCarmencita\t0\t1894\t\\N\t1\tDocumentary,Short\n"
                 'tt0000002\tmovie\t"Quoted start\tit "is" so\t0\t\\N\t\\N\t\\N\tDrama\n'
                 "tt0000003\tmovie\tnext\tnext\t0\t1999\t\\N\t90\tDrama\n")
    rows = R.read_tsv(spark, str(p)).orderBy("tconst").collect()
    assert [(r.tconst, r.titleType, r.startYear, r.endYear, r.runtimeMinutes, r.genres) for r in rows] == [
        ("tt0000001", "short", "1894", None, "1", "Documentary,Short"), ("tt0000002", "movie", None, None, None, "Drama"), ("tt0000003", "movie", "1999", None, "90", "Drama")]
    q = tmp_path / "shuffled.tsv"
    q.write_text("genres\tx\tstartYear\ttconst\tendYear\ttitleType\truntimeMinutes\nDrama\t?\t2001\ttt1\t\\N\tmovie\t80\n")
    r = R.read_tsv(spark, str(q)).first()
    assert (r.tconst, r.titleType, r.startYear, r.endYear, r.runtimeMinutes, r.genres) == ("tt1", "movie", "2001", None, "80", "Drama")
    with pytest.raises(ValueError):
        R.read_tsv(spark, str(q), R.MOVIES)


def test_csv_with_quotes_and_separators(spark, tmp_path):
    p = tmp_path / "movies.csv"
    p.write_text('movieId,title,genres\n1,"Great ""Cats"", The (1998)",Musical\n2,Plain (2000),Drama\n3,"A, B",\n')
    rows = R.read_csv(spark, str(p), R.MOVIES).orderBy("movieId").collect()
    assert [tuple(r) for r in rows] == [(1, 'Great "Cats", The (1998)', "Musical"), (2, "Plain (2000)", "Drama"), (3, "A, B", None)]


def test_epoch_conversions(spark):
    df = spark.createDataFrame([(1700000000, 1700000000123)], "s long, ms long")
    r = df.select(R.epoch_seconds_to_ts("s").alias("a"), R.epoch_millis_to_ts("ms").alias("b")).first()
    assert str(r.a) == "2023-11-14 22:13:20" and str(r.b) == "2023-11-14 22:13:20.123000"


def test_metric_log_follower(spark):
    from thawline.streaming.metric_log import follow
    path = K.scratch_dir(spark, "t_log")
    rows = [(0, e, v) for e, v in enumerate([0.5, 0.6, 0.6, 0.55])] + [(1, e, v) for e, v in enumerate([0.7, 0.65])]
    df = spark.createDataFrame(rows, "run int, epoch int, valid_auc double")
    K.append_json(df.where("epoch < 2"), path)
    K.append_json(df.where("epoch >= 2"), path)
    out = {r.run: r for r in follow(spark, path, K.scratch_dir(spark, "t_ckpt"), K.scratch_dir(spark, "t_follow")).collect()}
    assert (out[0].best_metric, out[0].best_epoch, out[0].last_epoch, out[0].n_epochs) == (0.6, 1, 3, 4)
    assert (out[1].best_metric, out[1].best_epoch, out[1].n_epochs) == (0.7, 0, 2)


def test_stateful_stopper_equals_the_batch_form_across_restarts(spark):
    import random

    from thawline.operators.metrics import early_stop
    from thawline.streaming.early_stop import watch
    rnd = random.Random(4)
    rows = []
    for run in range(12):
        best = 0.4 if run % 3 else 0.6
        for e in range(rnd.choice([1, 4, 30, 45])):
            value = None if run == 5 and e < 9 else round(best + rnd.choice([-0.05, -0.02, 0.0, 0.01 if e < 8 else -0.01]), 3)
            rows.append((run, 2 * e, value))
    rows += [(20, e, None) for e in range(30)] + [(21, e, 0.5) for e in range(30)] + [(22, e, 0.56) for e in range(7)]
    log = spark.createDataFrame(rows, "run int, epoch int, valid_auc double")
    path, ckpt, out = (K.scratch_dir(spark, f"t_stop_{x}") for x in ("log", "ckpt", "out"))
    for lo, hi in ((0, 7), (7, 8), (8, 40), (40, 1000)):
        K.append_json(log.where((F.col("epoch") >= lo) & (F.col("epoch") < hi)), path)
        got = watch(spark, path, ckpt, out, patience=4, low=0.55, extra=6)
        so_far = early_stop(log.where(F.col("epoch") < hi), patience=4, low=0.55, extra=6)
        assert sorted(map(tuple, got.drop("n_epochs", "n_late").collect())) == sorted(map(tuple, so_far.collect()))
    assert {r.run: r.n_epochs for r in got.collect()}[21] == 30
    before = sorted(map(tuple, got.drop("n_late").collect()))
    K.append_json(log.where("run = 21 and epoch < 3"), path)      # delivered twice
    again = watch(spark, path, ckpt, out, patience=4, low=0.55, extra=6)
    assert sorted(map(tuple, again.drop("n_late").collect())) == before
    assert {r.run: r.n_late for r in again.collect()}[21] == 3


@pytest.mark.skipif(not os.path.exists(SF01), reason="driver tables missing")
def test_shared_sample_variants(spark):
    from thawline.operators import candidates
    from thawline.plans import shared
    train = shared.part(spark, SF01, "orders", "train")
    test = shared.part(spark, SF01, "orders", "test")
    valid = shared.part(spark, SF01, "orders", "valid")
    vusers = {r.uid for r in valid.select("uid").distinct().collect()}
    for version, inside in (("v1", False), ("v2", True)):
        c = candidates.generate(train, test, n=10, seed=3, version=version, valid=valid)
        per_item = c.groupBy("iid").agg(F.sort_array(F.collect_set("uid")).alias("u"))
        sets = {tuple(r.u) for r in per_item.collect()}
        assert len(sets) == 1                      # one shared sample for all items
        users = set(next(iter(sets)))
        assert len(users) == 10
        assert (users <= vusers) if inside else not (users & vusers)
