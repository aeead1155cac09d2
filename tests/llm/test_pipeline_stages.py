import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from helpers import SF01, frame  # noqa: E402
from test_dedup_count_pack import brute_components, brute_print, check_packed  # noqa: E402
from test_spans import brute_base  # noqa: E402
from thawline.llm import packing, quality  # noqa: E402
from thawline.llm.common import documents, stored  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage and the result."""
    table = documents(spark, SF01)
    near = table.filter("n_chars > 12000").withColumn("doc_id", F.col("doc_id") + 10 ** 6).withColumn("text", F.concat("text", F.lit(" changed")))
    docs = [table.unionByName(near).withColumn("__text", F.lit("extra")).withColumn("row", F.lit(1))]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF01), name.replace(" ", "")))
    return docs


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_pass_through(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:5])


def test_quality_keeps_good_documents(spark, stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    rules = quality.train(stages[0], spark.read.parquet(f"{SF01}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(stages[0], rules).collect()}
    assert set(after) == {i for i in before if scores[i] == 1}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in before]
    assert sum(i in after for i in good) >= 0.98 * len(good)
    assert sum(i in after for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())


def test_exact_copies_go(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    least = {}
    for i in sorted(before):
        least.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i].text), i)
    assert set(after) == set(least.values())


def test_one_of_each_near_duplicate_component_stays(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    prints = {i: brute_print(r.text) for i, r in before.items()}
    root = brute_components(prints.values())
    least = {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    assert set(after) == set(least.values()) and len(after) < len(before)


def test_personal_data_are_replaced(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert set(before) == set(after)
    changed = 0
    for i, r in before.items():
        spans = brute_base(r.text)
        changed += bool(spans)
        if not spans and r.text != after[i].text:
            raise AssertionError(f"{i} has no personal data")
        assert not brute_base(after[i].text)
        assert len(after[i].text) == after[i].n_chars
        for _, a, b in spans:
            assert r.text[a:b] not in after[i].text
    assert changed


def test_packing(stages):
    docs = rows_of(stages[4])
    check_packed(stages[5].collect(), {i: r.text for i, r in docs.items()}, {i: r.source for i, r in docs.items()}, packing.CAPACITY)


def test_awkward_documents_through_all_stages(spark):
    docs = frame(spark, [None, "", "a.b@c.de", "x", "x", "call +1 (212) 555-0100 now", "word " * 50], ids=[None, 1, 2, 3, 4, 5, 5])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF01), name.replace(" ", ""))
    docs.collect()
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF01), name.replace(" ", ""))
    assert empty.count() == 0


LONG = " ".join(f"word{k}" for k in range(400))


def test_one_copy_stays_with_null_and_repeated_ids(spark):
    texts = ["same a", "same  a", "same a", "null only", "null only", "twice", "twice", "other"]
    got = corpus_pipeline.drop_copies(spark, frame(spark, texts, [None, 4, 4, None, None, 7, 7, 7]), SF01).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, " ".join(r.text.split())) for r in got) == [
        (False, 4, "same a"), (False, 7, "other"), (False, 7, "twice"), (True, 0, "null only")]


def test_one_row_of_a_component_stays_with_null_and_repeated_ids(spark):
    far, lone = " ".join(f"thing{k}" for k in range(400)), " ".join(f"lone{k}" for k in range(400))
    # copies link as near copies do: 5 names the second component, and its other text is a copy of 1's;
    # the null id of the first component is a copy too, the last component has null ids only
    texts = [LONG, LONG.upper(), LONG, far, far.upper(), lone, lone.upper(), lone]
    docs = frame(spark, texts, [1, 5, None, 5, 6, None, None, None])
    got = corpus_pipeline.drop_near_copies(spark, docs, SF01).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == sorted([(1, LONG), (5, far), (0, lone)])


def test_near_dedup_stage_broadcasts_no_exploded_fingerprints(spark, monkeypatch):
    """Between the size of the fingerprints and that of their 66 keys each, the stage merges."""
    from thawline.llm import simhash
    plans, kept = [], simhash.stored

    def watched(df, name):
        if name == "simhash-members":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)
    monkeypatch.setattr(simhash, "stored", watched)
    texts = [f"word{i} other{i * i} third{i * 7} fourth{i}" for i in range(200)] + ["word0 other0 third0 fourth0"]
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "9000")
    try:
        docs = corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "")
        assert 0 < docs.count() <= 200
    finally:
        spark.conf.set(key, before)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastExchange" not in plans[0]
