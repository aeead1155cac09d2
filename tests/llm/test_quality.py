import math
import os
import random
import re
import sys
import zlib

import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF01, frame, texts_of  # noqa: E402
from thawline.llm import quality, registry  # noqa: E402


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def statistics(text):
    """The statistics restated in plain Python (code points; words parted by blanks, as a split leaves them)."""
    t = text or ""
    words, lines = re.split(r"[ \t-\r]+", t), t.split("\n")
    n, many = max(len(t), 1), max(len(words), 1)
    hits = lambda p: len(regex.findall(p, t))
    return {"chars": len(t), "words": len(words), "word_length": n / many, "distinct": len(set(words)) / many,
            "repeats": sum(1 for _ in regex.finditer(r"(?<!\S)(\S+)(?: \1(?!\S))++", t)) / many, "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines),
            "caps": hits(r"\p{Lu}{2,}+") / many, "shouts": t.count("!") / n, "bars": t.count("|") / n, "symbols": hits(r"[%&#$*~^_=<>{}]++") / many,
            "digits": hits(r"[0-9]++") / many, "stops": t.count(".") / many, "commas": t.count(",") / many, "odd": hits(r"[^\p{L}\p{N}\p{P}\s]++") / many}


def score(rules, text):
    if rules.constant is not None:
        return rules.constant
    x = list(statistics(text).values())
    odds = rules.intercept + sum(w for path, w in rules.rules if all((x[f] <= at) == side for f, side, at in path))
    return 1 / (1 + math.exp(-odds))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(rng, good):
    words = ["the", "house", "green", "over", "river", "walks", "slowly", "and", "sees", "light"]
    if good:
        return " ".join(". ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() for _ in range(rng.randint(2, 6))).split()) + "."
    return " ".join(rng.choice(["BUY", "!!!", "$$$", "click", "click", "WIN|"]) for _ in range(rng.randint(5, 60)))


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    return [prose(rng, k % 2 == 0) for k in range(n)]


def test_scores_are_the_compiled_rules(spark):
    """On the table: the native column equals the rules applied to statistics in plain Python."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rules = quality.train(docs, spark.read.parquet(f"{SF01}/labels.parquet"))
    texts = texts_of(spark, SF01)
    assert rules.rules
    rows = quality.quality_scores(docs, rules).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(score(rules, texts[r.doc_id]), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id)


def test_held_out_auc(spark):
    rows = {r.doc_id: r.score for r in registry.op6_quality_classifier(spark, SF01).collect()}
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF01}/labels.parquet").collect() if held_out(r.doc_id)]
    good, bad = [s for s, q in known if q], [s for s, q in known if not q]
    assert good and bad
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_held_out_labels_are_never_learnt(spark):
    texts = corpus()
    docs = frame(spark, texts)
    honest = labels_of(spark, [(k, 1 - k % 2, 0) for k in range(len(texts))])
    turned = labels_of(spark, [(k, k % 2 if held_out(k) else 1 - k % 2, 1) for k in range(len(texts))])
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, quality.train(docs, some)).collect()} for some in (honest, turned))
    assert a == b and {k: int(s >= 0.3) for k, s in a.items()} == {k: 1 - k % 2 for k in a}


def test_language_source_and_id_are_no_inputs(spark):
    texts = corpus(60)
    rules = quality.train(frame(spark, corpus()), labels_of(spark, [(k, 1 - k % 2, 0) for k in range(400)]))
    one = frame(spark, texts).withColumn("lang", F.lit("xx")).withColumn("label", F.lit(0)).withColumn("__id", F.lit("q")).withColumn("__raw", F.lit("q"))
    two = frame(spark, texts, ids=[10 ** 9 + k for k in range(60)], sources=["s"] * 60)
    a, b = (sorted(r.score for r in quality.quality_scores(d, rules).collect()) for d in (one, two))
    assert a == b


def test_awkward_documents_and_labels(spark):
    texts = corpus(200) + [None, "", "x" * 2_000_000, "same", "same", "\U0001f600 é\x00", "no id"]
    ids = [*range(200), 200, 201, 202, 203, 203, 204, None]
    docs = frame(spark, texts, ids=ids).withColumn("label", F.lit("x")).withColumn("quality", F.lit("x")).withColumn("__words", F.lit("x"))
    # several labels of an id count as the largest, null labels and ids as none, ids without a document do not matter
    rows = [(k, 1 - k % 2, 0) for k in range(200)] + [(1, 0, 0), (0, 0, 0), (3, None, 0), (None, 1, 0), (10 ** 6, 0, 0)]
    rules = quality.train(docs, labels_of(spark, rows))
    assert rules.rules and rules == quality.train(docs, labels_of(spark, [(k, 1 - k % 2, 0) for k in range(200)]))
    found = quality.quality_scores(docs, rules).collect()
    assert len(found) == len(texts) and all(0 <= r.score <= 1 for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[203]) == 2 and by_id[None][0].held_out
    for k in (200, 201, 202, 204):
        assert by_id[k][0].score == pytest.approx(score(rules, texts[k if k < 203 else 205]), abs=1e-9)


def test_few_labels_and_empty_tables(spark):
    docs, none = frame(spark, ["a", "b"], ids=[1, 2]), labels_of(spark, [])
    assert not held_out(1) and not held_out(2)
    for labels, want in ((none, 1.0), (labels_of(spark, [(1, 0, 0), (2, 0, 0)]), 0.0), (labels_of(spark, [(1, 1, 0)]), 1.0)):
        rules = quality.train(docs, labels)
        assert [r.score for r in quality.quality_scores(docs, rules).collect()] == [want, want]
    empty = frame(spark, [])
    assert quality.quality_scores(empty, quality.train(empty, none)).count() == 0


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    docs = frame(spark, corpus(100) * 3, ids=[*range(100)] * 3)
    labels = labels_of(spark, [(k, 1 - k % 2, 0) for k in range(100)])
    rows, names = quality.labelled(docs, labels, "doc_id", "text")
    ids = [r["__id"] for r in rows.collect()]
    assert sorted(ids) == [k for k in range(100) if not held_out(k)] and len(names) == len(statistics("x"))
    some, _ = quality.labelled(docs, labels, "doc_id", "text", max_train=7)
    assert some.count() == 7
