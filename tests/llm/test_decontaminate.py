import hashlib
import itertools
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF001, frame  # noqa: E402
from thawline.llm import decontaminate, registry  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(texts, items, window=10):
    """(n_words, n_hit, ids, longest, runs) per text; items are (id, text)."""
    split = [(("" if i is None else str(i)), words(t)) for i, t in items]
    out = []
    for text in texts:
        w = words(text)
        hit, ids, longest = [False] * len(w), set(), 0
        for item, v in split:
            m = min(window, len(v))
            for a in range(len(v) - m + 1) if m else ():
                for p in range(len(w) - m + 1):
                    if w[p:p + m] == v[a:a + m]:
                        hit[p:p + m] = [True] * m
                        ids.add(item)
                        n = m
                        while p + n < len(w) and a + n < len(v) and w[p + n] == v[a + n]:
                            n += 1
                        longest = max(longest, n)
        runs, p = [], 0
        while p < len(w):
            q = p
            while q < len(w) and hit[q]:
                q += 1
            if q > p:
                runs.append((p, q))
            p = q + 1
        out.append((len(w), sum(hit), sorted(ids), longest, runs))
    return out


def got(df):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    for r in rows:
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])
    return [(r.n_words, r.n_hit, sorted(r["items"]), r.longest, [tuple(x) for x in r.runs]) for r in rows]


def planted(rng, n_items, n_docs):
    vocabulary = ["Ab", "cd", "é", "x9", "Öl", "ab", "q"]
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    gap = lambda: rng.choice([" ", "\n", ", ", "--", "\x00", "\u0007 "])
    text = lambda ws: "".join(w + gap() for w in ws)
    items = [draw(rng.choice([0, 1, 2, 4, 9, 10, 11, 15, 40])) for _ in range(n_items)]
    docs = []
    for _ in range(n_docs):
        body = draw(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(items)
            a = rng.randint(0, len(v))
            body += v[a:a + rng.randint(0, 40)] + draw(rng.randint(0, 5))
        docs.append(text(body))
    return [(k, text(v)) for k, v in enumerate(items)], docs


def table(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, longest long")


@pytest.mark.parametrize("limits", [{}, {"chunk": 60}, {"block_bytes": 200}, {"chunk": 25, "block_bytes": 300, "window": 4}])
def test_matches_equal_brute_force(spark, limits):
    rng = random.Random(3)
    items, docs = planted(rng, 14, 60)
    # single-word items would hit nearly everything: they are tested on their own below
    items = [(i, t) for i, t in items if len(words(t)) != 1]
    docs += [None, "", " .,\n", docs[0], items[-1][1].upper()]
    assert got(decontaminate.matches(frame(spark, docs), table(spark, items), **limits)) == brute(docs, items, limits.get("window", 10))


def test_awkward_items(spark):
    items = [(None, "one two"), (7, None), (7, "three"), (8, ""), (9, "One, two"), (10, "a b c d e f g h i j k"), (10, "four"), (11, "a b c d e f g h i j k")]
    docs = ["one two", "THREE four", "A b c d e f g h i j", "b c d e f g h i j k l", "a b c d e f g h i", "", None, "onetwo one\ttwo", "é threeé"]
    assert got(decontaminate.matches(frame(spark, docs), table(spark, items))) == brute(docs, items)
    assert got(decontaminate.matches(frame(spark, docs), table(spark, []))) == brute(docs, [])
    assert got(decontaminate.matches(frame(spark, []), table(spark, items))) == []


def test_repeated_and_null_ids_stand_for_themselves(spark):
    docs = ["one two", "one two", "x", "one two three"]
    rows = decontaminate.matches(frame(spark, docs, ids=[5, 5, None, None]), table(spark, [(1, "one two")])).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_hit) for r in rows) == [(False, 2, 2), (False, 2, 2), (True, 1, 0), (True, 3, 2)]


def test_long_text_goes_piece_by_piece(spark):
    item = " ".join(f"w{k}" for k in range(300))
    noise = "lorem w1 w2 ipsum. " * 30_000
    docs = [noise + item + " " + noise + item + " " + noise, "w7" * 200_000 + " " + item]
    rows = got(decontaminate.matches(frame(spark, docs), table(spark, [(1, item), (2, "w1 w9")]), chunk=50_000))
    assert rows[0] == (4 * 90_000 + 600, 600, ["1"], 300, [(120_000, 120_300), (240_300, 240_600)])
    assert rows[1] == (301, 300, ["1"], 300, [(1, 301)])


def test_words_whose_hashes_meet_do_not_match(spark, monkeypatch):
    """Every location is compared byte by byte, whatever the hash says."""
    from thawline.llm.suffix_sort import Hashes
    monkeypatch.setattr(Hashes, "of", lambda self, start, length: np.zeros(len(start), dtype=np.uint64) + np.asarray(length, dtype=np.uint64))
    items = decontaminate.Items([("a", b"aa bb cc dd ee ff gg hh ii jj")], 10)
    shard = decontaminate.Shard([b"zz bb cc dd ee ff gg hh ii jj", b"x aa bb cc dd ee ff gg hh ii jj"], items)
    window, word = shard.locations()
    assert word.tolist() == [11]


def test_suffix_array_is_sorted():
    rng = random.Random(5)
    items, docs = planted(rng, 8, 30)
    index = decontaminate.Items([(str(i), t.encode()) for i, t in items], 10)
    shard = decontaminate.Shard([d.encode() for d in docs], index)
    raw, w = shard.words.bytes.tobytes(), shard.words
    name = {v: k + 1 for k, v in enumerate(index.vocabulary.tolist())}
    symbol = [name.get(h, 0) for h in shard.hashes.of(w.start, w.stop - w.start).tolist()]

    def head(p):
        stop = min(p + 10, shard.end[p])
        return list(itertools.takewhile(bool, symbol[p:stop]))
    heads = [head(p) for p in shard.array.tolist()]
    assert heads == sorted(heads) and len(heads) > 100 and raw


def test_clean_documents_stay_whole(spark):
    docs = ["one two three", None, "no match", "ONE two"]
    frame_ = frame(spark, docs)
    kept = decontaminate.decontaminate(frame_, table(spark, [(1, "one two"), (2, "four")]), block_bytes=4)
    assert kept.schema.names == frame_.schema.names
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in frame_.collect() if r.doc_id in (1, 2)), key=str)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        v = words(t)
        for a in range(len(v) - min(10, len(v)) + 1) if v else ():
            grams.setdefault(tuple(v[a:a + min(10, len(v))]), set()).add(str(i))
    want = {}
    for k, t in docs.items():
        w, hit, ids = words(t), set(), set()
        for m in {len(g) for g in grams}:
            for p in range(len(w) - m + 1):
                if tuple(w[p:p + m]) in grams:
                    hit |= set(range(p, p + m))
                    ids |= grams[tuple(w[p:p + m])]
        want[k] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    rows = registry.op11_decontaminate(spark, SF001).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want and any(r.contaminated for r in rows)
