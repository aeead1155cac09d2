import hashlib
import os
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF001, SF01, frame, texts_of  # noqa: E402
from thawline.llm import exact_dedup, packing, registry, simhash, token_counts, topk  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- exact dedup

def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def got_exact(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


AWKWARD = ["", None, " ", "a b", "a  b", "a\t\nb", "ab", "x" * 9000, "x" * 9001, "One. " * 3000, "One.  " * 3000, "a b", "\U0001f600 z", "a b"]


def test_exact_dedup_awkward(spark):
    ids = [*range(len(AWKWARD) - 1), None]
    assert got_exact(exact_dedup.exact_dedup(frame(spark, AWKWARD, ids))) == brute_exact(list(zip(ids, AWKWARD)))


def test_exact_dedup_rows_repeated_and_empty_table(spark):
    texts, ids = ["a b c"] * 5 + ["d"], [3, 3, 1, 7, 7, 2]
    assert got_exact(exact_dedup.exact_dedup(frame(spark, texts, ids))) == brute_exact(list(zip(ids, texts)))
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_verifies_fingerprints(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb. ", "cc"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += texts[:40]
    docs = frame(spark, texts)
    got = exact_dedup.exact_dedup(docs, least=5, most=20, fingerprint_bits=3)  # eight fingerprints for all chunks
    assert got_exact(got) == brute_exact(list(enumerate(texts)))


def test_exact_dedup_table(spark):
    assert got_exact(registry.op3_exact_dedup(spark, SF01)) == brute_exact(texts_of(spark, SF01).items())


# -------------------------------------------------------------------- simhash

def brute_print(text):
    import xxhash
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, bits=2):
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash_table(spark):
    texts = texts_of(spark, SF01)
    prints = {i: brute_print(t) for i, t in texts.items()}
    root = brute_components(prints.values())
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(root[p], i)
    want = {(i, f"{p:016x}", least[root[p]]) for i, p in prints.items()}
    got = registry.op8_simhash_dedup(spark, SF01)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == want
    assert any(i != c for i, _, c in want)


@pytest.mark.parametrize("bucket", [2, 8, 10 ** 6])
def test_simhash_links_of_crowded_fingerprints(spark, bucket):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        walk = s
        for _ in range(40):  # chains and clouds of one to three flips
            walk = s if rng.random() < 0.5 else walk
            for _ in range(rng.randint(1, 3)):
                walk ^= 1 << rng.randrange(64)
            prints.add(walk)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    u = lambda x: x % (1 << 64)
    classes, ours = {}, {}
    for p in prints:
        classes.setdefault(want[p], set()).add(p)
    for p in signed:
        ours.setdefault(got.get(p, p), set()).add(u(p))
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, ours.values()))


def test_simhash_awkward(spark):
    texts = ["", None, "  \n", "one", "One", "one two", "a b c", "a b c", "é " * 5000, "ß"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(frame(spark, texts)).collect()}
    assert got[0] == got[1] == got[2] == ("0" * 16, 0)
    assert got[3] == got[4] and got[3][1] == 3 and got[6] == got[7]
    assert [got[i][0] for i in range(len(texts))] == [f"{brute_print(t):016x}" for t in texts]
    assert simhash.simhash_dedup(frame(spark, [])).count() == 0


# --------------------------------------------------------------- token counts

def library_counts(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


COUNTED = ["", None, "a", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "  two  blanks \n\n", "naïve café", "中文字符", "\U0001f600\U0001f600",
           "it's I'LL we've", "\x1c\x1d a\x85b", "١٢٣ 123 ½", "word " * 3000, "tab\tand hard", "x" * 5000, "\r\n\r\n a", "ǅ ʰ ᾳ"]


def test_token_counts_awkward_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = frame(spark, COUNTED + COUNTED[:3])
    got = {r.doc_id: r for r in token_counts.token_counts(docs, JSON, cache).collect()}
    want = library_counts(COUNTED + COUNTED[:3])
    assert [got[i].n_tokens for i in range(len(want))] == want
    assert [got[i].n_bytes for i in range(len(want))] == [len((t or "").encode()) for t in COUNTED + COUNTED[:3]]
    assert got[12].over_limit and not got[0].over_limit
    first = spark.read.parquet(cache).count()
    assert first == len({(t or "") for t in COUNTED})  # one row per distinct content
    more = frame(spark, [*COUNTED[:4], "new text"])
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, JSON, cache).collect()} == dict(enumerate(library_counts([*COUNTED[:4], "new text"])))
    assert spark.read.parquet(cache).count() == first + 1
    # stored counts are used, not encoded again; another tokenizer's are not
    spark.createDataFrame([("other", hashlib.sha256(b"seen").hexdigest(), 5), (token_counts.tokenizer_version(JSON), hashlib.sha256(b"marked").hexdigest(), 77)],
                          token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, ["seen", "marked"]), JSON, cache).collect()}
    assert got == {0: library_counts(["seen"])[0], 1: 77}


def test_token_counts_repeats_and_empty(spark, tmp_path):
    got = token_counts.token_counts(frame(spark, ["a b", "a b", "c"], [4, 4, None]), JSON, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 2), (False, 2), (True, 1)]
    assert token_counts.token_counts(frame(spark, []), JSON, str(tmp_path / "b")).count() == 0


def test_token_counts_table(spark):
    texts = texts_of(spark, SF01)
    want = dict(zip(texts, library_counts(texts.values())))
    assert {r.doc_id: r.n_tokens for r in registry.op2_token_counts(spark, SF01).collect()} == want


# -------------------------------------------------------------------- packing

@pytest.mark.parametrize("seed", range(4))
def test_best_fit_takes_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    n, cap = 300, 50
    lengths = sorted((rng.randint(0, cap - 1) for _ in range(n)), reverse=True)
    sources = [rng.choice(["hot", "hot", "hot", *"abcdefgh", None]) for _ in range(n)]
    clusters = [rng.choice([1, 2, None, *range(10, 100)]) for _ in range(n)]
    bins, offsets = packing.best_fit(np.array(lengths), np.array(sources, dtype=object), np.array(clusters, dtype=object), cap, block=4)
    state = {}
    for k in range(n):
        fits = {b: s["left"] for b, s in state.items() if s["left"] >= lengths[k]
                and (sources[k] is None or sources[k] not in s["s"]) and (clusters[k] is None or clusters[k] not in s["c"])}
        b = int(bins[k])
        if fits:
            assert fits.get(b) == min(fits.values())
        else:
            assert b not in state
            state[b] = {"left": cap, "s": set(), "c": set()}
        assert offsets[k] == cap - state[b]["left"]
        state[b]["left"] -= lengths[k]
        state[b]["s"].add(sources[k])
        state[b]["c"].add(clusters[k])


def check_packed(rows, texts, sources, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.bin_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [k * capacity for k in range(len(own))]
        assert sum(r.length for r in own) == len((texts[i] or "").encode())
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.length))
        assert held[0].bin_used == sum(r.length for r in held) <= capacity
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.length
        if len(held) > 1:
            known = [sources[r.doc_id] for r in held if sources[r.doc_id] is not None]
            assert len(known) == len(set(known))
            bodies = [re.sub("[\x20\x09-\x0d]+", " ", texts[r.doc_id] or "") for r in held]
            assert len(bodies) == len(set(bodies))


def test_pack_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    check_packed(registry.op1_best_fit_packing(spark, SF01).collect(), {r.doc_id: r.text for r in docs}, {r.doc_id: r.source for r in docs}, packing.CAPACITY)


def test_pack_awkward(spark):
    texts = ["", None, "a" * 40, "b" * 20, "b" * 20, "c" * 19, "é" * 30, "d", ""]
    sources = [None, None, "s", "s", "t", None, "u", "s", "v"]
    rows = packing.pack(frame(spark, texts, sources=sources), capacity=20, shard_rows=3).collect()
    check_packed(rows, dict(enumerate(texts)), dict(enumerate(sources)), 20)
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, ["a", "a", "b"], [1, 1, None])).count() == 3


# ---------------------------------------------------------------------- top-k

def brute_top(rows, every, k):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i % every == 0}.items():
        w = lambda a: np.pad(a, (0, 64 - len(a)))
        best = sorted(((-int(w(v) @ w(x)), i) for i, x in good if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def got_top(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_top_k_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    assert got_top(registry.op4_topk_search(spark, SF01)) == brute_top(rows, 50, 5)


def test_top_k_shards_ties_and_awkward_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 0.5]) for _ in range(8)]) for i in range(400)]
    rows += [(500, None), (501, []), (550, [float("nan")] * 8), (600, [None] * 8), (601, [float("inf")] * 8), (None, [0.5] * 8), (650, [0.5, 0.5]), (700, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, shard string, v string")
    assert got_top(topk.top_k(df, shard_rows=60, query_rows=3)) == brute_top(rows, 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0
    assert got_top(topk.top_k(df.filter("vec_id in (0, 1, 2)"))) == brute_top(rows[:3], 50, 5)


@pytest.mark.parametrize("seed", range(6))
def test_max_score_keeps_every_vector_that_can_win(seed):
    rng = np.random.default_rng(seed)
    for dim, n in ((2, 40), (6, 300), (32, 200)):
        rows = rng.integers(-60, 60, (n, dim)) * (rng.random((n, dim)) < rng.choice([0.3, 0.9]))
        rows[: n // 10] *= 8  # a few strong vectors make high thresholds
        shard = topk.Shard(np.arange(n), rows.astype(np.int64))
        for q in rows[:: 7].astype(np.int64):
            near, score = shard.best(q, -1, 5)
            best = np.lexsort((near, -score))[:5]
            full = rows @ q
            want = np.lexsort((np.arange(n), -full))[:5]
            assert near[best].tolist() == want.tolist() and score[best].tolist() == full[want].tolist()


def test_simhash_links_one_bit_apart_in_a_crowd(spark):
    # 6 and 7 are one bit apart, but 2 is the smallest holder of point 6 and 5 of point 7
    prints = [2, 5, 6, 7]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bucket=1, max_bits=1).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() == 1}


def test_topk_scores_large_components_exactly_or_raises(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [70000.0, 1.0]), (2, [90000.0, 1.0]), (3, [-80000.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, schema), every=50, k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [
        (2, 90000 * 256 * 256), (1, 70000 * 256 * 256), (3, -80000 * 256 * 256)]
    for large in (1e15, 1e300):
        with pytest.raises(Exception, match="too large"):
            topk.top_k(spark.createDataFrame([*rows, (50, [large, 0.0]), (4, [large, 0.0])], schema), every=50, k=3).collect()


def test_simhash_links_broadcast_no_exploded_rows(spark, monkeypatch):
    """The fingerprints are below the broadcast threshold, their 66 keys and 65 neighbours each are not."""
    rng = random.Random(7)
    prints = [rng.getrandbits(62) for _ in range(300)]
    prints += [prints[0] ^ (1 << i) for i in range(40)] + [p ^ 1 for p in prints[1:50]]
    plans = []

    def watched(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    monkeypatch.setattr(simhash, "stored", watched)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(24 * len(prints) + 2000))
    try:
        links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
        links.collect()
    finally:
        spark.conf.set(key, before)
    plans.append(links._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in plans)
