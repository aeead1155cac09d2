import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF01, frame, texts_of  # noqa: E402
from thawline.llm import registry, suffix_dedup, suffix_sort  # noqa: E402


def brute(texts, span):
    """(n_bytes, n_removed, n_spans, kept) per text from a table of every window."""
    seen = {}
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for i in range(len(b) - span + 1):
            w = b[i:i + span]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))]


def planted(rng, n, shared, length=160, alphabet="abc"):
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(length) for _ in range(shared)]
    texts = []
    for _ in range(n):
        t = word(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            i = rng.randint(0, 60)
            t += p[i:i + rng.randint(20, length)] + word(rng.randint(0, 30))
        texts.append(t)
    return texts


@pytest.mark.parametrize("limits", [{}, {"group": 1}, {"group": 3}, {"chunk": 100, "block_rows": 10}, {"chunk": 45, "group": 3}])
def test_repeats_of_every_kind(spark, limits):
    rng = random.Random(11)
    texts = planted(rng, 120, 4) + ["", None, "x" * 300, "ab" * 200, "é" * 90, "short"]
    texts += texts[:9] + [texts[3] + "!" + texts[3]]
    assert got(suffix_dedup.suffix_dedup(frame(spark, texts), span=40, **limits)) == brute(texts, 40)


def test_near_copies_with_many_small_edits(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") for _ in range(700)]
    texts = []
    for _ in range(60):
        t = base[:]
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    for limits in ({}, {"group": 4}):
        assert got(suffix_dedup.suffix_dedup(frame(spark, texts), span=100, **limits)) == brute(texts, 100)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(90))
    texts, ids = [text, text, "q" + text[:50], text[5:60] + "zz", "lonely " * 3], [5, 5, 6, None, 7]
    rows = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0]))
    assert got(suffix_dedup.suffix_dedup(frame(spark, texts, ids), span=40)) == brute([t for _, t in rows], 40)
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def colliding_pair(rng):
    """Two different texts of 400 bytes with equal polynomial hashes: signs s with sum(s[i] * BASE**i) = 0 modulo 2**64, by pairwise matching of eight lists."""
    power = suffix_sort.powers(suffix_sort.BASE, 400)
    lists = []
    for k in range(8):
        signs = rng.integers(-1, 2, size=(1 << 17, 25), dtype=np.int64)
        at = 200 + 25 * k
        lists.append((signs.view(np.uint64) @ power[at:at + 25], [signs]))

    def joined(a, b, bits, shift):
        low = lambda x: (x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        order = np.argsort(low(b[0]), kind="stable")
        keys, want = low(b[0])[order], (np.uint64(0) - low(a[0])) & np.uint64((1 << bits) - 1)
        first = np.searchsorted(keys, want)
        found = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == want)
        other = order[first[found]]
        return a[0][found] + b[0][other], [x[found] for x in a[1]] + [x[other] for x in b[1]]
    for bits, shift in ((16, 0), (16, 16), (32, 32)):
        lists = [joined(a, b, bits, shift) for a, b in zip(lists[::2], lists[1::2])]
    total, signs = lists[0]
    s = next(r for r in np.concatenate(signs, axis=1)[total == 0] if r.any())
    head = bytes(rng.integers(97, 123, size=200, dtype=np.uint8))
    return head + bytes(np.where(s > 0, 98, 97).astype(np.uint8)), head + bytes(np.where(s < 0, 98, 97).astype(np.uint8))


def test_texts_whose_hashes_collide_are_not_repeats(spark):
    one, two = colliding_pair(np.random.default_rng(1))
    sums = [suffix_sort.Hashes(np.frombuffer(t, dtype=np.uint8)).sums[-1] for t in (one, two)]
    assert one != two and sums[0] == sums[1]
    texts = [one.decode(), two.decode(), two.decode() + one.decode()]
    assert got(suffix_dedup.suffix_dedup(frame(spark, texts[:2]))) == brute(texts[:2], 400)
    assert got(suffix_dedup.suffix_dedup(frame(spark, texts))) == brute(texts, 400)


def test_long_text_in_stretches(spark):
    """Texts over one stretch, with repeats over its edge; 400-byte windows."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(1500)
    long = noise((1 << 20) - 700) + passage + noise(300_000) + passage[200:900] + noise(50)
    texts = [long, noise(100) + passage[:450] + noise(100), noise(20) + passage[900:] + "é" * 300, "x" * 5000]
    assert got(suffix_dedup.suffix_dedup(frame(spark, texts))) == brute(texts, 400)


def test_many_runs_in_one_text(spark):
    """Thousands of removed runs of one text: the merge is a sort, not a growing list."""
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    part = noise(40)
    text = "".join(part + noise(60) for _ in range(3000))
    assert got(suffix_dedup.suffix_dedup(frame(spark, [text]), span=40)) == brute([text], 40)


def test_planted_passages_go_by_bytes_not_words(spark):
    """Passages of 60 words: those of 400 bytes go, those of 399 stay; n_bytes is of the whole text."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts, want = [], []
    for n in (373, 399, 400, 401, 480):
        passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
        passage += "".join(rng.choice("abcdefgh") for _ in range(n - len(passage)))
        assert len(passage.split()) == 60 and len(passage) == n
        for a, z in ("<>", "[]"):
            head = noise(rng.randint(0, 900)) + a
            texts.append(head + passage + z + noise(500))
            want.append([(len(head), len(head) + n)] if n >= 400 else [])
    texts += [noise(1500), noise(700)]
    want += [[], []]
    rows = sorted(suffix_dedup.suffix_dedup(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [[tuple(run) for run in r.removed] for r in rows] == want
    assert [r.n_bytes for r in rows] == [len(t) for t in texts]
    assert [r.n_removed for r in rows] == [sum(b - a for a, b in runs) for runs in want]
    assert got(suffix_dedup.suffix_dedup(frame(spark, texts))) == brute(texts, 400)


def test_table(spark):
    texts = texts_of(spark, SF01)
    assert got(registry.op10_suffix_dedup(spark, SF01)) == brute([texts[i] for i in sorted(texts)], 400)


def test_merge_sort_by_hash_comparisons():
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), dtype=np.uint8)
    start = np.array([rng.randrange(2800) for _ in range(500)])
    length = np.array([rng.randint(0, 150) for _ in range(500)])
    raw = data.tobytes()
    texts = [raw[s:s + n] for s, n in zip(start, length)]
    order, lcp = suffix_sort.sorted_suffixes(suffix_sort.Hashes(data), start, length)
    assert [texts[i] for i in order] == sorted(texts)
    assert all(lcp[i] == len(os.path.commonprefix([texts[order[i - 1]], texts[order[i]]])) for i in range(1, 500))
    assert order.tolist() == sorted(range(500), key=lambda i: texts[i])  # stable


def test_colliding_hashes_are_caught():
    data = np.frombuffer(b"banana bandana cabana", dtype=np.uint8)
    hashes = suffix_sort.Hashes(data)
    hashes.sums[:] = 0  # every hash equal
    start, length = np.arange(15), np.full(15, 6)
    order, lcp = suffix_sort.sorted_suffixes(hashes, start, length)
    raw = data.tobytes()
    texts = [raw[s:s + 6] for s in start]
    assert [texts[i] for i in order] == sorted(texts)
