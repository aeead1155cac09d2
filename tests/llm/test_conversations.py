import hashlib
import heapq
import os
import random
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF001  # noqa: E402
from thawline.llm import conversations, registry  # noqa: E402

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, n long, digest string, fault string, known string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "x", "x", c) for *r, c in rows], SCHEMA)


def damage(rows):
    """The contract's damage in plain Python: rows of (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        draw = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows):
    """Least (cost, audit) by a search over whole edit strings (Dijkstra); rows of (role, text, fault)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, kept = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (k, state) in done:
            continue
        done.add((k, state))
        turn = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        heapq.heappush(heap, (cost + 5, audit + "I", k, turn[0], (*kept, f"{turn}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, step[state][role[:1]], (*kept, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, turn[0], (*kept, f"{turn}:{text}")))
    raise AssertionError


def brute(rows, every=None):
    """Report per conversation of rows (conv, turn, role, text); ``every`` lists further conversation ids."""
    groups = {c: [] for c in (every or [])}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, some in groups.items():
        some.sort(key=lambda r: r[:4])
        seen, faults = set(), []
        for _, _, role, _, text in some:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in some if r[0]]
        initials = [r[2][:1] for r in some]
        cost, audit, kept = cheapest([(r[2], r[4], f) for r, f in zip(some, faults)])
        assert legal("".join(x[:1] for x in kept))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def chats(rng, n, most=14):
    rows = []
    for conv in range(n):
        for k in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None])
            text = rng.choice(["Yes.", "No!", "What?", "cut", "é…", " \t\n", "", "Ok. \x0b", "line. ", "line.\x85", "..", None, f"{rng.random()}."])
            rows.append((conv, rng.choice([k, k, k + 3, None]), role, text, 1))
    return rows


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_equal_to_brute_force(spark, parts):
    rows = chats(random.Random(6), 150)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(conversations.report(frame(spark, rows))) == brute([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_conversation_over_many_partitions(spark):
    """Half of all rows are one conversation, with long runs; its blocks give what one pass gives."""
    rng = random.Random(8)
    rows = chats(rng, 30)
    hot = []
    for k in range(300):
        role, text = (("user", f"{k}.") if (k // 40) % 3 == 0 else ("assistant", f"{k}") if (k // 40) % 3 == 1 else (rng.choice(["user", "system"]), rng.choice(["a.", "", f"{k}!"])))
        hot.append((99, k, role, text, 1))
    rows += hot + hot[:20] + [(99, 5, "user", "a.", 1)] * 40
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows)
        assert got(conversations.report(df)) == brute([r[:4] for r in rows])
        told = {r.conv_id: r for r in conversations.report(df).collect()}
        lines = {}
        for r in sorted(conversations.repaired(df).collect(), key=lambda r: (r.conv_id, r.place)):
            lines.setdefault(r.conv_id, []).append((f"{r.role}:{r.text}", r.edit))
        for conv, r in told.items():
            mine = lines.get(conv, [])
            assert hashlib.sha256("\n".join(x for x, _ in mine).encode()).hexdigest() == r.repaired_sha256
            assert "".join(e for _, e in mine) == r.audit.replace("D", "")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_awkward_rows(spark):
    rows = [(None, None, None, None, 1), (None, 2, "user", "Hi.", 1), (1, None, "user", "a.", 1), (1, 5, "assistant", "b.", 1), (2, 3, "user", "x" * 300_000 + ".", 1),
            (3, 1, "user", "gone.", 0), (4, 1, "system", "s.", 1), (5, 9, "assistant", "late.", 1), (5, -3, "user", "early.", 1), (6, 1, "user", "same.", 3)]
    want = brute([r[:4] for r in rows for _ in range(r[4])], every=[3])
    assert got(conversations.report(frame(spark, rows), copies="copies")) == want
    assert want[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(conversations.report(frame(spark, []))) == {}


def test_run_powers_equal_single_rows():
    solver = conversations.Solver()
    rng = random.Random(2)
    for _ in range(200):
        rows = [rng.randrange(9) for _ in range(rng.randint(1, 5)) for _ in range(1)]
        runs = tuple((s, rng.choice([1, 2, 3, 7, 100, 129])) for s in rows)
        plain = tuple((s, 1) for s, n in runs for _ in range(n))
        assert solver.audit(runs) == solver.audit(plain) and solver.matrix(list(runs)) == solver.matrix(list(plain))


def test_query_equals_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    assert got(registry.op12_conversation_repair(spark, SF001)) == brute(damage(rows), every={r[0] for r in rows})
