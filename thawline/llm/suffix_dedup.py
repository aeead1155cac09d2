"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when it lies in a ``SPAN`` = 400-byte string that also starts
anywhere else. Sorting every suffix of a corpus would move each byte many
times; here only suffixes that can have a partner are sorted:

1. Anchors. Of the 201 200-byte strings in every 400-byte window the one
   with the smallest hash is an anchor. Equal windows have equal anchors at
   equal places, so each repeated window holds an anchor whose hash occurs
   twice. An anchor row carries a digest of its context: up to 200 bytes
   before it and 400 from it.
2. Anchors with a hash that occurs once leave. A context that occurs twice
   under the same anchor is repeated as a whole; its rows need no text.
   Contexts are compared by 128 bits of their SHA-256, which no two different
   ones are known to share, not by the polynomial hashes.
3. What is left are contexts that occur once beside others with the same
   anchor: the ends of repeated regions. One row per distinct context fetches
   its bytes, and blocks of anchors go to tasks. A task merge-sorts the
   suffixes that start at its anchors by hash comparisons; the common
   extensions of neighbours in the sorted order tell, for each distance of a
   window from its anchor, which suffixes share the part from the anchor, and
   hashes which share the part before it. The farthest repeated windows to
   either side bound the bytes that repeat around the anchor.
4. Anchors with over ``GROUP`` such contexts never meet in a task: their
   windows are counted by a partial aggregate over the SHA-256 of their bytes.

Polynomial hashes only propose: equal ones that differ in their bytes cost work,
never a byte. Everything decided in step 3 is verified on the bytes.

Defined cases: null text is empty; texts under 400 bytes lose nothing; rows
that repeat a doc_id stand for themselves, so two rows with the same text
of 400 bytes or more lose all of it; null ids stay; an empty table gives an empty
result; other columns are ignored; long texts are read in stretches of ``CHUNK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, stored, text_of
from .suffix_sort import Hashes, sorted_suffixes

SPAN = 400
GROUP = 20_000
BLOCK_ROWS = 12_000
#: Bytes hashed at once in a task; longer texts go piece by piece.
CHUNK = 1 << 20
ANCHORS = "doc_id long, digest long, pos int, lf int, rt int, h long, c long, d long"


def _sliding(values: np.ndarray, width: int, pick, neutral) -> np.ndarray:
    """pick over values[i:i + width] for every i, in three passes (blocks of ``width``)."""
    n = len(values)
    pad = -(-n // width) * width + width - n
    wide = np.concatenate([values, np.full(pad, neutral, dtype=values.dtype)])
    rows = wide.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1:width - 1 + n])


def _digest(context: memoryview, left: int) -> bytes:
    out = sha256(context)
    out.update(b"%d" % left)
    return out.digest()[:16]


class Finder:
    """Anchors of texts laid end to end."""

    def __init__(self, span: int = SPAN) -> None:
        self.span, self.gram = span, span // 2
        self.window = span - self.gram + 1  # places of a gram in a window

    def __call__(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Anchors in [begin, end) of pieces data[lo:hi] whose windows start in [first, last).

        Returns (piece, place, left, right, gram hash, two halves of the context's digest)."""
        n, window, gram = len(data), self.window, self.gram
        one = Hashes(data)
        h = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        if n >= gram:
            g = (one.sums[gram:] - one.sums[:-gram]) * one.inverse[:n - gram + 1]
            g ^= g >> np.uint64(32)
            h[:n - gram + 1] = g * np.uint64(0xD6E8FEB86659FD93)
        edge = np.zeros(n + 1, dtype=np.int8)
        np.add.at(edge, first[first < last], 1)
        np.add.at(edge, last[first < last], -1)
        valid = np.cumsum(edge[:n]) > 0
        least = np.where(valid, _sliding(h, window, np.minimum, np.iinfo(np.uint64).max), np.uint64(0))
        # a place is an anchor if it is the least of some valid window that holds it
        shifted = np.concatenate([np.zeros(window - 1, dtype=np.uint64), least])
        most = _sliding(shifted, window, np.maximum, np.uint64(0))[:n]
        at = np.flatnonzero((most == h) & (most > 0))
        piece = np.searchsorted(lo, at, side="right") - 1
        own = (at >= begin[piece]) & (at < end[piece])
        at, piece = at[own], piece[own]
        left = np.minimum(at - lo[piece], self.span - gram)
        right = np.minimum(hi[piece] - at, self.span)
        raw = memoryview(data)
        # the place in the context belongs to it
        digests = b"".join(_digest(raw[a - b:a + c], b) for a, b, c in zip(at.tolist(), left.tolist(), right.tolist()))
        c = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
        return piece, at, left, right, h[at], c[:, 0], c[:, 1]


def _pieces(lengths: np.ndarray, span: int, chunk: int) -> Iterator[list[tuple]]:
    """Chunks of (row, from, to, windows from, to, anchors from, to), places in the text.

    A piece of a long text owns the anchors of its stretch and sees every
    window that holds one of them, so a text's anchors are found once.
    """
    batch, held, half = [], 0, span // 2
    for row, n in enumerate(lengths.tolist()):
        windows = n - span + 1
        for w in range(0, windows, chunk):
            upto = min(w + chunk, windows)
            lo, hi = max(0, w - half), min(n, upto + span)
            batch.append((row, lo, hi, lo, upto, w, n if upto == windows else upto))
            held += hi - lo
            if held >= chunk:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def _find(span: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(span)
        for batch in batches:
            texts = batch.column("body").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
            ids, digests = batch.column("doc_id"), batch.column("digest")
            for group in _pieces(np.diff(offsets), span, chunk):
                row, lo, hi, w0, w1, a0, a1 = map(np.array, zip(*group))
                size = hi - lo
                base = np.concatenate([[0], np.cumsum(size)])[:-1]
                joined = np.concatenate([data[offsets[r] + a:offsets[r] + b] for r, a, b in zip(row, lo, hi)])
                piece, at, left, right, h, c, d = finder(joined, base, base + size, *(base + x - lo for x in (w0, w1, a0, a1)))
                take = pa.array(row[piece])
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), digests.take(take), pa.array((at - base[piece] + lo[piece]).astype(np.int32)), pa.array(left.astype(np.int32)),
                    pa.array(right.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.ascontiguousarray(c)), pa.array(np.ascontiguousarray(d))],
                    names=["doc_id", "digest", "pos", "lf", "rt", "h", "c", "d"])
    return run


def anchors(rows: DataFrame, span: int = SPAN, chunk: int = CHUNK) -> DataFrame:
    """Anchors of (doc_id, digest, body); each place of a row once."""
    return rows.withColumn("body", F.col("body").cast("binary")).mapInArrow(_find(span, chunk), ANCHORS)


def _ends(span: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # rows that repeat an id and a text bring the same bytes again
        rows = rows.drop_duplicates(["known", "doc_id", "digest", "pos"]).reset_index(drop=True)
        bodies = rows["body"].tolist()
        size = np.array([len(b) for b in bodies], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        hashes = Hashes(np.frombuffer(b"".join(bodies), dtype=np.uint8))
        lf, rt = rows["lf"].to_numpy().astype(np.int64), rows["rt"].to_numpy().astype(np.int64)
        at = start + lf
        order, lcp = sorted_suffixes(hashes, at, rt)
        left, right, left_of, right_of = _windows(hashes, at, lf, order, lcp, span)
        found = (right > 0) & (rows["n"].to_numpy() == 1)
        for k in np.flatnonzero(found).tolist():
            for o, other in ((left[k], left_of[k]), (span - right[k], right_of[k])):
                mine, its = lf[k] - o, lf[other] - o
                if bodies[k][mine:mine + span] != bodies[other][its:its + span]:
                    _slowly(bodies, lf, rows["h"].to_numpy(), k, left, right, found, span)
                    break
        pos = rows["pos"].to_numpy().astype(np.int64)
        out = rows.loc[found, ["doc_id", "digest"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64").where(rows.loc[found, "known"])
        out["from"], out["to"] = (pos - left)[found], (pos + right)[found]
        return out[["doc_id", "digest", "from", "to"]]
    return run


def _windows(hashes, at, lf, order, lcp, span):
    """Reach of each row's repeated windows to the left and right of its anchor, and a partner for both.

    For each distance of a window's start from the anchor, the part from the
    anchor is named by the suffix's class (neighbours whose common extension is
    long enough), the part before it by its hash.
    """
    left, right = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    left_of, right_of = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    for o in range(span - span // 2 + 1):
        # a suffix too short for its part shares no class: no neighbour extends that far
        near = lcp >= span - o
        shares = near | np.append(near[1:], False)
        pick = np.flatnonzero(shares & (lf[order] >= o))
        if len(pick) < 2:
            continue
        rank, rows = np.cumsum(~near)[pick], order[pick]
        key = hashes.of(at[rows] - o, o) * np.uint64(0x9E3779B97F4A7C15) + rank.astype(np.uint64)
        place = np.argsort(key, kind="stable")
        key, rows = key[place], rows[place]
        twin = np.flatnonzero(key[1:] == key[:-1])
        for x, y in ((rows[twin], rows[twin + 1]), (rows[twin + 1], rows[twin])):
            left[x], left_of[x] = o, y  # distances ascend: the last is the farthest
            new = right[x] == 0
            right[x[new]], right_of[x[new]] = span - o, y[new]
    return left, right, left_of, right_of


def _slowly(bodies, lf, h, k, left, right, found, span) -> None:
    """Two hashes met by accident: this row again, from the bytes."""
    left[k] = right[k] = 0
    mine = bodies[k]
    for j in np.flatnonzero(h == h[k]).tolist():
        if j == k:
            continue
        a, b, x, y = mine[lf[k]:], bodies[j][lf[j]:], mine[:lf[k]][::-1], bodies[j][:lf[j]][::-1]
        r = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        l = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: E741
        if l + r >= span:
            left[k], right[k] = max(left[k], l), max(right[k], r)
    found[k] = right[k] > 0


def _stretches(rows: DataFrame, chunk: int, margin: int) -> DataFrame:
    """(id, known, digest, stretch, low, bytes): each text in overlapping stretches of ``chunk`` bytes."""
    body = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "digest", F.col("body").cast("binary").alias("bytes"))
    last = F.greatest(F.lit(0), (F.octet_length("bytes") - 1)) / chunk
    cut = body.select("*", F.explode(F.sequence(F.lit(0), F.floor(last).cast("int"))).alias("stretch"))
    low = F.greatest(F.lit(0), F.col("stretch") * chunk - margin)
    return cut.select("id", "known", "digest", "stretch", low.alias("low"),
                      F.when(F.octet_length("bytes") <= chunk, F.col("bytes")).otherwise(F.substring("bytes", low + 1, F.lit(chunk + 2 * margin))).alias("bytes"))


def repeated_intervals(rows: DataFrame, span: int = SPAN, group: int = GROUP, chunk: int = CHUNK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, digest, from, to): byte intervals of (doc_id, digest, body) whose union is what repeats."""
    found = stored(anchors(rows, span, chunk), "anchors")
    twice = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors-twice")
    held = stored(found.join(twice, "h", "left_semi"), "anchors-held")
    discard(found)
    one = F.min(F.struct("doc_id", "digest", "pos", "lf", "rt"))
    kinds = stored(held.groupBy("h", "c", "d").agg(F.count("*").alias("n"), one.alias("one")), "contexts")
    whole = kinds.filter(F.expr(f"n > 1 and one.lf + one.rt >= {span}")).select("h", "c", "d")
    done = held.join(whole, ["h", "c", "d"], "left_semi").select(
        "doc_id", "digest", (F.col("pos") - F.col("lf")).cast("long").alias("from"), (F.col("pos") + F.col("rt")).cast("long").alias("to"))
    mixed = stored(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("h", "kinds"), "mixed")
    opened = kinds.join(mixed, "h").select("h", "n", "kinds", F.coalesce("one.doc_id", F.lit(0)).alias("id"), F.col("one.doc_id").isNotNull().alias("known"),
                                           "one.digest", "one.pos", "one.lf", "one.rt", F.floor(F.col("one.pos") / chunk).cast("int").alias("stretch"))
    open_ = stored(opened, "open")
    open_count = open_.count()
    # one text per id and digest, the stretches that are asked for; then each place takes its own bytes
    key = ["id", "known", "digest", "stretch"]
    asked = _stretches(rows, chunk, span).join(open_.select(*key).distinct(), key, "left_semi")
    texts = asked.groupBy(*key).agg(F.first(F.struct("low", "bytes")).alias("text"))
    body = F.substring(F.col("text.bytes"), F.col("pos") - F.col("lf") - F.col("text.low") + 1, F.col("lf") + F.col("rt"))
    fetched = stored(open_.join(texts, key).select(F.col("id").alias("doc_id"), "known", "digest", "h", "n", "kinds", "pos", "lf", "rt", body.alias("body")), "context-bytes")
    few = fetched.filter(F.col("kinds") <= group)
    blocks = max(1, -(-open_count // block_rows))
    ends = (few.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"))
            .applyInPandas(_ends(span), "doc_id long, digest long, `from` long, `to` long"))
    crowd = fetched.filter(F.col("kinds") > group)
    reach = F.sequence(F.greatest(F.lit(0), F.lit(span) - F.col("rt")), F.col("lf"))
    windows = (crowd.filter(F.col("lf") + F.col("rt") >= span).select("*", F.explode(reach).alias("o"))
               .select(F.expr("if(known, doc_id, null)").alias("doc_id"), "digest", "pos", "n", "h", "o", F.unhex(F.sha2(F.substring("body", F.col("lf") - F.col("o") + 1, F.lit(span)), 256)).alias("m")).distinct())
    classes = stored(windows.groupBy("h", "o", "m").agg(F.sum("n").alias("all")).filter("`all` > 1").drop("all"), "window-classes")
    wide = (windows.filter("n = 1").join(classes, ["h", "o", "m"]).groupBy("doc_id", "digest", "pos")
            .agg(F.max("o").alias("most"), F.min("o").alias("least"))
            .select("doc_id", "digest", (F.col("pos") - F.col("most")).cast("long").alias("from"), (F.col("pos") - F.col("least") + span).cast("long").alias("to")))
    return done.unionByName(ends).unionByName(wide)


def _merged(intervals: DataFrame) -> DataFrame:
    """(doc_id, digest, runs): the intervals of each text as maximal runs."""
    before = Window.partitionBy("doc_id", "digest").orderBy("from", "to")
    reach = F.max("to").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("fresh", F.when(F.col("from") <= reach, 0).otherwise(1))
    runs = (fresh.withColumn("run", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "digest", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")))
    return runs.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def _same(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.digest = {b}.digest")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, **limits) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) per row; ``removed`` lists the byte runs."""
    small_batches(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("body"))
    found = stored(repeated_intervals(rows, span, **limits), "repeated")
    runs = stored(_merged(found), "runs")
    joined = (rows.select("doc_id", "digest", F.col("body").cast("binary").alias("bytes")).alias("r")
              .join(runs.alias("s"), _same("r", "s"), "left")
              .select("r.doc_id", "r.bytes", F.coalesce("s.runs", F.array().cast("array<struct<from:bigint,to:bigint>>")).alias("runs")))
    n = F.octet_length("bytes").cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["to"]))
    stops = F.concat(F.transform("runs", lambda r: r["from"]), F.array(n))
    kept = F.unhex(F.array_join(F.zip_with(starts, stops, lambda a, b: F.hex(F.substring(F.col("bytes"), (a + 1).cast("int"), (b - a).cast("int")))), ""))
    return joined.select(
        "doc_id", n.alias("n_bytes"), F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"]).alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"), F.sha2(F.when(F.size("runs") > 0, kept).otherwise(F.col("bytes")), 256).alias("kept_sha256"), F.col("runs").alias("removed"))
