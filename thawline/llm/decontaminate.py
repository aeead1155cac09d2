"""Benchmark decontamination by suffix arrays of the training documents.

Words are lower-cased ``[0-9A-Za-z]`` and all characters beyond ASCII; anything
else parts them. A window is ``WINDOW`` consecutive words of a test item; an
item of fewer words, but not none, is one window. A document word inside an
occurrence of a window is hit.

Documents stay where they are read. Each task cuts its texts into shards of
about ``CHUNK`` bytes and for each one

1. names its words by the test vocabulary (a word outside it ends every match),
2. builds the suffix array of the suffixes that start with enough vocabulary
   words to hold a window, ordered by their first ``WINDOW`` words,
3. binary-searches every distinct test suffix in it (all at once); the found
   ranges of the array are the locations of its window, compared byte by byte
   before they count,
4. finds for each location the longest verbatim match: its text is
   binary-searched in the sorted suffixes of the test items, and the common
   extension with both neighbours is measured by prefix hashes.

Texts over ``CHUNK`` bytes go piece by piece; pieces overlap by as many words as
the longest item has, so that no match is cut.

The test items travel to the tasks in blocks of at most ``BLOCK_BYTES`` of text
(or one longer item); more items mean more passes over the documents, which
carry their hits along. Nothing else is broadcast, and nothing is shuffled.

Defined cases: null and empty texts have no words and are not contaminated; an
item without words matches nothing; rows that repeat an item_id are one item
with several texts; a null item_id counts as the empty id; items with equal
texts all count; rows that repeat a doc_id stand for themselves; without items
or documents the result has no hits or no rows; other columns, whatever their
names, are ignored by ``matches`` and kept by ``decontaminate``; a word longer
than a piece keeps its piece whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, text_of
from .suffix_sort import Hashes, sorted_suffixes

WINDOW = 10
CHUNK = 4 << 20
BLOCK_BYTES = 4 << 20
#: Rows of test windows whose items are remembered per task.
CACHE = 100_000

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = (_BYTES >= 128) | ((LOWER >= ord("a")) & (LOWER <= ord("z"))) | ((_BYTES >= ord("0")) & (_BYTES <= ord("9")))


class Words:
    """Words of byte texts laid end to end, each word followed by one blank."""

    def __init__(self, texts: list) -> None:
        data = np.frombuffer(b"".join(x for t in texts for x in (t, b" ")) or b" ", dtype=np.uint8)
        inside = IS_WORD[data]
        closes = np.zeros(len(data), dtype=bool)
        closes[1:] = inside[:-1] & ~inside[1:]
        keep = inside | closes
        self.bytes = np.where(inside, LOWER[data], np.uint8(32))[keep]
        self.stop = np.flatnonzero(self.bytes == 32)
        self.start = np.append(0, self.stop + 1)[:-1]
        # words of each text: the closing blanks that fall into it
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if len(texts) else np.zeros(0, dtype=np.int64)
        self.bound = np.append(0, np.searchsorted(np.flatnonzero(closes), ends))  # word numbers where texts end


class Items:
    """The test items of one block: vocabulary, distinct windows, sorted suffixes."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        words = Words([t for _, t in items])
        self.window, self.bytes = window, words.bytes
        n = np.diff(words.bound)
        self.reach = int(n.max(initial=0))
        sums = Hashes(words.bytes)
        named = sums.of(words.start, words.stop - words.start)
        self.vocabulary, symbol = np.unique(named, return_inverse=True)
        raw = words.bytes.tobytes()
        ids: dict[bytes, set] = {}
        place: dict[bytes, tuple[int, int]] = {}
        for k, (item, _) in enumerate(items):
            size = min(window, int(n[k]))
            for w in range(words.bound[k], words.bound[k + 1] - size + 1) if size else ():
                text = raw[words.start[w]:words.stop[w + size - 1]]
                ids.setdefault(text, set()).add(item)
                place.setdefault(text, (w, size))
        self.text, self.ids = list(ids), [sorted(v) for v in ids.values()]
        at = np.array([place[t] for t in self.text], dtype=np.int64).reshape(-1, 2)
        self.size = at[:, 1]
        self.least = int(self.size.min(initial=window))
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = 64 // self.bits
        symbol = np.append(symbol.astype(np.uint64) + np.uint64(1), np.zeros(window, dtype=np.uint64))
        self.low = self.packed(symbol, at[:, 0], self.size)
        self.high = self.packed(symbol, at[:, 0], self.size, fill=True)
        # sorted suffixes that start at words, each up to the end of its item
        limit = np.append(words.stop, 0)[np.repeat(words.bound[1:], n) - 1] + 1
        order, _ = sorted_suffixes(sums, words.start, limit - words.start) if len(words.start) else (np.zeros(0, dtype=np.int64), None)
        self.suffix, self.suffix_size = words.start[order], (limit - words.start)[order]

    def packed(self, symbol: np.ndarray, start: np.ndarray, size: np.ndarray, fill: bool = False) -> list[np.ndarray]:
        """The first ``window`` symbols from each start, a few to a 64-bit number; beyond ``size`` zeros, or ones."""
        out, last = [], np.uint64((1 << self.bits) - 1)
        for k in range(0, self.window, self.per):
            key = np.zeros(len(start), dtype=np.uint64)
            for j in range(k, min(k + self.per, self.window)):
                here = np.where(j < size, symbol[np.minimum(start + j, len(symbol) - 1)], last if fill else np.uint64(0))
                key = (key << np.uint64(self.bits)) | here
            out.append(key)
        return out


def _bisect(array: list[np.ndarray], keys: list[np.ndarray], right: bool) -> np.ndarray:
    """Places of ``keys`` in the suffix array, whose rows are compared number by number."""
    n, m = len(array[0]), len(keys[0])
    low, high = np.zeros(m, dtype=np.int64), np.full(m, n, dtype=np.int64)
    while (low < high).any():
        open_ = low < high
        mid = np.where(open_, (low + high) >> 1, 0)
        less, same = np.zeros(m, dtype=bool), np.ones(m, dtype=bool)
        for a, k in zip(array, keys):
            there = a[mid]
            less |= same & (there < k)
            same &= there == k
        ahead = open_ & ((less | same) if right else less)
        low, high = np.where(ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


class Shard:
    """Suffix array of the words of some texts, over the suffixes that can hold a window."""

    def __init__(self, texts: list, items: Items) -> None:
        self.items = items
        self.words = w = Words(texts)
        self.n = len(w.start)
        data = np.concatenate([w.bytes, items.bytes])
        self.hashes = Hashes(data)
        named = self.hashes.of(w.start, w.stop - w.start)
        at = np.minimum(np.searchsorted(items.vocabulary, named), max(len(items.vocabulary) - 1, 0))
        known = items.vocabulary[at] == named if len(items.vocabulary) else np.zeros(self.n, dtype=bool)
        symbol = np.where(known, at + 1, 0).astype(np.uint64)
        self.end = np.repeat(w.bound[1:], np.diff(w.bound))
        strange = np.where(known, self.n, np.arange(self.n))
        run = np.minimum(np.minimum.accumulate(strange[::-1])[::-1], self.end) - np.arange(self.n)
        start = np.flatnonzero(run >= items.least)
        keys = items.packed(symbol, start, run[start]) if len(start) else [np.zeros(0, dtype=np.uint64)]
        order = np.lexsort(keys[::-1])
        self.array, self.keys = start[order], [k[order] for k in keys]

    def locations(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, word): every occurrence of every window, verified on its bytes."""
        items = self.items
        none = np.zeros(0, dtype=np.int64)
        if not len(self.array) or not items.text:
            return none, none
        first, last = _bisect(self.keys, items.low, False), _bisect(self.keys, items.high, True)
        count = np.maximum(last - first, 0)
        window = np.repeat(np.arange(len(count)), count)
        word = self.array[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        a, b = self.words.start[word], self.words.stop[word + items.size[window] - 1]
        raw, text = self.words.bytes.tobytes(), items.text
        fine = np.fromiter((raw[i:j] == text[k] for i, j, k in zip(a.tolist(), b.tolist(), window.tolist())), dtype=bool, count=len(window))
        return window[fine], word[fine]

    def longest(self, word: np.ndarray) -> np.ndarray:
        """Words of the longest verbatim match of a window or more with any test item from each word on, or 0."""
        items, offset = self.items, len(self.words.bytes)
        a = self.words.start[word]
        size = self.words.stop[self.end[word] - 1] + 1 - a
        suffix, length = items.suffix + offset, items.suffix_size
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), len(suffix), dtype=np.int64)
        while (low < high).any():
            mid = np.minimum((low + high) >> 1, len(suffix) - 1)
            ahead = (low < high) & self.hashes.less(suffix[mid], length[mid], a, size)
            low, high = np.where(ahead, mid + 1, low), np.where((low < high) & ~ahead, mid, high)
        best, raw = np.zeros(len(a), dtype=np.int64), self.hashes.data.tobytes()
        for near in (low - 1, low):
            fine = (near >= 0) & (near < len(suffix))
            k = np.clip(near, 0, len(suffix) - 1)
            common = np.where(fine, self.hashes.common(a, suffix[k], np.minimum(size, length[k])), 0)
            for j, (x, y, c) in enumerate(zip(a.tolist(), suffix[k].tolist(), common.tolist())):
                if raw[x:x + c] != raw[y:y + c]:  # hashes met by accident
                    common[j] = len(commonprefix([raw[x:x + c], raw[y:y + c]]))
            n = np.searchsorted(self.words.stop, a + common) - word
            best = np.maximum(best, np.where(n >= items.window, n, 0))  # less than a window is no match
        return best


def _pieces(text: memoryview, chunk: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(from, own end, to): stretches that own their words and look ``reach`` words further."""
    n, lo = len(text), 0

    def gap(at: int) -> int:
        while at < n:
            part = ~IS_WORD[np.frombuffer(text[at:at + 4096], dtype=np.uint8)]
            if part.any():
                return at + int(part.argmax())
            at += 4096
        return n
    while lo < n or lo == 0:
        own = gap(lo + chunk) if n - lo > chunk else n
        to, step = own, 64 * (reach + 1)
        while to < n:
            to = gap(min(n, own + step))
            inside = IS_WORD[np.frombuffer(text[own:to], dtype=np.uint8)]
            if int((inside[:-1] & ~inside[1:]).sum()) >= reach:
                break
            step *= 2
        yield lo, own, to
        lo = own
        if own >= n:
            return


def _shards(texts: list, chunk: int, reach: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (row, from, own end, to) of about ``chunk`` bytes."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for lo, own, to in _pieces(text, chunk, reach):
            held.append((row, lo, own, to))
            size += to - lo
            if size >= chunk:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word intervals per row; touching intervals join."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # a running maximum per row: rows are told apart by an offset larger than any place
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + row * wide)
    fresh = np.append(True, (start[1:] + row[1:] * wide > reach[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - row[last] * wide


def _lists(n: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column: ``values`` in order of ``row``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _search(items: Items, chunk: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        for batch in batches:
            n = batch.num_rows
            body = batch.column("body")
            texts = [memoryview(x.as_buffer()) for x in body]
            n_words, longest = np.zeros(n, dtype=np.int64), batch.column("longest").to_numpy(zero_copy_only=False).copy()
            old = batch.column("starts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [np.repeat(np.arange(n), old)]
            starts, stops = [batch.column("starts").flatten().to_numpy().astype(np.int64)], [batch.column("stops").flatten().to_numpy().astype(np.int64)]
            seen: dict[int, set] = {}
            for group in _shards(texts, chunk, items.reach):
                shard = Shard([texts[r][lo:to] for r, lo, _, to in group], items)
                row = np.array([g[0] for g in group])
                first = shard.words.bound[:-1]
                # words that a piece owns; those beyond are the next piece's
                owned = np.diff(shard.words.bound)
                for k, (r, lo, own, to) in enumerate(group):
                    if to > own:
                        inside = IS_WORD[np.frombuffer(texts[r][own:to], dtype=np.uint8)]
                        owned[k] -= int((inside[:-1] & ~inside[1:]).sum()) + int(inside[-1])
                base = np.zeros(len(group), dtype=np.int64)
                for k, r in enumerate(row.tolist()):
                    base[k] = n_words[r]
                    n_words[r] += owned[k]
                window, word = shard.locations()
                if not len(window):
                    continue
                piece = np.searchsorted(shard.words.bound, word, side="right") - 1
                begin = word - first[piece] + base[piece]
                rows.append(row[piece])
                starts.append(begin)
                stops.append(begin + items.size[window])
                places, back = np.unique(word, return_inverse=True)
                np.maximum.at(longest, row[piece], np.maximum(items.size[window], shard.longest(places)[back]))
                pairs = np.unique(row[piece] * len(items.text) + window)
                owner, of = pairs // len(items.text), pairs % len(items.text)
                cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for r, some in zip(owner[cut].tolist(), np.split(of, cut[1:])):
                    key = some.tobytes()
                    if key not in known:
                        if len(known) >= CACHE:
                            known.clear()
                        known[key] = sorted({i for v in some.tolist() for i in items.ids[v]})
                    seen.setdefault(r, set()).update(known[key])
            row, start, stop = _runs(np.concatenate(rows), np.concatenate(starts), np.concatenate(stops))
            found = batch.column("items").to_pylist()
            for r, more in seen.items():
                found[r] = sorted(more | set(found[r]))
            new = {"n_words": pa.array(n_words), "longest": pa.array(longest.astype(np.int64)), "starts": _lists(n, row, pa.array(start.astype(np.int64))),
                   "stops": _lists(n, row, pa.array(stop.astype(np.int64))), "items": pa.array(found, type=pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], names=columns)
    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The test items in blocks of about ``block_bytes``, one in the driver at a time, and whether it is the last."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct().collect()
        yield [(r["id"], r["text"].encode()) for r in sorted(part, key=lambda r: (r["id"], r["text"]))], b + 1 == blocks


def _passes(rows: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int, chunk: int, block_bytes: int) -> DataFrame:
    """``rows`` (first column and a binary ``body``) as the first column and the hits of all items."""
    small_batches(rows.sparkSession)
    empty = lambda t: F.array().cast(f"array<{t}>")
    state = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"),
                        empty("bigint").alias("starts"), empty("bigint").alias("stops"), empty("string").alias("items"))
    for block, last in _blocks(items, id_col, text_col, block_bytes):
        # the last pass does not send the texts back
        schema = StructType([f for f in state.schema if not (last and f.name == "body")])
        state = state.mapInArrow(_search(Items(block, window), chunk, schema.names), schema)
    return state


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
            window: int = WINDOW, chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, items, runs.

    ``longest`` is the longest verbatim match in words that starts with a window, ``runs``
    lists the hit words as maximal runs (from, to) of word numbers, ``to`` exclusive."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("body"))
    found = _passes(rows, items, item_id_col, item_text_col, window, chunk, block_bytes)
    runs = F.zip_with("starts", "stops", lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
                        "longest", "items", runs.alias("runs"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, all columns as they were."""
    whole = docs.select(F.struct("*").alias("row")).select("row", text_of(f"row.{text_col}").cast("binary").alias("body"))
    found = _passes(whole, items, item_id_col, item_text_col, window, chunk, block_bytes)
    return found.filter(F.size("starts") == 0).select("row.*")
