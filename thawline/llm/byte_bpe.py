"""Byte-level BPE encoding and decoding by folds of ranked merges over distinct words.

The rank file becomes a literal table: a pair of adjacent tokens (their ids)
is looked up by its hash in one of two slots and gives the rank of their
concatenation, which is also the id of the merged token. A word is a byte
array; a fold over it keeps the tokens and the ranks of adjacent pairs and
merges the leftmost pair of lowest rank until none is left.

1. All words of all texts are counted. The distinct words that occur at least
   ``t`` times (``t`` is the smallest count that leaves at most ``HOT_WORDS``)
   are folded by Spark's higher-order functions, once each; their number is
   bounded, so they go to every task.
2. Words are cut by Spark's regular expressions and reach a task as Arrow
   lists. Of a batch's words the distinct ones are found first; those without
   an entry are folded by the same ranked merges on lists of ids (the interpreted
   lambdas take over ten times as long for them, see the README). Codes are laid out
   by array gathers. No text and no code is shuffled.

Decoding concatenates the byte pieces of the ids, by the same gather.

Defined cases: null text is empty and has no ids; every row is encoded by
itself, so rows that repeat a doc_id, null ids and other columns change
nothing; an empty table has no frequent words and gives no rows. Words of any
length are folded whole, long ones with a heap.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of

HOT_WORDS = 1 << 17
#: Longer words are not counted: the fold's copies grow with the square of the length.
LONG = 256
WORDS_AT_ONCE = 200_000
NONE = 1 << 17
#: Between the values of a literal table; words that hold it are folded in the task.
SEPARATOR = "\x1f"
SPACE = r"\t-\r\x20\x85\xA0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: public_tokenizers.PATTERN with the white space of Unicode spelt out and possessive repeats.
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the concatenation of two adjacent tokens, by both ids in one number."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    return pairs


def _slots(hashes: list[int], bits: int) -> list[int]:
    """Two-choice placement: for each slot the number of its item, or -1."""
    mask, table = (1 << bits) - 1, [-1] * (1 << bits)
    for item in range(len(hashes)):
        now, at = item, hashes[item] & mask
        for _ in range(500):
            now, table[at] = table[at], now
            if now < 0:
                break
            h = hashes[now]
            at = (h >> 32) & mask if at == (h & mask) else h & mask
        else:
            return _slots(hashes, bits + 1)
    return table


def _bits(n: int) -> int:
    return max(4, (3 * n).bit_length())


def _literal(values: list, kind: str) -> Column:
    """A foldable array of values that never hold the separator; the optimizer turns it into one literal."""
    out = F.split(F.lit(SEPARATOR.join(map(str, values))), SEPARATOR)
    return out if kind == "string" else out.cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


class Vocabulary:
    """Literal tables of a rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import xxhash
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("a pair of ids has to fit 32 bits")
        pairs = pair_ranks(ranks)
        keys = list(pairs)
        table = _slots([xxhash.xxh64_intdigest(struct.pack("<q", k), 42) for k in keys], _bits(len(keys)))
        self.mask = len(table) - 1
        by_rank = {r: t for t, r in ranks.items()}
        size = max(by_rank) + 1
        #: One struct literal; expressions take it as a lambda variable, so a plan holds it once.
        self.tables = F.struct(
            _literal([(keys[i] << 18 | pairs[keys[i]]) if i >= 0 else -1 for i in table], "bigint").alias("pairs"),
            _literal([ranks[bytes([b])] for b in range(256)], "int").alias("bytes"),
            _literal([by_rank.get(i, b"").hex() for i in range(size)], "string").alias("pieces"))

    def rank(self, tables: Column, a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("long"), 16).bitwiseOR(b.cast("long"))
        mask, low = F.lit(self.mask).cast("long"), F.lit(2 * NONE - 1).cast("long")

        def probe(h):
            first = tables["pairs"][h.bitwiseAND(mask).cast("int")]
            second = tables["pairs"][F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int")]
            return (F.when(F.shiftright(first, 18) == key, first.bitwiseAND(low).cast("int"))
                    .when(F.shiftright(second, 18) == key, second.bitwiseAND(low).cast("int")).otherwise(F.lit(NONE)))
        return _let(F.xxhash64(key), probe)

    def merged(self, tables: Column, word: Column) -> Column:
        """array<int>: the ids of a word."""
        hexed = F.hex(F.encode(word, "UTF-8"))
        n = F.octet_length(word)
        first = F.transform(F.sequence(F.lit(0), n - 1), lambda i: tables["bytes"][F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int")])
        none = F.array().cast("array<int>")
        rank = lambda a, b: self.rank(tables, a, b)

        def start(tokens):
            ranks = F.when(F.size(tokens) > 1, F.transform(F.slice(tokens, 1, F.size(tokens) - 1), lambda t, i: rank(t, tokens[i + 1]))).otherwise(none)
            return F.struct(tokens.alias("t"), ranks.alias("r"))

        def step(acc, _):
            t, r = acc["t"], acc["r"]

            def merge(best):
                def at(i):
                    before = F.when(i > 1, F.concat(F.slice(r, F.lit(1), i - 2), F.array(rank(t[i - 2], best)))).otherwise(none)
                    after = F.when(i + 1 < F.size(t), F.concat(F.array(rank(best, t[i + 1])), F.slice(r, i + 2, F.size(r)))).otherwise(none)
                    return F.struct(F.concat(F.slice(t, F.lit(1), i - 1), F.array(best), F.slice(t, i + 2, F.size(t))).alias("t"),
                                    F.concat(before, after).alias("r"))
                return _let(F.array_position(r, best).cast("int"), at)
            return _let(F.array_min(r), lambda best: F.when(best < NONE, merge(best)).otherwise(acc))
        return F.when(n > 0, _let(first, lambda tokens: F.aggregate(F.sequence(F.lit(1), n), start(tokens), step, lambda a: a["t"]))).otherwise(none)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def frequent(rows: DataFrame, most: int = HOT_WORDS) -> DataFrame:
    """The distinct words with the largest counts, at most ``most``, ties all in or all out."""
    counts = stored(rows.select(F.explode(words_of(F.col("body"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
                    .filter((F.col("n") > 1) & (F.octet_length("word") <= LONG) & ~F.contains("word", F.lit(SEPARATOR))), "word-counts")
    # counts to three digits: a small histogram whatever the corpus holds
    digits = F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))
    step = F.pow(F.lit(10), digits).cast("long")
    rounded = F.floor(F.col("n") / step) * step
    held, least = 0, None
    for r in counts.groupBy(rounded.alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


def frequent_codes(rows: DataFrame, ranks: dict[bytes, int], most: int = HOT_WORDS) -> DataFrame:
    """(word, ids) of the frequent words, folded by higher-order functions."""
    vocabulary = Vocabulary(ranks)
    return frequent(rows, most).select("word", _let(vocabulary.tables, lambda v: vocabulary.merged(v, F.col("word"))).alias("ids"))


class Folder:
    """Ranked merges of single words, and ragged gathers of their codes."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, list[int]]) -> None:
        self.pairs, self.known = pair_ranks(ranks), known
        self.start = [ranks[bytes([b])] for b in range(256)]
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]

    def fold(self, word: bytes) -> list[int]:
        t, rank = [self.start[b] for b in word], self.pairs.get
        if len(t) > 64:
            return self._with_heap(t)
        r = [rank(a << 16 | b, NONE) for a, b in zip(t, t[1:])]
        while r and (best := min(r)) < NONE:
            i = r.index(best)
            t[i:i + 2] = [best]
            del r[i]
            if i:
                r[i - 1] = rank(t[i - 1] << 16 | best, NONE)
            if i < len(r):
                r[i] = rank(best << 16 | t[i + 1], NONE)
        return t

    def _with_heap(self, t: list[int]) -> list[int]:
        import heapq
        n, rank = len(t), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(t, t[1:])) if (r := rank(a << 16 | b, NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if t[i] < 0 or j >= n or rank(t[i] << 16 | t[j], NONE) != r:
                continue  # one of the two has merged since
            t[i], t[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(r << 16 | t[after[i]], NONE)) < NONE:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := rank(t[p] << 16 | r, NONE)) < NONE:
                heapq.heappush(heap, (x, p))
        return [x for x in t if x >= 0]

    def encode(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows end to end, ids per row, decoded bytes end to end, bytes per row."""
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = [self.known.get(w) or self.fold(w.encode()) for w in coded.dictionary.to_pylist()]
        length = np.array([len(c) for c in codes], dtype=np.int64)
        flat = np.fromiter((i for c in codes for i in c), dtype=np.uint32, count=int(length.sum()))
        start = np.concatenate([[0], np.cumsum(length)])[:-1] if len(length) else length
        ids = gathered(flat, start[index], length[index])
        row = np.repeat(np.arange(len(sizes)), sizes)
        per_row = np.bincount(row, weights=length[index], minlength=len(sizes)).astype(np.int64)
        text = gathered(self.flat, self.offset[ids], self.length[ids])
        ends = np.concatenate([[0], np.cumsum(self.length[ids])])
        stops = np.cumsum(per_row)
        return ids, per_row, text, ends[stops] - ends[stops - per_row]


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches flat[start:start + length], end to end."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    before = np.concatenate([[0], np.cumsum(length)])[:-1]
    return flat[np.repeat(start - before, length) + np.arange(total)]


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _apply(ranks: dict[bytes, int], known: dict[str, list[int]], at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(ranks, known)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy())
            first = 0
            while first < batch.num_rows:  # about ``at_once`` words at a time
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + at_once, side="right")))
                part = batch.slice(first, last - first)
                sizes = np.diff(np.concatenate([[done], ends[first:last]]))
                ids, n, text, n_bytes = folder.encode(part.column("words").flatten(), sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(ids.astype("<u4").view(np.uint8), 4 * n).cast(pa.binary()),
                                                  _binary(text, n_bytes).cast(pa.binary())], names=["doc_id", "ids", "decoded"])
                first = last
    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
           hot_words: int = HOT_WORDS, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(doc_id, ids, decoded) per row: little-endian unsigned 32-bit ids and the bytes they decode to."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
    known = {r["word"]: r["ids"] for r in frequent_codes(rows, ranks, hot_words).collect()}  # at most ``hot_words`` rows
    return rows.select("doc_id", words_of(F.col("body")).alias("words")).mapInArrow(
        _apply(ranks, known, at_once), "doc_id long, ids binary, decoded binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the byte pieces of little-endian 32-bit ids, by higher-order functions."""
    vocabulary = Vocabulary(ranks)
    hexed = F.hex(ids_col)

    def piece(tables, k):
        at = lambda i: F.substring(hexed, 8 * k + 2 * i + 1, F.lit(2))
        return tables["pieces"][F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10).cast("int")]
    n = F.floor(F.octet_length(ids_col) / 4).cast("int")
    whole = _let(vocabulary.tables, lambda v: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: piece(v, k)), ""))
    return encoded.withColumn("decoded", F.when(n > 0, F.unhex(whole)).otherwise(F.unhex(F.lit(""))))


def report(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
