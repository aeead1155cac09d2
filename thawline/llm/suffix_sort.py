"""Hash-compared sorting of bounded suffixes (numpy, inside one task).

Prefix polynomial hashes modulo 2**64 give the hash of any substring in
constant time, a binary search over lengths the common extension of two
suffixes, so one comparison costs a logarithmic number of hash look-ups.
Suffixes are merge-sorted bottom up; in a merge every element of one run finds
its place in the other by binary search, all elements at once. Neighbours are
then verified byte by byte; a collision falls back to a sort by the bytes.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_values(salt: int = 0) -> np.ndarray:
    """A fixed odd-looking 64-bit value per byte (splitmix64 of the byte and ``salt``)."""
    z = (np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * salt)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        _POWERS[int(base)] = known = np.multiply.accumulate(known)
    return known[:n]


class Hashes:
    """Prefix hashes of a byte buffer."""

    def __init__(self, data: np.ndarray, salt: int = 0) -> None:
        n = len(data)
        self.data = data
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_values(salt)[data] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right of a and b, up to ``most``."""
        low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def heads(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first eight bytes of suffixes as numbers that sort like them; all suffixes have eight."""
        out = np.zeros(len(start), dtype=np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.data[start + k].astype(np.uint64)
        return out

    def less(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Whether suffix a (length la) sorts before b; a proper prefix sorts first."""
        most = np.minimum(la, lb)
        same = self.common(a, b, most)
        whole = same == most
        at = np.where(whole, 0, same)
        return np.where(whole, la < lb, self.data[np.minimum(a + at, len(self.data) - 1)] < self.data[np.minimum(b + at, len(self.data) - 1)])


def merge_sort(hashes: Hashes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stable order of the suffixes data[start:start + length]."""
    n = len(start)
    order = np.arange(n)
    heads = hashes.heads(start, length) if n and length.min() >= 8 else np.zeros(n, dtype=np.uint64)

    def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = heads[a] < heads[b]
        tied = np.flatnonzero(heads[a] == heads[b])
        x, y = a[tied], b[tied]
        out[tied] = hashes.less(start[x], length[x], start[y], length[y])
        return out
    width = 1
    while width < n:
        run = np.arange(n) // width  # of the place
        other = run ^ 1
        left_of = other * width
        low = np.minimum(left_of, n)
        high = np.minimum(left_of + width, n)
        low0 = low.copy()
        mine, right = order, (run & 1).astype(bool)
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) >> 1
            a, b = mine[open_], order[mid]
            # elements of the left run go before equal ones of the right run
            from_right = right[open_]
            swapped = before(np.where(from_right, a, b), np.where(from_right, b, a))
            ahead = np.where(from_right, ~swapped, swapped)
            low[open_] = np.where(ahead, mid + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], mid)
        place = (run & ~1) * width + (np.arange(n) - run * width) + (low - low0)
        merged = np.empty(n, dtype=order.dtype)
        merged[place] = order
        order = merged
        width *= 2
    return order


def sorted_suffixes(hashes: Hashes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): lcp[i] belongs to places i - 1 and i, lcp[0] is 0; verified on the bytes."""
    order = merge_sort(hashes, start, length)
    lcp = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        lcp[1:] = hashes.common(start[a], start[b], np.minimum(length[a], length[b]))
    raw = hashes.data.tobytes()
    texts = [raw[s:s + n] for s, n in zip(start[order].tolist(), length[order].tolist())]
    for x, y, n in zip(texts, texts[1:], lcp[1:].tolist()):
        if x[:n] != y[:n] or x > y or (n < min(len(x), len(y)) and x[n] == y[n]):
            return _by_bytes(raw, start, length)
    return order, lcp


def _by_bytes(raw: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the bytes themselves, for buffers in which hashes collide."""
    from os.path import commonprefix
    texts = [raw[s:s + n] for s, n in zip(start.tolist(), length.tolist())]
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__), dtype=np.int64)
    lcp = np.zeros(len(order), dtype=np.int64)
    for i in range(1, len(order)):
        lcp[i] = len(commonprefix([texts[order[i - 1]], texts[order[i]]]))
    return order, lcp
