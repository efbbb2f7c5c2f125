"""A compressed FM-index over a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depths: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array by prefix doubling, and for each depth (a power of two) the ranks of the suffixes by their first symbols.

    The end of the text sorts before every symbol. Symbols are below 2**31.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    kept, step = ({1: rank} if 1 in depths else {}), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] if step < n else 0
        order = order[np.argsort(key[order], kind="stable")]
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        step *= 2
        if step in depths:
            kept[step] = rank
        if rank[order[-1]] == n and step >= max(depths, default=0):
            return order, kept


class Bits:
    """A packed bit vector with the count of ones before each word."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class WaveletMatrix:
    """Bit planes of a sequence, most significant first, each stably sorted by the planes above."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.planes: list[Bits] = []
        self.zeros: list[int] = []
        seq = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            self.planes.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        # Where each symbol's run begins once every plane is applied.
        every = np.arange(int(symbols.max(initial=0)) + 1)
        self.begin = self.map(every, np.zeros(len(every), np.int64)).astype(np.int32)

    def map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each place carried through the planes along its symbol's bits; minus begin, it is the symbol's count before the place."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.planes[k].rank(at)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.map(symbol, at) - self.begin[symbol]


class FmIndex:
    """Compressed FM-index of a text of symbols 1.. with 0 between its parts.

    It keeps the wavelet matrix of the Burrows-Wheeler transform and, of the suffix array, a sample: the smallest place of each class of
    suffixes that share `depth` symbols. Bit vectors mark where classes of `depth` and of one symbol less begin. Neither the text nor the
    suffix array is kept.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        if depth < 2:
            raise ValueError("depth must be 2 or more")
        self.size, self.depth = len(text), depth
        order, rank = suffix_array(text, tuple(1 << i for i in range(depth.bit_length()) if 1 << i <= depth))
        self.wavelet = WaveletMatrix(np.where(order > 0, text[order - 1], text[-1]).astype(np.int64))
        counts = np.bincount(text)
        self.start = np.concatenate(([0], np.cumsum(counts)[:-1]))
        longer, shorter = self._classes(rank, order, depth), self._classes(rank, order, depth - 1)
        self.sample = np.minimum.reduceat(order, np.flatnonzero(longer)).astype(np.int32)
        self.longer, self.shorter = Bits(longer), Bits(shorter)
        self.edges = np.append(np.flatnonzero(shorter), self.size).astype(np.int32)

    def nbytes(self) -> int:
        return sum(b.nbytes() for b in (*self.wavelet.planes, self.longer, self.shorter)) + self.wavelet.begin.nbytes + self.start.nbytes + self.sample.nbytes + self.edges.nbytes

    @staticmethod
    def _classes(rank: dict, order: np.ndarray, depth: int) -> np.ndarray:
        """True at each row of the suffix order whose first `depth` symbols differ from the row before."""
        new, at = np.zeros(len(order), bool), 0
        new[0] = True
        while at < depth:
            step = 1 << ((depth - at).bit_length() - 1)
            padded = np.concatenate((rank[step], np.zeros(at, np.int64)))
            r = padded[order + at] if at else rank[step][order]
            new[1:] |= r[1:] != r[:-1]
            at += step
        return new

    def earliest(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each pattern, at each place that begins a window of `depth` symbols, the smallest place of the text with that window, -1 if
        the text doesn't hold it.

        Matching statistics, cut at `depth`, by backward search, all patterns in step, each from its end: the interval of the current match
        is extended by the symbol to the left. A match of `depth` symbols first gives up its last one, for which the classes of shorter
        prefixes tell the wider interval; a match that can't be extended is begun anew one symbol further left.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        begin = np.cumsum(sizes) - sizes
        symbols = np.concatenate([*patterns, np.zeros(0, np.int64)]).astype(np.int64)
        symbols[symbols >= len(self.start)] = 0
        out = np.full(len(symbols), -1, np.int64)
        right, at = sizes.copy(), sizes - 1  # the match covers places at + 1 ... right - 1 of its pattern
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64)
        live = np.flatnonzero(sizes >= self.depth)
        while len(live):
            a, r, lo, hi = at[live], right[live], low[live], high[live]
            full = r - a > self.depth
            if full.any():
                row = self.shorter.rank(lo[full] + 1)
                lo[full], hi[full] = self.edges[row - 1], self.edges[row]
                r = r - full
            symbol = symbols[begin[live] + a]
            both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi))) + np.concatenate((self.start[symbol],) * 2)
            lo, hi = both[: len(live)], both[len(live) :]
            found = (lo < hi) & (symbol > 0)
            hit = found & (r - a == self.depth)
            out[begin[live[hit]] + a[hit]] = self.sample[self.longer.rank(lo[hit] + 1) - 1]
            right[live] = r - ~found
            at[live] = np.where(found, a - 1, right[live] - 1)
            low[live], high[live] = np.where(found, lo, 0), np.where(found, hi, self.size)
            # A window that begins at 0 ends at depth; with less than that to the right nothing can come.
            live = live[(at[live] >= 0) & (right[live] >= self.depth)]
        return [out[b : b + max(0, n - self.depth + 1)] for b, n in zip(begin, sizes)]
