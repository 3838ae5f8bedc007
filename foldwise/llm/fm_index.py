"""FM-index of a sequence of word codes: backward search through a wavelet matrix, located by sampled positions.

Code 0 ends a run of words; two of them differ and stand in text order, so no
match reaches over one.  Suffixes are sorted by prefix doubling on packed
64-bit keys; only suffixes that still tie go on, so copies cost a logarithmic
number of short rounds.  All searches are NumPy steps over many phrases at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8          # a text position in so many is kept for locating
MOST = (1 << 21) - 1    # symbols of an index: two ranks and a position fit one 64-bit key
_I = np.int64


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order; the last code must be 0."""
    n = len(codes)
    if n > MOST or n and codes[-1]:
        raise ValueError("too many symbols, or no end")
    at_bits, width = max(1, n.bit_length()), max(1, int(codes.max(initial=0)).bit_length())
    deep = max(1, min(n, (63 - at_bits) // width))
    key, running = np.zeros(n, _I), np.ones(n, bool)
    for k in range(deep):
        nxt = np.zeros(n, _I)
        nxt[:n - k] = codes[k:]
        key = (key << width) | np.where(running, nxt, 0)
        running &= nxt != 0
    mask = (1 << at_bits) - 1
    packed = np.sort((key << at_bits) | np.arange(n, dtype=_I))
    order, key = packed & mask, packed >> at_bits
    new = np.ones(n, bool)      # begins a group of equal suffixes; an ended suffix is its own
    new[1:] = (key[1:] != key[:-1]) | ~running[order[1:]]
    rank, slots = np.empty(n, _I), np.arange(n, dtype=_I)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    tied = _tied(new)
    slots = slots[tied]
    while len(slots):
        at = order[slots]
        packed = np.sort((((rank[at] << at_bits) | rank[at + deep]) << at_bits) | at)
        at, key = packed & mask, packed >> at_bits
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[_tied(new)]
        deep *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Members of groups of more than one."""
    tied = ~new
    tied[:-1] |= ~new[1:]
    return tied


class Bits:
    """Packed bit vector with counts of the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        small = np.packbits(bits, bitorder="little")
        packed[:len(small)] = small
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=_I)[:-1]])
        self.ones = int(bits.sum())

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below).astype(_I)


class WaveletMatrix:
    """Ranks and access over a sequence of codes, a bit vector for each binary digit."""

    def __init__(self, codes: np.ndarray, size: int):
        self.width = max(1, (size - 1).bit_length())
        self.levels, rest = [], codes.astype(np.int32)
        for k in reversed(range(self.width)):
            one = (rest >> k) & 1 == 1
            zeros = rest[~one]
            self.levels.append((k, Bits(one), len(zeros)))
            rest = np.concatenate([zeros, rest[one]])
        first = np.ones(len(rest), bool)
        first[1:] = rest[1:] != rest[:-1]
        self.start = np.zeros(size, _I)     # of each code in the last order
        self.start[rest[first]] = np.flatnonzero(first)

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code occurs before its position."""
        for k, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((code >> k) & 1 == 1, zeros + ones, at - ones)
        return at - self.start[code]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each position and how often it occurs before."""
        code = np.zeros(len(at), _I)
        for k, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            code |= one.astype(_I) << k
            at = np.where(one, zeros + ones, at - ones)
        return code, at - self.start[code]


class FmIndex:
    """Counts and locates phrases in ``codes`` (0 or up to ``size - 1``; the last is 0)."""

    def __init__(self, codes: np.ndarray, size: int, sample: int = SAMPLE):
        order = suffix_order(codes)
        before = codes[order - 1]
        self.tree = WaveletMatrix(before, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=size))]).astype(_I)
        kept = (order % sample == 0) | (before == 0)    # no step back leads over an end
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the phrases: rows of codes above 0, of which the first ``sizes`` count."""
        low, high = np.zeros(len(phrases), _I), np.full(len(phrases), self.first[-1])
        todo = np.flatnonzero(sizes > 0)
        high[sizes <= 0] = 0
        step = 0
        while len(todo):
            code = phrases[todo, sizes[todo] - 1 - step].astype(_I)
            both = self.tree.rank(np.concatenate([code, code]), np.concatenate([low[todo], high[todo]]))
            low[todo], high[todo] = self.first[code] + both[:len(code)], self.first[code] + both[len(code):]
            step += 1
            todo = todo[(sizes[todo] > step) & (high[todo] > low[todo])]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, rows, todo, steps = np.empty(len(rows), _I), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            known = self.kept.get(rows)
            out[todo[known]] = self.places[self.kept.rank(rows[known])] + steps
            todo, rows = todo[~known], rows[~known]
            code, nth = self.tree.access(rows)
            rows = self.first[code] + nth
            steps += 1
        return out
