"""An FM-index over one shard of a corpus, for phrases of known words.

Symbols are positive numbers of the words that phrases use; 0 stands for any
other word and for the end of a text. Each 0 is a different, smallest symbol
(ordered by place), so no suffix is compared past one.
"""

from __future__ import annotations

import numpy as np

#: Every so many places a suffix position is kept.
EVERY = 8


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes of text in order; text ends with 0.

    The first symbols, as many as fit a number, are sorted at once; what is
    still tied is sorted by doubling, tied suffixes alone.
    """
    zeros, places = np.flatnonzero(text == 0), np.flatnonzero(text)
    width = 62 // bits
    key, alive = np.zeros(len(places), np.int64), np.ones(len(places), bool)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    for j in range(width):
        symbol = np.where(alive, padded[places + j], 0)
        alive &= symbol > 0
        key = key << bits | symbol
    order = np.argsort(key, kind="stable")
    places, key, alive = places[order], key[order], alive[order]
    # Suffixes that met a 0 are tied by place alone, which the stable sort has settled.
    slots = np.arange(len(places)) + len(zeros)
    fresh = np.ones(len(places), bool)
    fresh[1:] = (key[1:] != key[:-1]) | ~alive[1:]
    heads = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank = np.empty(len(text), np.int64)
    rank[zeros] = np.arange(len(zeros))
    rank[places] = heads
    tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    done = width
    while len(tied):
        own, head = places[tied], heads[tied]
        order = np.lexsort((rank[own + done], head))
        own, after = own[order], rank[own + done][order]
        places[tied] = own
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        heads[tied] = np.maximum.accumulate(np.where(fresh, slots[tied], 0))
        rank[own] = heads[tied]
        tied = tied[~fresh | np.append(~fresh[1:], False)]
        done *= 2
    return np.concatenate([zeros, places])


class Wavelet:
    """A wavelet matrix: how often a symbol occurs before a place of a sequence."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            high = bit.astype(bool)
            sequence = np.concatenate([sequence[~high], sequence[high]])
        self.heads = self._descend(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            before = ones[at]
            at = np.where((symbols >> level) & 1, zeros + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.heads[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: numbers up to symbols, 0 last."""
        bits = max(1, int(symbols).bit_length())
        suffixes = suffix_array(text, bits)
        before = np.where(suffixes > 0, text[suffixes - 1], 0)
        self.last = before
        self.wavelet = Wavelet(before, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << bits)))])
        # A walk back never has to cross a 0: places after one are kept as well.
        kept = (suffixes % EVERY == 0) | (before == 0)
        self.kept = kept
        self.number = np.cumsum(kept) - 1
        self.places = suffixes[kept]

    def search(self, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray, together: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase, which is so many symbols of a stream from its start on; so many phrases at a time."""
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for k in range(0, len(starts), together):
            part = slice(k, k + together)
            low[part], high[part] = self._search(stream, starts[part], lengths[part])
        return low, high

    def _search(self, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.last), np.int64)
        for j in range(int(lengths.max(initial=0)) - 1, -1, -1):
            on = np.flatnonzero((j < lengths) & (low < high))
            c = stream[starts[on] + j]
            low[on] = self.first[c] + self.wavelet.rank(c, low[on])
            high[on] = self.first[c] + self.wavelet.rank(c, high[on])
            gone = on[c == 0]
            high[gone] = low[gone]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix, by walking back to the next kept one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        on = np.arange(len(rows))
        while len(on):
            here = rows[on]
            found = self.kept[here]
            ready = on[found]
            out[ready] = self.places[self.number[rows[ready]]] + steps[ready]
            on, here = on[~found], here[~found]
            c = self.last[here]
            rows[on] = self.first[c] + self.wavelet.rank(c, here)
            steps[on] += 1
        return out
