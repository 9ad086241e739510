"""Words of texts as 64-bit numbers, straight from the UTF-8 bytes.

A word is a longest run of a-z, 0-9 and non-ASCII characters after A-Z became
a-z. All bytes of a non-ASCII character are 0x80 or more, so bytes suffice.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Byte to word byte, 0 where no word goes on.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)

BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, UNBASE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; start and end of each word; index of each text's first word, with the end."""
    folded = FOLD[data]
    inside = folded != 0
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return folded, none, none, np.zeros(len(offsets), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < n]
    begins[firsts] = inside[firsts]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return folded, begins, ends, np.searchsorted(begins, offsets)


#: Bytes hashed together, so that a very long text needs no more memory than this.
TOGETHER = 1 << 20


def hashes(folded: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word, equal for equal words wherever they stand."""
    out, first = np.empty(len(begins), np.uint64), 0
    while first < len(begins):
        start = int(begins[first])
        last = max(first + 1, int(np.searchsorted(begins, start + TOGETHER)))
        part, b, e = folded[start : int(ends[last - 1])], begins[first:last] - start, ends[first:last] - start
        up, down = _powers(1 << max(16, len(part).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[first:last] = mixed((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def of_text(text: str | None) -> list[str]:
    """The words of one text, plainly."""
    raw = bytes(FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)])
    return [x.decode("utf-8", "surrogatepass") for x in raw.split(b"\0") if x]
