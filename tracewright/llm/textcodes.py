"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word is a run of ASCII letters, digits and bytes from 128 up, so every
character outside ASCII counts as a letter. Its code is a polynomial hash of
its bytes modulo 2**64, from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U8 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
IS_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U8(30))
    h = h * U8(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U8(27))
    h = h * U8(0x94D049BB133111EB)
    return h ^ (h >> U8(31))


def powers(n: int, base: int) -> np.ndarray:
    p = np.full(n + 1, base, dtype=U8)
    p[0] = 1
    return np.cumprod(p, dtype=U8)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, but of one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b
        a = b


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def runs(buf: np.ndarray, o: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes of a class begin and end; o: offsets of rows, which end runs."""
    n = len(buf)
    w = inside[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[o] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    return np.flatnonzero(w & (~before | first[:-1])), np.flatnonzero(w & (~after | first[1:])) + 1


#: A feature is a whole word of up to so many bytes; a longer run has one for each window of them.
WINDOW = 12


class Words:
    """Yields (first row, row after the last, row of each word counted from the
    first, code of each word, length in bytes of each word)."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.up, self.down = most, powers(0, BASE), powers(0, INVERSE)

    def grow(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = powers(max(n, self.most), BASE), powers(max(n, self.most), INVERSE)

    def codes(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of the bytes from s to e."""
        sums = np.zeros(len(buf) + 1, dtype=U8)
        np.cumsum((buf.astype(U8) + U8(1)) * self.up[: len(buf)], out=sums[1:])
        return mix((sums[e] - sums[s]) * self.down[s])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        data, off = buffers(column)
        for a, b in pieces(off, self.most):
            buf, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            self.grow(len(buf))
            s, e = runs(buf, o, IS_WORD)
            yield a, b, np.searchsorted(o, s, side="right") - 1, self.codes(buf, s, e), e - s


class Grams(Words):
    """Yields (first row, row after the last, row of each feature, its code, its
    length). A word of up to WINDOW bytes is a feature; a longer run of word
    bytes (scripts without spaces are such runs) has one for each window of
    WINDOW bytes in it; a row without any word, but with other than white space,
    is one feature as a whole, of length WINDOW."""

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        data, off = buffers(column)
        for a, b in pieces(off, self.most):
            buf, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            n = len(buf)
            self.grow(n)
            s, e = runs(buf, o, IS_WORD)
            more = np.maximum(e - s - WINDOW, 0)
            start = np.repeat(s, more + 1)
            start += np.arange(len(start)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            end = np.minimum(np.repeat(e, more + 1), start + WINDOW)
            row = np.searchsorted(o, start, side="right") - 1
            size = end - start
            ink = np.zeros(b - a, bool)
            spot = np.flatnonzero(~IS_SPACE[buf])
            ink[np.searchsorted(o, spot, side="right") - 1] = True
            ink[row] = False
            bare = np.flatnonzero(ink)
            if len(bare):
                row, start, end = np.append(row, bare), np.append(start, o[bare]), np.append(end, o[bare + 1])
                size = np.append(size, np.full(len(bare), WINDOW))
            yield a, b, row, self.codes(buf, start, end), size
