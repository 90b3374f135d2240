"""Marked bytes of a UTF-8 buffer: rank and select over 64-bit words.

A buffer is viewed as little-endian 64-bit words, and one arithmetic step
marks bytes of all eight at once: a marked byte has its bit 7 set in the mark
word, the others are zero.  ``bitwise_count`` gives the marks of a word, their
running sum is searched for the word that holds the k-th mark, and a
multiplication resolves the byte within that word.
"""

from __future__ import annotations

import numpy as np

HIGH = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)
_BIT5, _LOW7 = np.uint64(0x2020202020202020), np.uint64(0x7F7F7F7F7F7F7F7F)
_FROM_A, _BEYOND_Z = np.uint64(0x1F1F1F1F1F1F1F1F), np.uint64(0x0505050505050505)  # 0x80 - "a", 0x80 - ("z" + 1)
_1, _3, _7, _8, _56 = (np.uint64(k) for k in (1, 3, 7, 8, 56))


def words_of(data: np.ndarray) -> np.ndarray:
    """The buffer as 64-bit words, at least one zero byte behind it."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def letters(w: np.ndarray) -> np.ndarray:
    """Marks of the bytes A-Z and a-z: no sum carries into the next byte."""
    x = (w | _BIT5) & _LOW7
    return (x + _FROM_A) & ~(x + _BEYOND_Z) & ~w & HIGH


def continuation(w: np.ndarray) -> np.ndarray:
    """Marks of the bytes 10xxxxxx, which begin no code point."""
    return w & ~(w << _1) & HIGH


def following(marks: np.ndarray) -> np.ndarray:
    """Marks of the bytes whose next byte is marked."""
    out = marks >> _8
    out[:-1] |= marks[1:] << _56
    return out


class Marked:
    """Rank and select of marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.upto[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each byte."""
        word = at >> 3
        below = (_1 << ((at & 7).astype(np.uint64) << _3)) - _1
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte that carries mark number k, counted from 0."""
        word = np.searchsorted(self.upto, k, side="right") - 1
        # byte j of the product: marks among the bytes 0..j of the word
        counts = np.ascontiguousarray((self.marks[word] >> _7) * ONES).view(np.uint8).reshape(-1, 8)
        return word * 8 + (counts > (k - self.upto[word])[:, None]).argmax(axis=1)


def code_points(w: np.ndarray) -> Marked:
    """The first bytes of code points."""
    return Marked(~continuation(w) & HIGH)


def code_point_at(points: Marked, off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Byte at which each row's first ``count`` code points end (the row's end where it has fewer).

    ``off`` are the n+1 byte offsets of the rows.
    """
    first = points.rank(off)
    enough = count < np.diff(first)
    out = off[1:].copy()
    out[enough] = points.select(first[:-1][enough] + count[enough])
    return out


def unit_ends(data: np.ndarray, off: np.ndarray, w: np.ndarray | None = None) -> Marked:
    """The last bytes of the units ``[A-Za-z]+|[^A-Za-z]`` of all rows.

    A byte ends a unit unless it and the next are letters of one row, or the
    next continues its code point.
    """
    w = words_of(data) if w is None else w
    letter = letters(w)
    ends = HIGH & ~(letter & following(letter)) & ~following(continuation(w))
    last = off[1:][off[1:] > off[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, _1 << (((last & 7).astype(np.uint64) << _3) + _7))
    return Marked(ends)
