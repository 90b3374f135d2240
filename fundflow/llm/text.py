"""Byte-level text helpers for Arrow batches (numpy over the UTF-8 buffer).

Words are maximal runs of bytes whose entry in a 256-entry table is true; a
run never crosses a document.  Both word patterns of this package only name
ASCII characters, and every byte of a non-ASCII character is 0x80 or more,
so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time inside a task (a longer text is one piece).
PIECE_BYTES = 2 << 20

#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows back to back, and the n+1 row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    binary = texts.cast(pa.large_binary())
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    if len(binary) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = binary.buffers()
    off = np.frombuffer(offsets, np.int64)[binary.offset:binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    row, n = 0, len(texts)
    while row < n:
        done = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield row, end
        row = end


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED):
    """Start and end byte of every word, and the n+1 word offsets of the rows."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.take(table, data, out=inside[:-1])
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = off[(off >= 0) & (off <= len(data))]
    starts_mask = inside & ~before
    inner = edge[edge < len(data)]
    starts_mask[inner] = inside[inner]
    ends_mask = before & ~inside
    ends_mask[edge] = before[edge]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask)
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number that starts at each byte (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"),
                                           shape=(len(data) + 1,), strides=(1,))


_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes, not the reverse."""
    at8 = eights(data)
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(length > 0)
    done = 0
    while len(live):
        block = at8[starts[live] + done] & _TAIL[np.minimum(length[live] - done, 8)]
        h[live] = mix(h[live] ^ block) + np.uint64(0x9E3779B97F4A7C15)
        done += 8
        live = live[length[live] > done]
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each pair of spans of the same length, whether their bytes are the same."""
    at8 = eights(data)
    same = np.ones(len(a), dtype=bool)
    live = np.flatnonzero(length > 0)
    done = 0
    while len(live):
        rest = _TAIL[np.minimum(length[live] - done, 8)]
        ok = (at8[a[live] + done] & rest) == (at8[b[live] + done] & rest)
        same[live[~ok]] = False
        done += 8
        live = live[ok & (length[live] > done)]
    return same


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans back to back, and their n+1 offsets."""
    length = ends - starts
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    at = np.repeat(starts - off[:-1], length) + np.arange(off[-1])
    return data[at], off


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
           first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words joined by one space, back to back, and the n+1 row offsets.

    ``first`` are the n+1 word offsets of the rows.
    """
    n = len(starts)
    last = np.zeros(n, dtype=bool)
    full = first[1:] > first[:-1]
    last[first[1:][full] - 1] = True
    width = ends - starts + ~last
    off = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=off[1:])
    out = np.full(off[-1], 0x20, np.uint8)
    at = np.arange(off[-1]) - np.repeat(off[:-1], width)
    real = at < np.repeat(ends - starts, width)
    out[real] = data[(np.repeat(starts, width) + at)[real]]
    return out, off[first]


def strings(data: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array over bytes and offsets."""
    made = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(off) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int64)),
         pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(kind or pa.string())


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (len - width + 1 of them)."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
