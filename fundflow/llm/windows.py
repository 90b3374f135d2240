"""Windows shared between documents: super-k-mers dealt by minimiser, answers sent back.

Documents are dealt once into chunks of bounded size by a hash of their
place in their file (or of a stored row key), so repeated rows spread like
others.  A chunk cuts its texts into super-k-mers (runs of consecutive windows
that share a minimiser, the smallest hash of a gram within the window) and
sends every distinct one once, with the smallest doc_id that has it, to the
bucket of its minimiser.  Equal windows have equal minimisers, so a bucket
sees all there is to know of its windows and answers each chunk with a bit
for each window: does a document with a smaller id have it too?  The chunk
cuts its texts again, in the same order, and applies the bits.

* However many documents share a passage, a chunk sends it once: a bucket's
  share of one passage is bounded by the number of chunks.
* A minimiser that holds more than a bucket's fair share of all windows in
  different contexts is found by a pass over all documents beforehand; its
  windows are dealt one by one by their own hash.  At most ``2 / SHARE``
  such minimisers can exist, which bounds what is broadcast.
* The documents' own shuffle is one exchange that both passes read.
* Everything a task does depends on its input rows alone, so a lost task can
  be run again anywhere.

A null doc_id counts as larger than any other; rows with equal ids never
make each other duplicates; null and empty texts have no windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from fundflow.llm.text import (
    SPACED, eights, equal_spans, flat, gather, joined, mix, pieces, sliding_min, span_hash, strings, words,
)
from fundflow.llm.rows import keyed_rows

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
#: A bucket is worked off in so many parts, by minimiser too, to bound memory.
PARTS = 16
#: No bucket's minimiser may hold more than this share of all windows, at any size.
SHARE = 1e-5
NO_ID = np.iinfo(np.int64).max
BODY = "chunk long, bucket long, body binary"
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# ---------------------------------------------------------------- packed rows
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; numbers are stored byte plane by byte plane."""
    parts = [np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.dtype.itemsize)], "<u4").tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8)
        parts.append(raw.reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else raw.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    head = raw[4:4 + 8 * n].view("<u4").reshape(n, 2).astype(int)
    at, out = 4 + 8 * n, []
    for size, width in head.tolist():
        part = raw[at:at + size * width]
        out.append(part if width == 1 else np.ascontiguousarray(part.reshape(width, size).T).view(f"<u{width}").ravel())
        at += size * width
    return out


def bodies(chunk: np.ndarray | int, bucket: list[int], body: list[bytes]) -> pa.Table:
    chunks = np.full(len(body), chunk, np.int64) if np.isscalar(chunk) else chunk
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(bucket, pa.int64()),
                     "body": pa.array(body, pa.binary())})


# ---------------------------------------------------------------- chunks
def placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(place, doc_id, text): ``place`` is a hash that spreads all rows, repeated ones too, the same on every read.

    Rows read from Parquet files are known by file and row number, which no
    split changes; others are written once with a row key.  So are rows that
    an explode, a join or another step made of them: those share a number.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    try:
        if not _rows_of_files(docs):
            return _placed_by_key(docs.select(*columns))
        return docs.select(F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place"), *columns)
    except AnalysisException:  # not the rows of Parquet files
        return _placed_by_key(docs.select(*columns))


def _placed_by_key(rows: DataFrame) -> DataFrame:
    return keyed_rows(rows, "dealt-rows").select(F.xxhash64("row_key").alias("place"), "row.doc_id", "row.text")


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether the plan only reads, filters and selects; steps it does not know count as others."""
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    return all(re.match(r"[\s:+\-]*(Relation|Project|Filter|SubqueryAlias|View)\b", x) for x in plan.splitlines())


def dealt(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) rows, and the bytes of all texts."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]
    chunks = max(-(-int(total) // chunk_bytes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = placed(docs, doc_id, text)
    return rows.select(F.pmod("place", F.lit(chunks)).alias("chunk"), "doc_id", "text"), int(total)


def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A chunk's rows by id, null ids last, and the ids with ``NO_ID`` for null."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column("doc_id").combine_chunks()
    return table, np.asarray(ids.fill_null(NO_ID)).astype(np.int64)


# ---------------------------------------------------------------- units
@dataclass
class Units:
    """The words or bytes of a chunk's rows: unit u is data[starts[u]:ends[u]]."""

    data: np.ndarray
    starts: np.ndarray | None  # None: unit u is byte u
    ends: np.ndarray | None
    first: np.ndarray  # n+1 unit offsets of the rows

    def span(self, unit: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of ``count`` units from ``unit`` on."""
        if self.starts is None:
            return unit, unit + count
        return self.starts[unit], self.ends[unit + count - 1]


def word_units(texts: pa.Array) -> Units:
    """Words joined by one space within a row."""
    datas, starts, ends, first = [], [], [], [np.zeros(1, np.int64)]
    byte = unit = 0
    for a, b in pieces(texts, 2 << 20):
        data, off = flat(texts.slice(a, b - a))
        s, e, f = words(data, off, SPACED)
        normal, row = joined(data, s, e, f)
        s, e, _ = words(normal, row, SPACED)
        datas.append(normal)
        starts.append(s + byte)
        ends.append(e + byte)
        first.append(f[1:] + unit)
        byte += len(normal)
        unit += len(s)
    none = [np.zeros(0, np.int64)]
    return Units(np.concatenate(datas or [np.zeros(0, np.uint8)]), np.concatenate(starts or none),
                 np.concatenate(ends or none), np.concatenate(first))


def byte_units(texts: pa.Array) -> Units:
    data, off = flat(texts)
    return Units(data, None, None, off)


def word_grams(units: Units, m: int) -> np.ndarray:
    code = span_hash(units.data, units.starts, units.ends)
    out = code[:len(code) - m + 1].copy() if len(code) >= m else np.zeros(0, np.uint64)
    for k in range(1, m):
        out *= _C1
        out += code[k:len(code) - m + 1 + k]
    return mix(out)


def byte_grams(units: Units, m: int) -> np.ndarray:
    at8, size = eights(units.data), len(units.data) - m + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, m, np.uint64)
    for k in range(0, m, 8):
        out += at8[k:k + size] if m - k >= 8 else at8[k:k + size] & np.uint64((1 << (8 * (m - k))) - 1)
        out *= _C1
        out ^= out >> np.uint64(32)
    out *= _C2
    return out


@dataclass(frozen=True)
class Shape:
    """What a window is: ``size`` units, minimisers of ``gram`` units."""

    size: int
    gram: int
    units: Callable[[pa.Array], Units]
    grams: Callable[[Units, int], np.ndarray]


@dataclass
class Kmers:
    """Super-k-mers: first unit, number of windows, minimiser, row."""

    unit: np.ndarray
    count: np.ndarray
    key: np.ndarray
    row: np.ndarray

    def take(self, at: np.ndarray) -> "Kmers":
        return Kmers(self.unit[at], self.count[at], self.key[at], self.row[at])


def super_kmers(units: Units, shape: Shape) -> Kmers:
    """All super-k-mers of a chunk, by row and place."""
    out = []
    sizes = units.first
    row = 0
    n_rows = len(sizes) - 1
    limit = (2 << 20) if units.starts is None else (1 << 20)
    while row < n_rows:  # row ranges of bounded size
        end = max(row + 1, int(np.searchsorted(sizes, sizes[row] + limit, side="right")) - 1)
        a, b = int(sizes[row]), int(sizes[end])
        if b - a >= shape.size:
            if units.starts is None:
                part = Units(units.data[a:b], None, None, sizes[row:end + 1] - a)
            else:
                part = Units(units.data, units.starts[a:b], units.ends[a:b], sizes[row:end + 1] - a)
            kmers = _cut(shape.grams(part, shape.gram), part.first, shape)
            kmers.unit = kmers.unit + a
            kmers.row = kmers.row + row
            out.append(kmers)
        row = end
    if not out:
        none = np.zeros(0, np.int64)
        return Kmers(none, none, np.zeros(0, np.uint64), none)
    return Kmers(*(np.concatenate([getattr(x, k) for x in out]) for k in ("unit", "count", "key", "row")))


def _cut(grams: np.ndarray, first: np.ndarray, shape: Shape) -> Kmers:
    width = shape.size - shape.gram + 1
    least = sliding_min(grams, width)
    n = len(least)
    valid = np.ones(n, bool)
    for k in range(1, shape.size):  # starts whose window would cross the end of a row
        at = first[1:] - k
        valid[at[(at >= 0) & (at < n)]] = False
    same = np.zeros(n, bool)
    same[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    start = np.flatnonzero(valid & ~same)
    follow = np.zeros(n, bool)
    follow[:-1] = same[1:]
    count = np.flatnonzero(valid & ~follow) - start + 1
    return Kmers(start, count, least[start], np.searchsorted(first, start, side="right") - 1)


def split_hot(units: Units, kmers: Kmers, shape: Shape, hot: np.ndarray) -> Kmers:
    """Super-k-mers of hot minimisers cut into single windows, each keyed by its own hash."""
    if not len(hot) or not len(kmers.key):
        return kmers
    often = hot[np.minimum(np.searchsorted(hot, kmers.key), len(hot) - 1)] == kmers.key
    if not often.any():
        return kmers
    rest, cut = kmers.take(np.flatnonzero(~often)), kmers.take(np.flatnonzero(often))
    alone = np.repeat(cut.unit, cut.count) + _ranges(cut.count)
    own = span_hash(units.data, *units.span(alone, np.full(len(alone), shape.size)))
    both = Kmers(np.concatenate([rest.unit, alone]), np.concatenate([rest.count, np.ones(len(alone), np.int64)]),
                 np.concatenate([rest.key, own]), np.concatenate([rest.row, np.repeat(cut.row, cut.count)]))
    return both.take(np.argsort(both.unit, kind="stable"))


def _ranges(count: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, back to back."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def hot_minimisers(docs: DataFrame, text: str, shape: Shape, buckets: int) -> np.ndarray:
    """Sorted minimisers that hold at least a share 1/buckets (or SHARE) of all windows.

    A minimiser with that share overall has half of it within some of the
    batches that report it, so each batch reports only those and every one
    that counts is found.
    """
    share = max(1 / buckets, SHARE)

    def report(batches):
        for batch in batches:
            texts = batch.column(0)
            for a, b in pieces(texts):
                kmers = super_kmers(shape.units(texts.slice(a, b - a)), shape)
                if not len(kmers.key):
                    continue
                key, at = np.unique(kmers.key, return_inverse=True)
                n = np.bincount(at, kmers.count).astype(np.int64)
                many = n >= max(share * n.sum() / 2, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([key[many].astype(np.int64), [0]])),
                     pa.array(np.concatenate([n[many], [n.sum()]])),
                     pa.array([False] * int(many.sum()) + [True])], names=["key", "n", "total"])

    found = (docs.select(F.col(text).alias("text")).mapInArrow(report, "key long, n long, total boolean")
             .groupBy("key", "total").agg(F.sum("n").alias("n")))
    total = found.filter("total").select("n").first()
    if total is None:
        return np.zeros(0, np.uint64)
    often = found.filter(~F.col("total") & (F.col("n") >= max(2, share * total["n"] / 2))).select("key").toPandas()
    return np.sort(often["key"].to_numpy(np.int64).astype(np.uint64))


# ---------------------------------------------------------------- asking and answering
@dataclass
class Question:
    """What a chunk asks one bucket: its distinct super-k-mers in order of first occurrence."""

    bucket: int
    part: np.ndarray  # of each distinct super-k-mer
    kmers: Kmers  # all occurrences
    code: np.ndarray  # distinct number of each occurrence
    one: np.ndarray  # occurrence that is the first of each distinct
    data: np.ndarray
    off: np.ndarray


def questions(units: Units, kmers: Kmers, shape: Shape, buckets: int):
    code = mix(kmers.key * _C3 + _C2)
    bucket = (code % np.uint64(buckets)).astype(np.int64)
    part = (code >> np.uint64(56)).astype(np.uint8) % PARTS
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        mine = kmers.take(order[a:b])
        start, end = units.span(mine.unit, mine.count + shape.size - 1)
        data, off = gather(units.data, start, end)
        coded = strings(data, off, pa.large_binary()).dictionary_encode()
        code = np.asarray(coded.indices)
        one = np.full(len(coded.dictionary), len(code), np.int64)
        np.minimum.at(one, code, np.arange(len(code)))
        data, off = gather(units.data, start[one], end[one])
        yield Question(int(bucket[order[a]]), part[order[a:b]][one], mine, code, one, data, off)


def ask(question: Question, ids: np.ndarray) -> bytes:
    first = ids[question.kmers.row[question.one]]
    return pack(first, np.diff(question.off).astype(np.uint32), question.part, question.data)


def answers(table: pa.Table, window_counts: Callable, smallest: Callable) -> pa.Table:
    """One bucket: bits of the windows that a smaller id has too, for the chunks that have such.

    ``window_counts(data, off)`` gives the number of windows of each super-k-mer,
    ``smallest(data, off, doc)`` the smallest id that has each window, in
    order.  The latter sees a super-k-mer that several chunks sent once.
    """
    chunks = np.asarray(table.column("chunk").combine_chunks())
    bucket = table.column("bucket")[0].as_py()
    order = np.argsort(chunks, kind="stable")
    ids, sizes, parts, datas, counts = [], [], [], [], []
    for k in order.tolist():
        doc, size, part, data = unpack(table.column("body")[k].as_py())
        ids.append(doc.astype(np.int64))
        sizes.append(size.astype(np.int64))
        parts.append(part)
        datas.append(data)
        counts.append(len(doc))
    size = np.concatenate(sizes)
    off = np.concatenate([[0], np.cumsum(size)])
    data, doc, part = np.concatenate(datas), np.concatenate(ids), np.concatenate(parts)
    del datas, sizes, ids, parts
    windows = window_counts(data, off)
    place = np.concatenate([[0], np.cumsum(windows)])
    flag = np.zeros(int(place[-1]), bool)  # of every window, by super-k-mer
    for k in range(PARTS):
        mine = np.flatnonzero(part == k)
        if len(mine):
            coded = strings(*gather(data, off[mine], off[mine + 1]), pa.large_binary()).dictionary_encode()
            code, n = np.asarray(coded.indices), len(coded.dictionary)
            low, count = np.full(n, NO_ID), np.zeros(n, np.int64)
            np.minimum.at(low, code, doc[mine])
            count[code] = windows[mine]
            least = smallest(*flat(coded.dictionary), low)
            step, each = _ranges(windows[mine]), windows[mine]
            first = np.repeat((np.cumsum(count) - count)[code], each) + step
            flag[np.repeat(place[mine], each) + step] = least[first] < np.repeat(doc[mine], each)
    chunk_of = np.repeat(np.repeat(chunks[order], counts), windows)
    edge = np.flatnonzero(np.diff(chunk_of, prepend=-1))
    out_chunk, out_body = [], []
    for a, b in zip(edge, np.append(edge[1:], len(chunk_of))):
        if flag[a:b].any():
            out_chunk.append(int(chunk_of[a]))
            out_body.append(pack(np.packbits(flag[a:b])))
    return bodies(np.array(out_chunk, np.int64), [bucket] * len(out_body), out_body)


def word_window_counts(data: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    return np.diff(words(data, off, SPACED)[2]) - size + 1


def word_windows(data: np.ndarray, off: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """The smallest id that has each window, by sorting window hashes.

    Windows of one hash are compared byte by byte; a hash that two different
    windows share is settled by their bytes.
    """
    starts, ends, first = words(data, off, SPACED)
    code = span_hash(data, starts, ends)
    count = np.diff(first) - size + 1
    kmer = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first[:-1], count) + _ranges(count)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h *= _C1
        h += code[at + k]
    h = mix(h)
    a, b = starts[at], ends[at + size - 1]
    return smallest_ids(data, a, b - a, np.argsort(h), doc[kmer], h)


def smallest_ids(data, start, length, order, doc, h) -> np.ndarray:
    """The smallest id of the spans equal to each one; ``order`` sorts the spans by hash ``h``."""
    out = np.empty(len(order), np.int64)
    if not len(order):
        return out
    tie = h[order[1:]] == h[order[:-1]]
    again = np.flatnonzero(tie) + 1
    x, y = order[again], order[again - 1]
    same = length[x] == length[y]
    same[same] = equal_spans(data, start[x[same]], start[y[same]], length[x[same]])
    if not same.all():
        clash = np.isin(h[order], np.unique(h[x[~same]]))
        for value in np.unique(h[x[~same]]):
            least: dict[bytes, int] = {}
            spans = np.flatnonzero(h == value)
            text = [data[start[k]:start[k] + length[k]].tobytes() for k in spans]
            for t, k in zip(text, spans):
                least[t] = min(least.get(t, NO_ID), int(doc[k]))
            out[spans] = [least[t] for t in text]
        order = order[~clash]
        if not len(order):
            return out
        tie = h[order[1:]] == h[order[:-1]]
    group = np.concatenate([[0], np.cumsum(~tie)])
    edge = np.concatenate([[0], np.flatnonzero(~tie) + 1])
    out[order] = np.minimum.reduceat(doc[order], edge)[group]
    return out


def repeated_windows(units: Units, kmers: Kmers, shape: Shape, buckets: int, ids: np.ndarray,
                     replies: dict[int, bytes]) -> np.ndarray:
    """First units of the windows of a chunk that a document with a smaller id has too."""
    out = []
    for q in questions(units, kmers, shape, buckets):
        count = q.kmers.count
        one_count = count[q.one]
        place = np.cumsum(one_count) - one_count
        body = replies.get(q.bucket)
        bits = np.zeros(int(one_count.sum()), bool)
        if body is not None:
            bits = np.unpackbits(unpack(body)[0], count=len(bits)).astype(bool)
        occurrence = np.repeat(np.arange(len(count)), count)
        step = _ranges(count)
        later = ids[q.kmers.row] > ids[q.kmers.row[q.one]][q.code]
        flag = bits[place[q.code][occurrence] + step] | later[occurrence]
        out.append((q.kmers.unit[occurrence] + step)[flag])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def covered(n_units: int, at: np.ndarray, size: int) -> np.ndarray:
    """Mask of the units within a window that starts at one of ``at``."""
    edge = np.zeros(n_units + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def reply_map(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist()))
