"""Suffix-array deduplication of bytes with the difference-cover algorithm.

Every byte covered by a ``length``-byte string that also starts in a
document with a smaller doc_id is removed; strings are judged on the input
and never cross documents.

Suffixes that share their first ``length`` bytes share a minimiser, so texts
are dealt to buckets by it and every bucket orders its suffixes on its own:
sort the triples at positions 1 and 2 modulo 3, name them, recurse on the
names, order the positions 0 modulo 3 by their first symbol and the rank
that follows, merge, then compare adjacent prefixes.  Recursion ends where
names already span ``length`` bytes.

Before that, chunks exchange the minimisers alone (48-bit hashes, sorted,
delta-coded): a minimiser found in one document only cannot belong to a
shared string, so only super-k-mers whose minimiser another document has too
travel as text.  This is exact: hash collisions only let more text travel.

Defined results: null counts as empty and keeps empty bytes; texts shorter
than ``length`` lose nothing; a null doc_id counts as the largest; rows with
equal ids (repeated rows) do not remove each other's bytes; every row of the
input gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fundflow.llm import windows as W
from fundflow.llm.text import equal_spans, strings

LENGTH = 50
GRAM = 20  # bytes of a minimiser
CHUNK_BYTES = 4 << 20
#: Share of the text that is expected to travel times the spread of super-k-mers.
SPREAD = 1


# ---------------------------------------------------------------- difference cover
def _order(key: np.ndarray, top: int) -> np.ndarray:
    """Positions in order of ``key`` (0..top), equal keys by position."""
    bits = len(key).bit_length()
    if top.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    packed = key << bits | np.arange(len(key))  # sorting numbers is far quicker than sorting positions
    packed.sort()
    return packed & (1 << bits) - 1


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of rows of symbols, and the largest."""
    room = 63 - len(columns[0]).bit_length()
    tops = [int(c.max(initial=0)) for c in columns]
    name, top = columns[0], tops[0]
    for k in range(1, len(columns)):
        name = name * (tops[k] + 1) + columns[k]
        top = top * (tops[k] + 1) + tops[k]
        if k + 1 < len(columns) and (top * (tops[k + 1] + 1) + tops[k + 1]).bit_length() <= room:
            continue  # the next column still fits beside
        order = _order(name, top)
        step = np.zeros(len(name), np.int64)
        step[1:] = np.diff(name[order]) != 0
        name = np.empty(len(name), np.int64)
        name[order] = np.cumsum(step) + 1
        top = int(name.max(initial=0))
    return name, top


def suffix_order(symbols: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """Start positions of all suffixes, ordered by their first ``depth / span`` symbols at least.

    ``symbols`` are positive; one symbol stands for ``span`` bytes.
    Suffixes that agree that far are adjacent, in any order.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda k: symbols[k:].tolist()), np.int64)
    # every third position is a slice: at[k] are the symbols k places right of 0, 3, 6, ...
    n0, n2 = -(-n // 3), n // 3  # positions 0 and 2 modulo 3; 1 modulo 3 are n0 with a last
    s = np.concatenate([symbols, np.zeros(8, np.int64)])  # empty triple that keeps both halves apart
    at = [s[k:k + 3 * n0:3] for k in range(4)]
    two = [s[k:k + 3 * n2:3] for k in range(2, 5)]
    name, distinct = _names(*(np.concatenate(x) for x in zip(at[1:], two)))
    if distinct < len(name) and 3 * span < depth:
        order = suffix_order(name, depth, 3 * span)
        name[order] = np.arange(1, len(name) + 1)
    else:
        order = _order(name, distinct)
    sampled = np.where(order < n0, 3 * order + 1, 3 * (order - n0) + 2)
    sampled = sampled[sampled < n]
    base = len(name) + 2
    ones, twos = name[:n0], np.concatenate([name[n0:], np.zeros(n0 + 1 - n2, np.int64)])
    # the others by (symbol, rank that follows)
    key = at[0] * base + ones
    zero = _order(key, (int(at[0].max(initial=0)) + 1) * base)
    key = key[zero]
    # how many sampled suffixes come before each: by (symbol, rank) against the ones, by
    # (symbol, symbol, rank) against the twos
    real = n0 - (n % 3 == 1)
    before = np.searchsorted(np.sort(at[1][:real] * base + twos[:real]), key)
    pair, _ = _names(np.concatenate([two[0], at[0]]), np.concatenate([two[1], at[1]]))
    after = np.concatenate([ones[1:], np.zeros(1, np.int64)])[:n2]
    own = pair[n2:] * base + twos[:n0]
    before = before + np.searchsorted(np.sort(pair[:n2] * base + after), own[zero])
    place = np.maximum.accumulate(before) + np.arange(n0)
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = 3 * zero
    out[~taken] = sampled
    return out


def smallest_ids(data: np.ndarray, off: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The smallest id that has each string of ``length`` bytes, in order of place."""
    count = np.diff(off) - length + 1
    kmer = np.repeat(np.arange(len(count)), count)
    start = np.repeat(off[:-1], count) + W._ranges(count)
    # every super-k-mer ends with a symbol of its own kind, so that no suffix runs into the next
    symbols = np.zeros(len(data) + len(count), np.int64)
    at = np.arange(len(data)) + np.repeat(np.arange(len(count)), np.diff(off))
    symbols[at] = data.astype(np.int64) + 2
    symbols[off[1:] + np.arange(len(count))] = 1
    order = suffix_order(symbols, length)
    string = np.full(len(symbols), -1, np.int64)
    string[start + kmer] = np.arange(len(start))
    order = string[order]
    order = order[order >= 0]
    out = np.empty(len(start), np.int64)
    if len(order):
        a, b = start[order[:-1]], start[order[1:]]
        tie = equal_spans(data, a, b, np.full(len(a), length))
        edge = np.concatenate([[0], np.flatnonzero(~tie) + 1])
        least = np.minimum.reduceat(doc[kmer[order]], edge)
        out[order] = np.repeat(least, np.diff(np.append(edge, len(order))))
    return out


# ---------------------------------------------------------------- the exchange of minimisers
def _hashes(kmers: W.Kmers) -> np.ndarray:
    return (kmers.key >> np.uint64(16)).astype(np.int64)


def _edges(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each sorted 48-bit hash (equal ranges), and where buckets begin."""
    width = -(-(1 << 48) // buckets)
    bucket = values // width
    return bucket, np.flatnonzero(np.diff(bucket, prepend=-1))


def ask_minimisers(kmers: W.Kmers, buckets: int) -> tuple[list[int], list[bytes]]:
    values = np.unique(_hashes(kmers))
    bucket, edge = _edges(values, buckets)
    out = [W.pack(np.diff(values[a:b], prepend=0).astype(np.uint64))
           for a, b in zip(edge, np.append(edge[1:], len(values)))]
    return bucket[edge].tolist(), out


def answer_minimisers(table: pa.Table) -> pa.Table:
    """Bits of the hashes that more than one chunk has."""
    chunk = np.asarray(table.column("chunk").combine_chunks())
    values = [np.cumsum(W.unpack(x)[0].astype(np.int64)) for x in table.column("body").to_pylist()]
    sizes = np.array([len(v) for v in values])
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    tie = np.diff(every[order]) == 0
    shared = np.zeros(len(every), bool)
    shared[order[1:][tie]] = True
    shared[order[:-1][tie]] = True
    end = np.cumsum(sizes)
    out = [(int(c), W.pack(np.packbits(shared[b - n:b]))) for c, n, b in zip(chunk, sizes, end)
           if shared[b - n:b].any()]
    bucket = table.column("bucket")[0].as_py()
    return W.bodies(np.array([c for c, _ in out], np.int64), [bucket] * len(out), [x for _, x in out])


def live(kmers: W.Kmers, ids: np.ndarray, buckets: int, replies: dict[int, bytes]) -> W.Kmers:
    """Super-k-mers whose minimiser another document has too."""
    hashes = _hashes(kmers)
    values, at = np.unique(hashes, return_inverse=True)
    many = np.zeros(len(values), bool)
    if len(values):
        doc = ids[kmers.row]
        low, high = np.full(len(values), W.NO_ID), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, at, doc)
        np.maximum.at(high, at, doc)
        many = low < high
        bucket, edge = _edges(values, buckets)
        for a, b in zip(edge, np.append(edge[1:], len(values))):
            body = replies.get(int(bucket[a]))
            if body is not None:
                many[a:b] |= np.unpackbits(W.unpack(body)[0], count=b - a).astype(bool)
    return kmers.take(np.flatnonzero(many[at])) if len(values) else kmers


# ---------------------------------------------------------------- the operator
def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_bytes."""
    shape = W.Shape(length, min(gram, length), W.byte_units, W.byte_grams)
    rows, total = W.dealt(docs, doc_id, text, CHUNK_BYTES)
    buckets = max(1, -(-SPREAD * total // W.BUCKET_BYTES))
    hot = docs.sparkSession.sparkContext.broadcast(W.hot_minimisers(docs, text, shape, buckets * W.PARTS))

    def cut(table: pa.Table):
        table, ids = W.ordered(table)
        units = shape.units(table.column("text").combine_chunks())
        return table, ids, units, W.super_kmers(units, shape)

    def first_ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        kmers = cut(table)[3]
        return W.bodies(chunk, *ask_minimisers(kmers, buckets))

    def shared(table: pa.Table, replies: dict[int, bytes]):
        table, ids, units, kmers = cut(table)
        return table, ids, units, W.split_hot(units, live(kmers, ids, buckets, replies), shape, hot.value)

    def second_ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return W.bodies(0, [], [])
        chunk = table.column("chunk")[0].as_py()
        _, ids, units, kmers = shared(table, W.reply_map(replies))
        asked = [(q.bucket, W.ask(q, ids)) for q in W.questions(units, kmers, shape, buckets)]
        return W.bodies(chunk, [b for b, _ in asked], [x for _, x in asked])

    def answer(table: pa.Table) -> pa.Table:
        out = W.answers(table, lambda data, off: np.diff(off) - length + 1,
                        lambda data, off, doc: smallest_ids(data, off, doc, length))
        # the buckets of the second exchange follow those of the first
        at = out.schema.get_field_index("bucket")
        return out.set_column(at, "bucket", pa.array(np.asarray(out.column(at)) + buckets, pa.int64()))

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        found = W.reply_map(replies)
        table, ids, units, kmers = shared(table, found)
        second = {b - buckets: x for b, x in found.items() if b >= buckets}
        at = W.repeated_windows(units, kmers, shape, buckets, ids, second)
        gone = W.covered(len(units.data), at, length)
        first = units.first
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = first[:-1][first[:-1] < len(gone)]
        begins[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = first - total[first]
        return pa.table([table.column("doc_id"), pa.array(np.diff(first), pa.int64()),
                         pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
                         pa.array(spans[first[1:]] - spans[first[:-1]], pa.int64()),
                         strings(units.data[~gone], kept, pa.binary())], schema=RESULT)

    minimisers = rows.groupBy("chunk").applyInArrow(first_ask, W.BODY)
    known = minimisers.groupBy("bucket").applyInArrow(answer_minimisers, W.BODY)
    texts = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(second_ask, W.BODY)
    replies = known.unionByName(texts.groupBy("bucket").applyInArrow(answer, W.BODY))
    return (rows.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_bytes", pa.binary())])
