"""Benchmark decontamination with suffix arrays over shards of the training text.

Words are numbered by the benchmark's vocabulary (exactly: a word whose hash
is known is compared byte by byte).  Every shard of documents gets a suffix
array over its words: the positions sorted by the ``window`` word numbers that start
there.  Only positions that begin with two words that begin some benchmark
suffix are kept, as no other position can match two words.  Every benchmark
window is then searched in the array by bisection; the interval it finds are all
its verbatim occurrences.  A document's longest verbatim run comes with it.

``longest_matches`` goes on from there: the windows found, in the order of their
places, are sorted as suffixes of any length by doubling, and every benchmark
suffix takes its longest match in the shard from its two neighbours in that order.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text; a
benchmark beyond that is worked off block by block, the state of every
document stored between blocks.  Blocks are cut from the distinct items, so
a repeated item fills no block; an item of more than a quarter of a block is
cut into pieces that overlap by a window less a word, so every window is in
one of them.  Documents never move: no shuffle, whatever their sources or copies.

Defined results: null texts have no words; an item without words matches
nothing; an item of fewer words than a window is one window; a null item_id
counts as its own item named ``null``; repeated item ids count once.  A
document without words is never contaminated.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fundflow.llm.text import ALNUM, LOWER, equal_spans, flat, pieces, span_hash, words
from fundflow.session import scratch_path

WINDOW = 13
BLOCK_BYTES = 4 << 20


@dataclass
class TestSet:
    """A block of benchmark items: vocabulary, sorted distinct windows, first pairs."""

    hashes: np.ndarray  # of the vocabulary, sorted
    data: np.ndarray  # the vocabulary's bytes
    starts: np.ndarray
    ends: np.ndarray
    windows: np.ndarray  # distinct windows as rows of word numbers, 0 beyond a short item
    lengths: np.ndarray
    items: list[list[str]]  # of every distinct window
    firsts: np.ndarray  # sorted codes of the first two words (the second 0 for one word)
    width: int
    deep: int  # the most words of the vocabulary that share a hash
    windows_at: np.ndarray  # window + 1 of every item place in turn, 0 behind an item
    items_at: list[str]  # item of the same places
    starts_at: np.ndarray  # first word of the same places


def _lowered(texts: pa.Array):
    data, off = flat(texts)
    data = LOWER[data]
    return data, off, *words(data, off, ALNUM)


def prepare(ids: list, texts: list, width: int = WINDOW) -> TestSet:
    data, off, starts, ends, first = _lowered(pa.array(texts, pa.string()))
    vocabulary: dict[bytes, int] = {}
    number = [vocabulary.setdefault(data[a:b].tobytes(), len(vocabulary) + 1) for a, b in zip(starts, ends)]
    joined = b"".join(vocabulary)
    end = np.cumsum([len(w) for w in vocabulary], dtype=np.int64) if vocabulary else np.zeros(0, np.int64)
    start = end - np.array([len(w) for w in vocabulary], np.int64)
    raw = np.frombuffer(joined, np.uint8)
    hashes = span_hash(raw, start, end)
    order = np.argsort(hashes, kind="stable")
    deep = int(np.unique(hashes, return_counts=True)[1].max(initial=0))
    rank = np.empty(len(order) + 1, np.int64)
    rank[0], rank[order + 1] = 0, np.arange(1, len(order) + 1)
    found: dict[tuple, tuple[int, set[str]]] = {}
    windows_at, items_at, starts_at = array("q"), [], array("q")
    for k, item in enumerate(ids):
        mine = rank[number[first[k]:first[k + 1]]].tolist()
        name = "null" if item is None else str(item)
        places = max(1, len(mine) - width + 1) if mine else 0
        for at in range(places):
            index, names = found.setdefault(tuple(mine[at:at + width]), (len(found), set()))
            names.add(name)
            windows_at.append(index + 1)
        windows_at.append(0)
        items_at += [name] * (places + 1)
        starts_at.extend(range(places + 1))
    table = np.zeros((len(found), width), np.int64)
    for k, window in enumerate(found):
        table[k, :len(window)] = window
    lengths = np.array([len(w) for w in found], np.int64)
    firsts = np.unique((table[:, 0] << 32) | table[:, 1]) if width > 1 else np.unique(table[:, 0] << 32)
    return TestSet(hashes[order], raw, start[order], end[order], table, lengths,
                   [sorted(names) for _, names in found.values()], firsts, width, deep,
                   np.array(windows_at, np.int64), items_at, np.array(starts_at, np.int64))


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as fixed-width byte strings that sort like the rows."""
    flat_rows = np.ascontiguousarray(rows.astype(">u4"))
    return flat_rows.view(f"S{4 * rows.shape[1]}").ravel()


def occurrences(test: TestSet, texts: pa.Array):
    """(word offsets of the rows, row of every word, first word and window of every occurrence)."""
    data, off, starts, ends, first = _lowered(texts)
    n, width = len(starts), test.width
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    none = np.zeros(0, np.int64)
    if not n or not len(test.windows):
        return first, row, none, none
    code = span_hash(data, starts, ends)
    both = np.concatenate([data, test.data])
    number = np.zeros(n + width, np.int64)
    low = np.searchsorted(test.hashes, code)
    for k in range(test.deep):  # words that share a hash stand side by side
        at = np.minimum(low + k, len(test.hashes) - 1)
        maybe = np.flatnonzero((test.hashes[at] == code)
                               & (test.ends[at] - test.starts[at] == ends - starts))
        same = equal_spans(both, starts[maybe], test.starts[at[maybe]] + len(data), (ends - starts)[maybe])
        number[maybe[same]] = at[maybe[same]] + 1
    last = first[row + 1]  # word offset at which the word's document ends
    # suffix array of the positions that can match at least two words (or a whole one-word item)
    second = np.where(np.arange(n) + 1 < last, number[1:n + 1], 0)
    pair = (number[:n] << 32) | second
    can = np.isin(pair, test.firsts) | np.isin(number[:n] << 32, test.firsts)
    place = np.flatnonzero(can & (number[:n] > 0))
    if not len(place):
        return first, row, none, none
    reach = place[:, None] + np.arange(width)
    suffix = np.where(reach < last[place][:, None], number[np.minimum(reach, n + width - 1)], 0)
    keys = _keys(suffix)
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    # the interval of suffixes that begin with each window
    top = np.where(np.arange(width) < test.lengths[:, None], test.windows, 0xFFFFFFFF)
    low = np.searchsorted(keys, _keys(test.windows), side="left")
    high = np.searchsorted(keys, _keys(top), side="right")
    count = high - low
    window = np.repeat(np.arange(len(low)), count)
    where = place[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
    return first, row, where, window


def shard_hits(test: TestSet, texts: pa.Array):
    """(hit mask of all words, word offsets of the rows, row and window of every occurrence)."""
    first, row, where, window = occurrences(test, texts)
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + test.lengths[window], -1)
    return np.cumsum(edge[:-1]) > 0, first, row[where], window


def _ranks(sequence: np.ndarray, at: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes at ``at`` by their first 1, 2, 4, ... entries; a suffix ends after ``run`` entries.

    Doubling stops where a further step tells no more suffixes apart.
    """
    levels, known = [sequence], len(np.unique(sequence[at]))
    while True:
        step, rank = 1 << (len(levels) - 1), levels[-1]
        behind = np.zeros(len(at), np.int64)
        longer = run[at] > step
        behind[longer] = rank[at[longer] + step]
        pairs, place = np.unique(rank[at] * (int(rank.max()) + 1) + behind, return_inverse=True)
        levels.append(np.zeros_like(rank))
        levels[-1][at] = place + 1
        if len(pairs) == known:
            return levels
        known = len(pairs)


def _common(levels: list[np.ndarray], run: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entries that the suffixes at ``a`` and ``b`` have in common from their start."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + total, b + total  # a suffix that has ended stands at a 0, whose run is 0
        total += ((run[x] >= 1 << k) & (run[y] >= 1 << k) & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return np.where(levels[-1][a] == levels[-1][b], run[a], total)


def shard_longest(test: TestSet, texts: pa.Array):
    """(benchmark place, words, row, first word in the row) of every benchmark suffix with a match in the shard.

    The longest verbatim match of the suffix, at least a window long, and one
    place where it stands.
    """
    first, row, where, window = occurrences(test, texts)
    none = np.zeros(0, np.int64)
    if not len(where):
        return none, none, none, none
    # places of the shard, one 0 behind every row, then those of the benchmark whose window was found
    whole = test.lengths[window] == test.width
    shard = np.zeros(len(row) + len(first) + 1, np.int64)
    spread = where[whole] + row[where[whole]]
    shard[spread] = window[whole] + 1
    one = np.full(len(test.windows) + 1, -1, np.int64)  # a place of each window
    one[window + 1] = where
    asked = np.flatnonzero(one[test.windows_at] >= 0)
    asked = asked[test.windows_at[asked] > 0]
    length = test.lengths[test.windows_at[asked] - 1]
    place = one[test.windows_at[asked]]
    long = np.flatnonzero(length == test.width)
    if len(long):
        item = np.zeros(len(test.windows_at), np.int64)
        item[asked[long]] = test.windows_at[asked[long]]
        sequence = np.concatenate([shard, item, [0]])
        ends = np.flatnonzero(sequence == 0)
        run = ends[np.searchsorted(ends, np.arange(len(sequence)))] - np.arange(len(sequence))
        levels = _ranks(sequence, np.flatnonzero(sequence), run)
        spread = np.unique(spread)
        spread = spread[np.argsort(levels[-1][spread], kind="stable")]
        mine = asked[long] + len(shard)
        at = np.searchsorted(levels[-1][spread], levels[-1][mine])
        above, below = spread[np.minimum(at, len(spread) - 1)], spread[np.maximum(at - 1, 0)]
        up, down = (_common(levels, run, mine, x) for x in (above, below))
        length[long] = np.maximum(up, down) + test.width - 1
        best = np.where(up >= down, above, below)
        of_row = np.searchsorted(first[1:] + np.arange(1, len(first)), best, side="right")
        place[long] = best - of_row
    return asked, length, row[place], place - first[row[place]]


def _longest_runs(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Longest run of true values in each row."""
    out = np.zeros(len(first) - 1, np.int64)
    if hit.any():
        before = np.concatenate([[False], hit[:-1]])
        inner = first[:-1][first[:-1] < len(hit)]
        before[inner] = False
        start = np.flatnonzero(hit & ~before)
        after = np.concatenate([hit[1:], [False]])
        after[first[1:][first[1:] > 0] - 1] = False
        length = np.flatnonzero(hit & ~after) - start + 1
        np.maximum.at(out, np.searchsorted(first, start, side="right") - 1, length)
    return out


SCHEMA = "n_words long, n_hit long, longest_run long, hits binary, items array<string>"


def _pass(shared):
    """Adds one block's matches to the (hits, items) found so far."""

    def run(texts: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        test = shared.value
        n_words, n_hit, runs, bits, names = [], [], [], [], []
        for a, b in pieces(texts):
            hit, first, rows, windows = shard_hits(test, texts.slice(a, b - a))
            found: list[set[str]] = [set(x or ()) for x in items.slice(a, b - a).to_pylist()]
            for r, w in set(zip(rows.tolist(), windows.tolist())):
                found[r].update(test.items[w])
            for k, old in enumerate(hits.slice(a, b - a).to_pylist()):
                mine = hit[first[k]:first[k + 1]]
                if old:
                    mine |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(mine)).astype(bool)
                bits.append(np.packbits(mine).tobytes() if mine.any() else b"")
            n_words.append(np.diff(first))
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit.append(total[first[1:]] - total[first[:-1]])
            runs.append(_longest_runs(hit, first))
            names += [sorted(x) for x in found]
        whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.StructArray.from_arrays(
            [whole(n_words), whole(n_hit), whole(runs), pa.array(bits, pa.binary()),
             pa.array(names, pa.list_(pa.string()))],
            names=["n_words", "n_hit", "longest_run", "hits", "items"])

    return F.arrow_udf(run, SCHEMA)


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row struct of docs, m struct of SCHEMA): every row with its matches in the whole benchmark."""
    spark = docs.sparkSession
    parts = _blocks(benchmark, item_id, item_text, block_bytes, width)
    state = docs.select(F.struct("*").alias("row"), F.lit(None).cast(f"struct<{_ddl()}>").alias("m"))
    for k, part in enumerate(parts):
        step = _pass(_shared(part, width))
        state = state.select("row", step(F.col(f"row.{text}"), F.col("m.hits"), F.col("m.items")).alias("m"))
        if k + 1 < len(parts):
            path = scratch_path(spark, "decontamination")
            state.write.parquet(path)
            state = spark.read.parquet(path)
    return state


LONGEST = pa.schema([("item_id", pa.string()), ("item_start", pa.int64()), ("length", pa.int64()),
                     ("doc_id", pa.int64()), ("doc_start", pa.int64())])


def _longest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in pieces(texts):
                test = shared.value
                at, length, row, start = shard_longest(test, texts.slice(a, b - a))
                if len(at):
                    yield pa.record_batch([
                        pa.array([test.items_at[k] for k in at.tolist()], pa.string()), pa.array(test.starts_at[at]),
                        pa.array(length), ids.slice(a, b - a).take(pa.array(row)), pa.array(start)], schema=LONGEST)

    return run


def _item_pieces(size: int, width: int):
    """Items cut into pieces of about ``size`` bytes, ``width`` words at least; each window is in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("i"), batch.column("t")):
                raw = text.as_py().encode()
                starts, ends = _lowered(pa.array([text.as_py()], pa.string()))[2:4]
                at = end = 0
                while end < len(starts):
                    end = int(np.searchsorted(ends, starts[at] + size, side="right"))
                    end = min(max(end, at + width), len(starts))
                    piece = raw[starts[at]:ends[end - 1]].decode()
                    yield pa.record_batch([pa.array([item.as_py()], pa.string()), pa.array([piece], pa.string())],
                                          names=["i", "t"])
                    at = end - width + 1

    return run


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int,
            width: int | None = None) -> list[DataFrame]:
    """The distinct items (i, t), cut into blocks of about ``block_bytes``; with ``width`` long items in pieces."""
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    sizes = F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n"), F.max(F.octet_length("t")).alias("longest")
    size, longest = bench.agg(*sizes).first()
    if width and (longest or 0) > block_bytes // 4:
        long = F.coalesce(F.octet_length("t") > block_bytes // 4, F.lit(False))
        cut = bench.filter(long).mapInArrow(_item_pieces(block_bytes // 4, width), "i string, t string")
        bench = bench.filter(~long).unionByName(cut)
        size = bench.agg(*sizes).first()["n"]
    blocks = max(1, -(-int(size) // block_bytes))
    return [bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
            for k in range(blocks)]


def _shared(part: DataFrame, width: int):
    rows = part.collect()  # about block_bytes of text
    return part.sparkSession.sparkContext.broadcast(prepare([r["i"] for r in rows], [r["t"] for r in rows], width))


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", width: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of LONGEST: each benchmark suffix (item, first word) whose first ``width`` words stand in a document.

    ``length`` is its longest verbatim match in any document, in words; ``doc_id`` and
    ``doc_start`` name a place of it: of each shard's one, that of the largest id and
    start.  A whole item of fewer words counts as one suffix.  Rows that repeat an
    item_id with other texts share their places; the longest match is kept.  Items stay
    whole here, so a block holds at least one.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ddl = "item_id string, item_start long, length long, doc_id long, doc_start long"
    found = None
    for part in _blocks(benchmark, item_id, item_text, block_bytes):
        one = docs.mapInArrow(_longest(_shared(part, width)), ddl)
        found = one if found is None else found.unionAll(one)
    best = F.max(F.struct("length", "doc_id", "doc_start")).alias("best")
    return found.groupBy("item_id", "item_start").agg(best).select(
        "item_id", "item_start", "best.length", "best.doc_id", "best.doc_start")


def _ddl() -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in SCHEMA.split(", "))


def is_contaminated():
    """The contract's rule: a hit, and at least a twentieth of the words hit."""
    return (F.col("m.n_hit") > 0) & (F.col("m.n_hit") * 20 >= F.col("m.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
           **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, longest_run, items (sorted ids), contaminated."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return match(docs, benchmark, **options).select(
        "row.doc_id", "m.n_words", "m.n_hit", "m.longest_run", "m.items", is_contaminated().alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return match(docs, benchmark, text, **options).filter(~is_contaminated()).select("row.*")
