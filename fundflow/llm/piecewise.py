"""Document fingerprints: context-triggered piecewise hashing.

A hash of the last ``WINDOW`` bytes decides where chunks end: at block size
``2**k`` wherever the hash ends in k zero bits, so the boundaries of a block
size are among those of the next smaller one, and an edit moves only the
boundaries around it.  Each chunk gives one of 64 letters, a signature is
their string, and a fingerprint is the exponent k of its block size and the
signatures at ``2**k``, ``2**(k+1)`` and ``2**(k+2)``: ``k:s0:s1:s2``.  k is the
smallest with less than 64 boundaries in the text (or one less, where that
leaves under ``FEW`` of them); a signature has at most 64 letters, the last of
which covers what is left.

Fingerprints compare at the finest block size they share: likeness is one
minus the edit distance of the two signatures over the longer's length,
computed for a whole batch by bit-parallel dynamic programming.  Without a
common block size it is 0; two empty signatures are alike (1).

Texts are worked off in blocks of bytes: chunk hashes come from running sums
of bytes times powers of an odd number, which need no memory for a long chunk.

``edited_neighbours`` compares every document with an edit of itself and with its
neighbour in descending id order.  Rows are sorted by range across Spark and
streamed through a task once, each with the row behind it; the last row of a
partition meets the first of the next in a join with one row a partition.

Defined results: null counts as empty; the empty text is ``0:::``; null ids
come last in the order and rows of one id in an order of their stored place;
a table of one row is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fundflow.llm import swar
from fundflow.llm.text import eights, flat, mix, pieces
from fundflow.llm.windows import placed
from fundflow.session import scratch_path

WINDOW = 7
SIGNATURES = 3
LETTERS = 64  # at most, in a signature
FEW = 16
MAX_LEVEL = 40
BLOCK = 1 << 20
#: Bytes of text a partition of the neighbour sort should hold.
PART_BYTES = 16 << 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_LETTER = np.zeros(256, np.int64)
_LETTER[ALPHABET] = np.arange(64)

_WINDOW_MASK = np.uint64((1 << (8 * WINDOW)) - 1)
_ODD = 0x9E3779B97F4A7C15
_MOD = 1 << 64
_1 = np.uint64(1)


def _powers(base: int) -> np.ndarray:
    """base**0 .. base**(BLOCK - 1) modulo 2**64."""
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the odd multiplier and of its inverse, made once a process."""

    _made = None

    def __init__(self):
        self.up, self.down = _powers(_ODD), _powers(pow(_ODD, -1, _MOD))
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))

    @classmethod
    def get(cls) -> "_Powers":
        if cls._made is None:
            cls._made = cls()
        return cls._made


def trigger_levels(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each byte, the zero bits at the end of the hash of the ``WINDOW`` bytes up to it, plus one.

    0 where the window would begin before its row, so no chunk ends there.
    """
    out = np.zeros(len(data), np.uint8)
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        low = max(a - WINDOW + 1, 0)
        if b - low < WINDOW:
            continue
        h = mix(eights(data[low:b])[:b - low - WINDOW + 1] & _WINDOW_MASK)
        level = np.bitwise_count((h & (~h + _1)) - _1)
        out[low + WINDOW - 1:b] = np.minimum(level, MAX_LEVEL) + 1
    for k in range(WINDOW - 1):  # bytes too near their row's start
        at = off[:-1] + k
        out[at[at < off[1:]]] = 0
    return out


def _row_of(off: np.ndarray, a: int, b: int) -> np.ndarray:
    """The row of each of the bytes a..b-1."""
    low, high = np.searchsorted(off, a, side="right") - 1, np.searchsorted(off, b, side="left")
    return np.repeat(np.arange(low, high), np.diff(np.clip(off[low:high + 1], a, b)))


def _first_levels(level: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The exponent of each row's smallest block size."""
    rows = len(off) - 1
    counts = np.zeros(rows * (MAX_LEVEL + 2), np.int64)
    for a in range(0, len(level), BLOCK):
        b = min(a + BLOCK, len(level))
        row = _row_of(off, a, b)
        counts += np.bincount(row * (MAX_LEVEL + 2) + level[a:b], minlength=len(counts))
    # column k: boundaries at block size 2**k
    at_least = counts.reshape(rows, -1)[:, :0:-1].cumsum(axis=1)[:, ::-1]
    fits = at_least < LETTERS
    fits[:, -1] = True
    k = fits.argmax(axis=1)
    few = (at_least[np.arange(rows), k] < FEW) & (k > 0)
    return k - few


def signatures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Exponent of each row, and for each of ``SIGNATURES`` block sizes the letters of all rows and their offsets."""
    power, rows = _Powers.get(), len(off) - 1
    level = trigger_levels(data, off)
    k = _first_levels(level, off)
    cuts = []
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        cuts.append(np.flatnonzero(level[a:b] > k[_row_of(off, a, b)]) + a)
    cuts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    row = np.searchsorted(off, cuts, side="right") - 1
    # running sums of byte * ODD**place at the rows' edges and behind every boundary
    points = np.union1d(off, cuts + 1)
    sums = np.zeros(len(points), np.uint64)
    carry, scale = np.zeros(1, np.uint64), 1
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        run = power.byte[data[a:b]]
        run *= power.up[:b - a]
        np.cumsum(run, out=run)
        run *= np.uint64(scale)
        x, y = np.searchsorted(points, [a + 1, b + 1])
        sums[x:y] = run[points[x:y] - a - 1] + carry
        carry = carry + run[-1:]
        scale = scale * pow(_ODD, BLOCK, _MOD) % _MOD
    blocks = np.array([pow(_ODD, -BLOCK * i, _MOD) for i in range(len(data) // BLOCK + 1)], np.uint64)
    out = []
    for s in range(SIGNATURES):
        mine = level[cuts] >= k[row] + s + 1
        at, whose = cuts[mine] + 1, row[mine]
        first = np.searchsorted(whose, np.arange(rows + 1))
        early = np.arange(len(at)) - first[whose] < LETTERS - 1
        at, whose = at[early], whose[early]
        # chunks end behind boundaries and at the end of their row, where that adds any byte
        order = np.argsort(np.concatenate([whose * 2, np.arange(rows) * 2 + 1]), kind="stable")
        end = np.concatenate([at, off[1:]])[order]
        of = np.concatenate([whose, np.arange(rows)])[order]
        start = np.empty(len(end), np.int64)
        start[1:] = end[:-1]
        new = np.flatnonzero(np.diff(of, prepend=-1))
        start[new] = off[:-1][of[new]]
        real = end > start
        start, end, of = start[real], end[real], of[real]
        h = sums[np.searchsorted(points, end)] - sums[np.searchsorted(points, start)]
        h *= power.down[start % BLOCK]
        h *= blocks[start // BLOCK]
        h = mix(h + (end - start).astype(np.uint64))
        out.append((ALPHABET[(h >> np.uint64(58)).astype(np.int64)], np.searchsorted(of, np.arange(rows + 1))))
    return k, out


def fingerprints(data: np.ndarray, off: np.ndarray) -> list[str]:
    """The fingerprint of each row."""
    k, made = signatures(data, off)
    texts = [letters.tobytes().decode() for letters, _ in made]
    edges = [first.tolist() for _, first in made]
    return [":".join([str(level), *(t[e[i]:e[i + 1]] for t, e in zip(texts, edges))])
            for i, level in enumerate(k.tolist())]


# ---------------------------------------------------------------- comparison
def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers as rows x LETTERS, and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(t.ljust(LETTERS, "A") for t in texts).encode(), np.uint8)
    return _LETTER[raw].reshape(-1, LETTERS), size


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of at most 64 letters, by Myers' bit-vector recurrence."""
    x, m = _matrix(a)
    y, n = _matrix(b)
    rows = np.arange(len(a))
    match = np.zeros((len(a), 64), np.uint64)  # bit j of [row, letter]: x[j] is the letter
    for j in range(int(m.max(initial=0))):
        live = rows[m > j]
        match[live, x[live, j]] |= _1 << np.uint64(j)
    top = _1 << np.maximum(m - 1, 0).astype(np.uint64)
    up = np.full(len(a), ~np.uint64(0))
    down = np.zeros(len(a), np.uint64)
    score = m.copy()
    for t in range(int(n.max(initial=0))):
        eq = match[rows, y[:, t]]
        diagonal = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(across | up), up & across
        live = n > t
        score += live & ((more & top) != 0)
        score -= live & ((less & top) != 0)
        more, less = (more << _1) | _1, less << _1
        up, down = less | ~(diagonal | more), more & diagonal
    return np.where(m == 0, n, score)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = np.zeros(len(a))
    for at in range(0, len(a), 4096):
        pairs = [(x.split(":"), y.split(":")) for x, y in zip(a[at:at + 4096], b[at:at + 4096])]
        finest = [max(int(x[0]), int(y[0])) for x, y in pairs]
        shared = [f - min(int(x[0]), int(y[0])) < SIGNATURES for f, (x, y) in zip(finest, pairs)]
        left = [x[1 + f - int(x[0])] if s else "" for f, s, (x, _) in zip(finest, shared, pairs)]
        right = [y[1 + f - int(y[0])] if s else "" for f, s, (_, y) in zip(finest, shared, pairs)]
        longest = np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64)
        value = 1 - edit_distances(left, right) / np.maximum(longest, 1)
        out[at:at + 4096] = np.where(np.array(shared, bool), value, 0.0)
    return out


# ---------------------------------------------------------------- columns
def _fingerprint(texts: pa.Array) -> pa.Array:
    out: list[str] = []
    for a, b in pieces(texts):
        out += fingerprints(*flat(texts.slice(a, b - a)))
    return pa.array(out, pa.string())


def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    missing = np.asarray(a.is_null()) | np.asarray(b.is_null())
    values = likenesses(a.fill_null("0:::").to_pylist(), b.fill_null("0:::").to_pylist())
    return pa.array(values, pa.float64(), mask=missing)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    return F.arrow_udf(_fingerprint, "string")(text.cast("string"))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null where one is null."""
    return F.arrow_udf(_likeness, "double")(a, b)


# ---------------------------------------------------------------- edits and neighbours
def edits(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code points of each row but the last, and its edited text.

    Of an edited text the last half (rounded down) of the code points gives way to as many
    of the next row's first ones.
    """
    points = swar.code_points(swar.words_of(data))
    n = np.diff(points.rank(off))
    half = n // 2
    keep = swar.code_point_at(points, off, n - half)
    ahead = np.concatenate([[0], half[:-1]])  # what the row before takes of each row
    taken = swar.code_point_at(points, off, ahead)
    whole = memoryview(np.ascontiguousarray(data))
    return n[:-1], [bytes(whole[a:b]) + bytes(whole[c:d]) for a, b, c, d in zip(
        off[:-2].tolist(), keep[:-1].tolist(), off[1:-1].tolist(), taken[1:].tolist())]


_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGE = [("part", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string())]
STORED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, part long, first_text string, last_text string")


def compared(ids: list, texts: pa.Array) -> Iterator[pa.Table]:
    """Results of every row but the last, each against the row behind it; pieces share their edge row."""
    start = 0
    for a, b in pieces(texts):
        a, start = start, b - 1  # from the row before, which met no next one yet
        if b - a < 2:
            continue
        data, off = flat(texts.slice(a, b - a))
        mine = fingerprints(data, off)
        n, changed = edits(data, off)
        size = np.cumsum([0] + [len(x) for x in changed])
        theirs = fingerprints(np.frombuffer(b"".join(changed), np.uint8), size)
        yield pa.table([
            pa.array(ids[a:b - 1], pa.int64()), pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
            pa.array(mine[:-1]), pa.array(theirs), pa.array(likenesses(mine[:-1], theirs)),
            pa.array(likenesses(mine[:-1], mine[1:]))], schema=pa.schema(_ROW))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: results of all rows but the last, and one row with both edges."""
    part = TaskContext.get().partitionId()
    first, last = None, None
    schema = pa.schema(_ROW + _EDGE)
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text").cast(pa.string()).fill_null("")
        ids = batch.column("doc_id").to_pylist()
        if last is not None:
            ids, texts = [last[0], *ids], pa.concat_arrays([last[1], texts])
        else:
            first = pa.array([texts[0].as_py()], pa.string())
        for done in compared(ids, texts):
            blank = [pa.nulls(done.num_rows, kind) for _, kind in _EDGE]
            yield from pa.table([*done.columns, *blank], schema=schema).to_batches()
        last = (ids[-1], pa.array([texts[-1].as_py()], pa.string()))
    if last is not None:
        blank = [pa.nulls(1, kind) for _, kind in _ROW[1:]]
        yield from pa.table([pa.array([last[0]], pa.int64()), *blank, pa.array([part], pa.int64()),
                             first, last[1]], schema=schema).to_batches()


_PAIR = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against(texts: pa.Array, following: pa.Array) -> pa.Array:
    rows = []
    for text, behind in zip(texts, following):
        both = pa.array([text.as_py() or "", behind.as_py() or ""], pa.string())
        rows += [{k: v for k, v in r.items() if k != "doc_id"} for t in compared([None, None], both) for r in t.to_pylist()]
    return pa.array(rows, pa.struct(_ROW[1:]))


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the columns of _ROW."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]
    parts = max(-(-int(size) // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("doc_id").desc_nulls_last(), F.col("place").asc())
    path = scratch_path(spark, "edited-neighbours")
    (placed(docs, doc_id, text).select("doc_id", "place", F.col("text").cast("string").alias("text"))
     .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(_streamed, STORED).write.parquet(path))
    stored = spark.read.parquet(path)
    columns = [name for name, _ in _ROW]
    edges = stored.filter("part is not null").select("part", "doc_id", "first_text", "last_text")
    held = sorted(r["part"] for r in edges.select("part").collect())  # a number for each partition of the sort
    behind = spark.createDataFrame([(p, q) for p, q in zip(held, held[1:] + held[:1])], "part long, next_part long")
    firsts = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    ends = (edges.join(behind, "part").join(firsts, "next_part")
            .select("doc_id", F.arrow_udf(_against, _PAIR)("last_text", "next_text").alias("r")).select("doc_id", "r.*"))
    return stored.filter("part is null").select(*columns).unionByName(ends.select(*columns))
