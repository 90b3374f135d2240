"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits; bit k is set if bit k is set in over half of the
XXH64 hashes (seed 42) of the document's word shingles, A-Z lower-cased,
repeats included.
Fingerprints within ``radius`` bits are linked; components are the closure.

Only distinct fingerprints are compared.  Their bits are cut into blocks:
``radius`` differing bits leave at least ``blocks - radius`` blocks equal,
so each fingerprint goes to a bucket for each choice of that many blocks,
and every linked pair meets in one.  The number of blocks follows from the
number of distinct fingerprints; it sets the cost, every choice finds every
link.  A bucket beyond ``TILE`` fingerprints is cut into tiles, and pairs
of tiles are compared in different tasks.

Within a bucket the bit planes of the candidates are stored vertically, 64
candidates to a machine word.  For a batch of queries the planes are added
with carry-save counters, two planes a step, and a word whose 64 candidates
all exceed the radius is abandoned.  A bucket gives a spanning forest of the
links it finds, never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked
like others; fewer words than a shingle give one shingle of them all; a null
doc_id is ignored as a component's smallest id unless it has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fundflow.llm.components import components
from fundflow.llm.text import LOWER, pieces
from fundflow.llm.windows import word_units
from fundflow.llm.rows import keyed_rows
from fundflow.session import scratch_path

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
BITS = 64
#: Words of 64 candidates compared with queries at a time.
LANES = 1 << 16


# ---------------------------------------------------------------- fingerprints
def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    units = word_units(texts)
    first = units.first
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    edge = np.concatenate([[0], np.cumsum(count)])
    votes = np.zeros((len(count), BITS), np.int64)
    buffer = memoryview(LOWER[units.data])  # white space stays: the words' places too
    digest = xxhash.xxh64_intdigest
    block = 1 << 17
    for a in range(0, int(edge[-1]), block):
        b = min(a + block, int(edge[-1]))
        row = np.searchsorted(edge, np.arange(a, b), side="right") - 1
        unit = first[row] + np.arange(a, b) - edge[row]
        start = units.starts[unit].tolist()
        end = units.ends[np.minimum(unit + shingle, first[row + 1]) - 1].tolist()
        h = np.array([digest(buffer[x:y], SEED) for x, y in zip(start, end)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, at = np.unique(row, return_index=True)
        votes[rows] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    out = np.packbits(2 * votes > count[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u8").ravel() if len(out) else np.zeros(0, np.uint64)


def fingerprinted(text: str = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint of ``text`` as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        parts = [fingerprints(texts.slice(a, b - a), shingle) for a, b in pieces(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())

    return run(F.col(text))


# ---------------------------------------------------------------- bit-sliced comparison
def planes(values: np.ndarray) -> np.ndarray:
    """64 x words: bit c of word w in plane p is bit p of fingerprint 64 w + c."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close(queries: np.ndarray, candidates: np.ndarray, radius: int = RADIUS):
    """Yields (query, candidate) index pairs at ``radius`` bits or fewer (radius up to 6)."""
    if not len(queries) or not len(candidates):
        return
    sliced = planes(candidates)
    words = sliced.shape[1]
    full = ~np.uint64(0)
    last = full >> np.uint64(words * 64 - len(candidates))
    step = max(1, LANES // words)
    for a in range(0, len(queries), step):
        mine = queries[a:a + step]
        masks = (full * ((mine[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1))).T.copy()
        q = np.repeat(np.arange(len(mine)), words)
        w = np.tile(np.arange(words), len(mine))
        ones = np.zeros(len(q), np.uint64)
        twos, fours, over = ones.copy(), ones.copy(), ones.copy()
        for p in range(0, BITS, 2):
            x = sliced[p].take(w) ^ masks[p].take(q)
            y = sliced[p + 1].take(w) ^ masks[p + 1].take(q)
            part = ones ^ x
            carry = (ones & x) | (part & y)
            ones = part ^ y
            up = twos & carry
            twos ^= carry
            over |= fours & up
            fours ^= up
            if p % 8 == 6:
                near = ~(over | _above(ones, twos, fours, radius))
                alive = near != 0
                if not alive.all():
                    q, w = q[alive], w[alive]
                    ones, twos, fours, over = ones[alive], twos[alive], fours[alive], over[alive]
                    near = near[alive]
                if not len(q):
                    break
        if len(q):
            near = np.where(w == words - 1, near & last, near)
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(bits)
            yield q[at] + a, w[at] * 64 + lane


def _above(ones, twos, fours, radius: int):
    """Lanes whose three-bit count is more than ``radius``."""
    more, same = np.uint64(0), ~np.uint64(0)
    for plane, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if bit:
            same = same & plane
        else:
            more = more | (same & plane)
            same = same & ~plane
    return more


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the links within ``left`` or between both."""
    values = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    parent = np.arange(len(values))
    for a, b in close(left, left if right is None else right, radius):
        b = b + shift
        while True:  # union of the links' roots by the smaller index
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[child], values[parent[child]]


# ---------------------------------------------------------------- buckets
def block_plan(distinct: int, radius: int = RADIUS, tile: int = TILE) -> tuple[list[tuple[int, int]], int]:
    """(first bit, width) of the blocks, and how many must agree: buckets of ``tile`` on average at most."""
    blocks = radius + 1
    while True:
        edge = [BITS * k // blocks for k in range(blocks + 1)]
        widths = [b - a for a, b in zip(edge, edge[1:])]
        agree = blocks - radius
        if distinct >> sum(sorted(widths)[:agree]) <= tile or blocks >= 16:
            return list(zip(edge, widths)), agree
        blocks += 1


def bucketed(nodes: DataFrame, plan: list[tuple[int, int]], agree: int) -> DataFrame:
    """(choice, key, fp) rows: each fingerprint once for each choice of agreeing blocks."""
    choices = []
    for k, chosen in enumerate(combinations(plan, agree)):
        key = F.lit(0).cast("long")
        for first, width in chosen:
            block = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(block)
        choices.append(F.struct(F.lit(k).alias("choice"), key.alias("key")))
    return nodes.select("fp", F.explode(F.array(*choices)).alias("c")).select("c.choice", "c.key", "fp")


def tiled(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(choice, key, i, j, side, fp): buckets beyond ``tile`` cut into pairs of tiles i <= j."""
    large = (rows.groupBy("choice", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
             .select("choice", "key", F.ceil(F.col("n") / tile).cast("int").alias("t")))
    split = rows.join(large, ["choice", "key"], "left")
    own = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("t")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("t"), F.lit(1)) - 1))
    return (split.select("choice", "key", "fp", own.alias("own"), other.alias("other"))
            .select("choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp"))


def _links(radius: int):
    def run(batches):
        """Buckets arrive sorted; the last of a batch may go on in the next."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            codes = _codes(held)
            last = int(np.flatnonzero(np.diff(codes, prepend=-1))[-1]) if len(codes) else 0
            if last:
                yield _compared(held.slice(0, last), codes[:last], radius)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield _compared(held, _codes(held), radius)

    return run


def _codes(table: pa.Table) -> np.ndarray:
    """Number of the bucket of each row."""
    step = np.zeros(table.num_rows, bool)
    for name in ("choice", "key", "i", "j"):
        column = np.asarray(table.column(name).combine_chunks())
        step[1:] |= column[1:] != column[:-1]
    return np.cumsum(step)


def _compared(table: pa.Table, codes: np.ndarray, radius: int) -> pa.RecordBatch:
    fp = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
    side = np.asarray(table.column("side").combine_chunks())
    diagonal = np.asarray(table.column("i").combine_chunks()) == np.asarray(table.column("j").combine_chunks())
    edge = np.flatnonzero(np.diff(codes, prepend=-1))
    size = np.diff(np.append(edge, len(codes)))
    out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = edge[size == 2]  # a pair: one comparison
    small = small[diagonal[small]]
    near = np.bitwise_count(fp[small] ^ fp[small + 1]) <= radius
    out_a.append(fp[small[near]])
    out_b.append(fp[small[near] + 1])
    for a, n in zip(edge[size > 2].tolist() + edge[(size == 2) & ~diagonal[edge]].tolist(),
                    size[size > 2].tolist() + size[(size == 2) & ~diagonal[edge]].tolist()):
        mine = fp[a:a + n]
        if diagonal[a]:
            x, y = forest(mine, None, radius)
        else:
            x, y = forest(mine[side[a:a + n] == 0], mine[side[a:a + n] == 1], radius)
        out_a.append(x)
        out_b.append(y)
    a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` that connect all within ``radius``."""
    plan, agree = block_plan(nodes.count(), radius)
    rows = tiled(bucketed(nodes, plan, agree))
    keys = ["choice", "key", "i", "j"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, *keys).sortWithinPartitions(*keys)
            .mapInArrow(_links(radius), "a long, b long"))


# ---------------------------------------------------------------- the operator
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS, row_key: str | None = None) -> DataFrame:
    """One row for each document: row_key, doc_id, fp (signed long), component_id, root.

    ``root`` is the smallest fingerprint of the component: it tells components
    apart where ids repeat or are missing.
    ``row_key`` is made here unless a column of stored keys is named.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    (docs.select((F.col(row_key) if row_key else F.monotonically_increasing_id()).alias("row_key"),
                 F.col(doc_id).cast("long").alias("doc_id"), fingerprinted(text, shingle).alias("fp"))
     .write.parquet(path))
    rows = spark.read.parquet(path)
    classes_path = scratch_path(spark, "fingerprint-classes")
    rows.groupBy("fp").agg(F.min("doc_id").alias("low")).write.parquet(classes_path)
    classes = spark.read.parquet(classes_path)
    found = components(fingerprint_links(classes.select("fp"), radius))
    rooted = (classes.join(found, classes["fp"] == found["node"], "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("row_key", "doc_id", "fp", "component_id", "root")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (hex), component_id."""
    return near_duplicates(docs, doc_id, text, shingle, radius).select(
        "doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id, one of repeated rows.

    ``docs`` is read once: fingerprints and kept rows both come from the stored
    rows.  A component without any id keeps its first row.
    """
    keyed = keyed_rows(docs, "near-dedup-rows")
    rows = near_duplicates(keyed, f"row.{doc_id}", f"row.{text}", shingle, radius, "row_key")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))
    keys = rows.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row_key").alias("row_key"))
    return keyed.join(keys, "row_key", "left_semi").select("row.*")
