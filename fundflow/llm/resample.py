"""Target-distribution importance resampling over hashed word n-grams.

Every document is weighted by how much likelier its features are in a target
set than in the corpus, and a share of the documents is drawn without
replacement by the Gumbel top-k rule: weight plus a hashed Gumbel number, the
highest first.

A batch's texts are joined with a sentinel byte that UTF-8 never holds.  One
regular-expression pass over the joined buffer finds all words and sentinels;
the places of the sentinels are the documents' offsets, a ``searchsorted`` in
them gives each word's document, and n-grams whose first and last word lie in
different documents are masked before the buckets are counted.  Buffers are
worked off in segments of bounded size that carry over the last n - 1
words, so a very long text needs no more memory for its words than others.

What is broadcast is one number a bucket.  Documents never move: only bucket
counts and (id, weight, score) rows are shuffled.  Ranks come from a range
sort whose partitions are stored with each row's place; the partitions'
sizes, one number each, give the offsets.

Defined results: null and empty texts have no features and weight 0; a null
id is hashed as ``null`` and ordered last among equal scores; rows equal in
score and id are ranked in stored order; with empty tables nothing is drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fundflow.llm.text import LOWER, flat, pieces
from fundflow.session import scratch_path

NGRAM = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
SEGMENT_BYTES = 1 << 20

SENTINEL = b"\xff"  # in no UTF-8 text
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text, or a sentinel.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xfe]")


def joined(texts: pa.Array) -> bytes:
    """The lower-cased texts, a sentinel behind each."""
    data, off = flat(texts)
    out = np.empty(len(data) + len(off) - 1, np.uint8)
    end = off[1:] + np.arange(len(off) - 1)
    body = np.ones(len(out), bool)
    body[end] = False
    out[end] = SENTINEL[0]
    out[body] = LOWER[data]
    return out.tobytes()


def _codes(found: list[bytes], n: int, buckets: int):
    """Bucket of every n-gram of 1..n tokens by its last token: (tokens in it, last token, bucket)."""
    coded = pa.array(found, pa.binary()).dictionary_encode()
    listed, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
    yield 1, np.array([zlib.crc32(x) % buckets for x in listed], np.int64)[code]
    gram = code
    for m in range(2, n + 1):
        # numbers of the distinct m-grams: of their first m - 1 tokens and the last one
        both, at, gram = np.unique(gram[:-1] * len(listed) + code[m - 1:], return_index=True, return_inverse=True)
        texts = [b" ".join(found[k:k + m]) for k in at.tolist()]
        yield m, np.array([zlib.crc32(x) % buckets for x in texts], np.int64)[gram]


def grams(texts: pa.Array, n: int = NGRAM, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of a piece of texts, segment by segment, and the row of every word."""
    buffer, at, row, carried = joined(texts), 0, 0, []
    while at < len(buffer):
        end = min(at + SEGMENT_BYTES, len(buffer))
        stop = _BREAK.search(buffer, end)  # no segment ends within a word
        end = stop.start() if stop and end < len(buffer) else len(buffer)
        found = carried + _TOKEN.findall(buffer, at, end)
        old, at = len(carried), end
        if not found:
            continue
        if at < len(buffer) and len(found) > n - 1:
            carried = found[len(found) - (n - 1):]
        elif at < len(buffer):
            carried = found
        sentinel = np.fromiter((x == SENTINEL for x in found), bool, len(found))
        offsets = np.flatnonzero(sentinel)  # where documents end
        document = row + np.searchsorted(offsets, np.arange(len(found)), side="left")
        rows, codes = [], []
        for m, bucket in _codes(found, n, buckets):
            first, last = np.arange(len(bucket)), np.arange(m - 1, len(found))
            inside = ~sentinel[first] & ~sentinel[last] & (document[first] == document[last])
            inside &= last >= old  # those of carried words alone have been counted
            rows.append(document[last[inside]])
            codes.append(bucket[inside])
        yield np.concatenate(rows), np.concatenate(codes), document[old:][~sentinel[old:]]
        # carried sentinels come again with the next segment
        row = int(document[-1]) + int(sentinel[-1]) - sum(x == SENTINEL for x in carried) if at < len(buffer) else row


def bucket_counts(table: DataFrame, text: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all texts: one number a bucket reaches the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in pieces(texts):
                for _, bucket, _ in grams(texts.slice(a, b - a), n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = (table.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of add-one shares) of each bucket, in doubles."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; ``gain`` is one number a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 3), np.int64)
        for a, b in pieces(texts):
            size = b - a
            for row, bucket, word in grams(texts.slice(a, size), n, len(shared.value)):
                out[a:b, 0] += np.bincount(word, minlength=size)
                out[a:b, 1] += np.bincount(row, minlength=size)
                np.add.at(out[a:b, 2], row, shared.value[bucket])
        return pa.StructArray.from_arrays([pa.array(x) for x in out.T.copy()], names=["n_words", "n_features", "weight"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), weigh(F.col(text).cast("string")).alias("w"))
            .select("doc_id", "w.*"))


def gumbel(doc_id, seed: int = SEED):
    """floor(-1000 ln(-ln u)), u from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def ranked(scored: DataFrame, drawable, percent: int = PERCENT) -> DataFrame:
    """``scored`` with rank 1, 2, ... for the drawn rows: ``percent`` of the drawable ones, highest score first.

    ``scored`` needs doc_id and score; ``drawable`` is a condition on it.
    """
    spark = scored.sparkSession
    keyed = scratch_path(spark, "resample-scores")
    scored.select("*", drawable.alias("_drawable"), F.monotonically_increasing_id().alias("_key")).write.parquet(keyed)
    order = (F.col("_drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_key").asc())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row's number in its sorted partition, stored with it: the same on every later read
    placed = scratch_path(spark, "resample-order")
    number = F.monotonically_increasing_id()
    (spark.read.parquet(keyed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .select("*", number.alias("_at")).write.parquet(placed))
    rows = spark.read.parquet(placed).withColumns(
        {"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.count_if("_drawable").alias("_d"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    everyone = Window.partitionBy()
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.floor(F.sum("_d").over(everyone) * percent / 100).alias("_draws"))
    rank = F.col("_before") + F.col("_at") + 1
    return (rows.join(F.broadcast(sizes), "_part")  # one row a partition of the sort
            .withColumn("rank", F.when(rank <= F.col("_draws"), rank))
            .drop("_drawable", "_key", "_at", "_part", "_before", "_draws"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             n: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score, rank (null where not drawn)."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    scored = weights(docs, gain, doc_id, text, n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, F.col("n_words") >= min_words, percent)
