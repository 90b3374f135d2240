"""Substring deduplication by super-k-mers of words.

Every word covered by a window of ``window`` consecutive words that also
starts in a document with a smaller doc_id is removed; windows are judged on
the input.  Consecutive windows that share a minimiser travel as one packed
string to its bucket, where the windows are sorted and counted exactly (see
``windows``).

Defined results: null and empty texts have no words and keep an empty text;
texts of fewer words than a window lose nothing; a null doc_id counts as the
largest; rows with equal ids (repeated rows) do not remove each other's
words; every row of the input gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fundflow.llm import windows as W
from fundflow.llm.text import joined, strings

WINDOW = 13
GRAM = 3  # words of a minimiser
#: Bytes that super-k-mers take for each byte of text, for the number of buckets.
SPREAD = 3


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_text (words joined by one space)."""
    gram = min(gram, window)
    shape = W.Shape(window, gram, W.word_units, W.word_grams)
    rows, total = W.dealt(docs, doc_id, text)
    buckets = max(1, -(-SPREAD * total // W.BUCKET_BYTES))
    hot = docs.sparkSession.sparkContext.broadcast(W.hot_minimisers(docs, text, shape, buckets * W.PARTS))

    def cut(table: pa.Table):
        table, ids = W.ordered(table)
        units = shape.units(table.column("text").combine_chunks())
        return table, ids, units, W.split_hot(units, W.super_kmers(units, shape), shape, hot.value)

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, ids, units, kmers = cut(table)
        asked = [(q.bucket, W.ask(q, ids)) for q in W.questions(units, kmers, shape, buckets)]
        return W.bodies(chunk, [b for b, _ in asked], [x for _, x in asked])

    def answer(table: pa.Table) -> pa.Table:
        return W.answers(table, lambda data, off: W.word_window_counts(data, off, window),
                         lambda data, off, doc: W.word_windows(data, off, doc, window))

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        table, ids, units, kmers = cut(table)
        at = W.repeated_windows(units, kmers, shape, buckets, ids, W.reply_map(replies))
        gone = W.covered(len(units.starts), at, window)
        n_words = np.diff(units.first)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[units.first[1:]] - total[units.first[:-1]]
        keep = ~gone
        kept_first = units.first - total[units.first]
        data, off = joined(units.data, units.starts[keep], units.ends[keep], kept_first)
        return pa.table([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                         strings(data, off)], schema=RESULT)

    asked = rows.groupBy("chunk").applyInArrow(ask, W.BODY)
    replies = asked.groupBy("bucket").applyInArrow(answer, W.BODY)
    return (rows.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text string"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("kept_text", pa.string())])
