"""Language identification: multinomial naive Bayes over hashed character n-grams.

Up to ``TRAIN_ROWS`` rows of each label train, all rows of a label below that;
the priors count every row.  Training counts hashed n-grams in Spark tasks and
sums them by (bin, label) in a shuffle; what reaches the driver is the count
matrix, bins x labels, whose size is fixed by ``bins`` and ``max_labels``
whatever the corpus.  The log-probability matrix is broadcast (bins * labels *
4 bytes, 1 MB for the defaults and four labels) and every batch is scored in
numpy: hashed n-grams are looked up and summed by document.

Letters are lower-cased and ASCII characters that are no letters count as one
space, so punctuation and digits carry no evidence.  N-grams of 1 to 3
characters of whole texts are used.

Defined results: null texts and texts without a letter give ``und`` with
score 0; with no usable training row every prediction is ``und``.  The score
is the posterior of the predicted label.  Ties go to the label that sorts
first.  Null labels never train; a label whose rows hold no n-gram is never
predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fundflow.llm.text import flat, pieces

UNDETERMINED = "und"
#: A table of labels beyond this is an error, never a silent cut.
MAX_LABELS = 1000
#: Training rows: at most about this many of each label, chosen by hash of id and text.
TRAIN_ROWS = 20_000

_FOLD = np.full(128, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


@dataclass(frozen=True)
class NgramSpec:
    bits: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5

    @property
    def bins(self) -> int:
        return 1 << self.bits


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 bytes and the row offsets counted in code points."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[first].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = lead.copy()
    for low, high, keep, extra in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[at] & keep
        for k in range(1, extra + 1):
            value = (value << np.uint32(6)) | (padded[first[at] + k] & np.uint32(0x3F))
        out[at] = value
    plain = out < 128
    out[plain] = _FOLD[out[plain]]
    latin = (out >= 0xC0) & (out <= 0xDE) & (out != 0xD7)  # upper-case Latin-1 letters
    out[latin] += 32
    return out, np.searchsorted(first, off)


def ngram_bins(points: np.ndarray, off: np.ndarray, spec: NgramSpec):
    """(bin of every n-gram, its row), n-grams that cross rows left out."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    shift = np.uint64(64 - spec.bits)
    points = points.astype(np.uint64)
    for n in spec.orders:
        if len(points) < n:
            continue
        size = len(points) - n + 1
        code = points[:size] + np.uint64(n)
        for k in range(1, n):
            code *= np.uint64(0x100000001B3)
            code += points[k:k + size]
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code >>= shift
        inside = row[:size] == row[n - 1:]
        yield code[inside].astype(np.int64), row[:size][inside]


def _counts(spec: NgramSpec, labels: list[str]):
    code = {label: k for k, label in enumerate(labels)}

    def count(batches):
        total = np.zeros(len(labels) * spec.bins, np.int64)
        for batch in batches:
            of = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int64) * spec.bins
            texts = batch.column("text")
            for a, b in pieces(texts):
                for bins, row in ngram_bins(*code_points(*flat(texts.slice(a, b - a))), spec):
                    total += np.bincount(of[a:b][row] + bins, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())],
                                         names=["cell", "n"])
    return count


@dataclass
class LanguageModel:
    labels: list[str]
    log_prob: np.ndarray  # labels x bins, float32
    log_prior: np.ndarray
    spec: NgramSpec


def train(rows: DataFrame, spec: NgramSpec = NgramSpec(), max_rows: int | None = TRAIN_ROWS) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows.

    Of each label about ``max_rows`` rows train, those whose hash of id and
    text is smallest, and all rows of a label that has no more; None uses
    every row.  A label's n-grams are its own distribution, so the size of its
    sample does not weigh: the priors do, and they count all rows.  A label
    without training n-grams is left out.
    """
    usable = rows.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    found = (usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.when(F.length("text") > 0, key)).alias("low"))
             .orderBy("lang").limit(MAX_LABELS + 1).collect())
    priors = {r["lang"]: r["n"] for r in found}
    if len(priors) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct labels")
    if max_rows is not None and max(priors.values(), default=0) > max_rows:
        # hashes are uniform: a margin of five deviations keeps max_rows rows; where few texts are
        # repeated often, at least the one of the smallest hash trains
        wanted = max_rows + 5 * max_rows ** 0.5
        cuts = [(r["lang"], 1 << 40 if r["n"] <= wanted else max(int(wanted / r["n"] * (1 << 40)), (r["low"] or 0) + 1))
                for r in found]
        cut = F.broadcast(rows.sparkSession.createDataFrame(cuts, "lang string, cut long"))
        usable = usable.join(cut, "lang").filter(key < F.col("cut")).select("doc_id", "text", "lang")
    labels = sorted(priors)
    counts = (usable.select("lang", "text").mapInArrow(_counts(spec, labels), "cell long, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((len(labels), spec.bins))
    table.ravel()[counts["cell"].to_numpy(np.int64)] += counts["n"].to_numpy(np.int64)
    trained = table.any(axis=1)
    labels = [x for x, some in zip(labels, trained) if some]
    table = table[trained] + spec.smoothing
    log_prob = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.array([priors[x] for x in labels], np.float64)
    return LanguageModel(labels, log_prob.astype(np.float32), np.log(prior / max(prior.sum(), 1)), spec)


def predictor(docs: DataFrame, model: LanguageModel):
    """A function of a text column: struct(lang_pred string, score double)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        n = len(m.labels)
        named, scores = [], []
        blank = texts.is_null().to_numpy(zero_copy_only=False)
        for a, b in pieces(texts):
            total = np.zeros((b - a, n))
            for bins, row in ngram_bins(*code_points(*flat(texts.slice(a, b - a))), m.spec):
                edges = np.searchsorted(row, np.arange(b - a + 1))
                full = np.flatnonzero(edges[1:] > edges[:-1])
                for k in range(n if len(full) else 0):
                    total[full, k] += np.add.reduceat(m.log_prob[k].take(bins), edges[full], dtype=np.float64)
            if n:
                total += m.log_prior
                best = total.argmax(axis=1)
                named += [m.labels[k] for k in best]
                scores.append(1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
            else:
                named += [UNDETERMINED] * (b - a)
                scores.append(np.zeros(b - a))
        score = np.where(blank, 0.0, np.concatenate(scores)) if scores else np.zeros(0)
        named = [UNDETERMINED if none else x for x, none in zip(named, blank)]
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(score, pa.float64())],
                                          names=["lang_pred", "score"])

    def of(text: Column) -> Column:
        return predict(F.when(text.rlike(r"\p{L}"), text))  # null: no letter

    return of


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder kept from training; null ids train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None = None, doc_id: str = "doc_id",
             text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = model or train(docs.filter(~held_out(F.col("doc_id"))))
    guess = predictor(docs, model)(F.col("text"))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guess.alias("guess"))
            .select("doc_id", "held_out", "guess.lang_pred", "guess.score"))


def determined_rows(docs: DataFrame, text: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns.

    A learned label named ``und`` is a language like any other: a row goes by its score of 0.
    """
    named = docs.select(F.col(columns.get("doc_id", "doc_id")).alias("doc_id"),
                        F.col(text).alias("text"), F.col(columns.get("lang", "lang")).alias("lang"))
    model = train(named.filter(~held_out(F.col("doc_id"))))
    guess = predictor(docs, model)
    rows = docs.select(F.struct("*").alias("row"))
    return (rows.select("row", guess(F.col(f"row.{text}")).alias("guess"))
            .filter("guess.score > 0").select("row.*"))
