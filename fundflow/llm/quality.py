"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees boosted in turn, one feature after another, learn a lookup
table for each feature; the pairs of features that explain most of what is
left get two-dimensional tables the same way.  A document is scored by
adding the table cells its bins select, for a whole batch at once.

Features are computed from the text alone.  Training uses at most
``TRAIN_ROWS`` labelled documents (those whose hash comes first; labels without
a document never count), so what is joined by broadcast and what reaches the
driver is bounded whatever the corpus: 16 bytes and ``len(FEATURES)`` doubles a row.

Defined results: null and empty texts have all-zero features and get the
score those features select; unlabelled rows and null labels never train;
with no training row every score is 0.5; a repeated label row trains once,
conflicting labels of one id count as the lower one.  Ids may be null (such
documents are scored, never trained on).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fundflow.llm.language_id import held_out
from fundflow.llm.text import SPACED, flat, pieces, span_hash, words

TRAIN_ROWS = 20_000
ACCEPT = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digit", "symbol", "bang",
    "bar", "non_ascii", "stop", "distinct_words", "word_repeat", "symbol_end", "bytes_per_line",
    "repeated_lines",
)

_CLASS = np.zeros((256, 7), bool)  # upper, digit, symbol, bang, bar, non-ASCII, sentence marks
_CLASS[0x41:0x5B, 0] = True
_CLASS[0x30:0x3A, 1] = True
_CLASS[[ord(c) for c in "#$%&*@~^<>{}[]=+_/\\|"], 2] = True
_CLASS[ord("!"), 3] = True
_CLASS[ord("|"), 4] = True
_CLASS[0x80:, 5] = True
_CLASS[[ord(c) for c in ".,;:?"], 6] = True
_END = _CLASS[:, 2] | _CLASS[:, 3]
_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct keys in each row."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    one = np.unique(keys ^ (row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(row[one].astype(np.int64), minlength=len(first) - 1)


def features(texts: pa.Array) -> np.ndarray:
    """rows x len(FEATURES) of one piece of a batch."""
    data, off = flat(texts)
    n_bytes = np.diff(off).astype(float)
    starts, ends, first = words(data, off, SPACED)
    n_words = np.diff(first).astype(float)
    length = (ends - starts).astype(float)
    some, per = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    shares = [_per_row(_CLASS[:, k][data], off) / some for k in range(7)]
    mean = _per_row(length, first) / per
    spread = np.sqrt(np.maximum(_per_row(length ** 2, first) / per - mean ** 2, 0))
    keys = span_hash(data, starts, ends)
    again = np.zeros(len(keys))
    again[1:] = keys[1:] == keys[:-1]
    again[first[:-1][first[:-1] < len(keys)]] = 0
    line_starts, line_ends, line_first = words(data, off, _LINES)
    n_lines = np.maximum(np.diff(line_first), 1).astype(float)
    lines = _distinct(span_hash(data, line_starts, line_ends), line_first)
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(n_words), mean, spread, *shares[:6], shares[6],
        _distinct(keys, first) / per, _per_row(again, first) / per,
        _per_row(_END[data[ends - 1]] if len(ends) else np.zeros(0), first) / per,
        np.log1p(n_bytes / n_lines), 1 - lines / n_lines * (n_bytes > 0) - (n_bytes == 0)])


@dataclass(frozen=True)
class BoostSpec:
    bins: int = 48
    pair_bins: int = 12
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 8
    leaves: int = 3
    rate: float = 0.15
    ridge: float = 2.0


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cut, x[:, k], side="right")]
        coarse = [np.searchsorted(cut, x[:, k], side="right") for k, cut in enumerate(self.pair_cuts)]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            out += table[coarse[f], coarse[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, spec: BoostSpec) -> np.ndarray:
    """Values by bin of a regression tree with ``spec.leaves`` leaves on one binned feature."""
    gain_of = lambda a, b: a * a / (b + spec.ridge)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    leaves = [(0, len(g))]
    while len(leaves) < spec.leaves:
        best = (1e-12, None, None)
        for leaf in leaves:
            a, b = leaf
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = (gain_of(cg[at] - cg[a], ch[at] - ch[a]) + gain_of(cg[b] - cg[at], ch[b] - ch[at])
                    - gain_of(cg[b] - cg[a], ch[b] - ch[a]))
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], leaf, int(at[k]))
        if best[1] is None:
            break
        a, b = best[1]
        leaves.remove((a, b))
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + spec.ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, spec: BoostSpec) -> tuple[np.ndarray, float]:
    """Values by cell of a depth-two tree on a pair of binned features, and its gain."""
    best, out = -1.0, np.zeros_like(g)
    two = BoostSpec(leaves=2, ridge=spec.ridge)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        cg, ch = np.cumsum(gg, axis=0), np.cumsum(hh, axis=0)
        for cut in range(1, len(gg)):
            value, gain = np.zeros_like(gg), 0.0
            for part, (pg, ph) in ((slice(0, cut), (cg[cut - 1], ch[cut - 1])),
                                   (slice(cut, None), (cg[-1] - cg[cut - 1], ch[-1] - ch[cut - 1]))):
                leaf = _tree(pg, ph, two)
                value[part] = leaf
                gain += float((leaf * pg).sum())
            if gain > best:
                best, out = gain, value if axis == 0 else value.T
    return out, best


def fit(x: np.ndarray, y: np.ndarray, spec: BoostSpec = BoostSpec()) -> AdditiveModel:
    """Cyclic gradient boosting of lookup tables on rows x features."""
    model = AdditiveModel()
    if not len(y):
        return model
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(rate / (1 - rate)))
    m = x.shape[1]
    model.cuts = [_quantile_cuts(x[:, k], spec.bins) for k in range(m)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    logit = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(spec.rounds):
        for k in range(m):
            g, h = slopes()
            size = len(model.tables[k])
            step = spec.rate * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), spec)
            model.tables[k] += step
            logit += step[bins[k]]
    model.pair_cuts = [_quantile_cuts(x[:, k], spec.pair_bins) for k in range(m)]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]

    def cells(f, g_, v):
        return np.bincount(coarse[f] * size[g_] + coarse[g_], v, size[f] * size[g_]).reshape(size[f], size[g_])

    g, h = slopes()
    ranked = sorted(((-_pair_tree(cells(a, b, g), cells(a, b, h), spec)[1], a, b)
                     for a in range(m) for b in range(a + 1, m)))
    model.pairs = [(a, b) for _, a, b in ranked[:spec.pairs]]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(spec.pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = spec.rate * _pair_tree(cells(a, b, g), cells(a, b, h), spec)[0]
            model.pair_tables[k] += step
            logit += step[coarse[a], coarse[b]]
    return model


def feature_column(texts: pa.Array) -> pa.Array:
    rows = [features(texts.slice(a, b - a)) for a, b in pieces(texts)]
    x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), x.ravel())


def train(docs: DataFrame, labels: DataFrame, spec: BoostSpec = BoostSpec(),
          max_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learn from at most ``max_rows`` rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) cover."""
    known = (labels.filter("doc_id is not null and label is not null")
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    # labels of other tables' documents take no place of the sample; ids alone are shuffled, one of each
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (docs.join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers
            .select("label", F.xxhash64("doc_id", "text").alias("rank"),
                    F.arrow_udf(feature_column, "array<double>")("text").alias("x"))
            .orderBy("rank").limit(max_rows).toPandas())
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(float), spec)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality", model: AdditiveModel | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    outside = held_out(F.col("doc_id"))
    model = model or train(docs.filter(~outside), labels.select(
        F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter(~outside))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = [shared.value.score(features(texts.slice(a, b - a))) for a, b in pieces(texts)]
        return pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64())

    return (docs.select("doc_id", outside.alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).cast("int")))
