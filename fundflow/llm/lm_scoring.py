"""LM scoring with a weighted backoff automaton of order three.

Training counts words, pairs and triples of words over the whole training part.
The smoothed model is p(w | u, v) = (c(u, v, w) + MU p(w | v)) / (c(u, v) + MU) with
p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU) and the add-one unigram
p(w) = (c(w) + 1) / (N + V + 1); each sums to one over the vocabulary and one
unknown word.  As an automaton: a root, a state for each word and each pair seen
as a history, and an arc for each n-gram seen, to the state of its longest suffix.
A pair's failure arc, of weight MU / (c(u, v) + MU), leads to the state of its second
word, that word's failure arc to the root.  One traversal from left to right
carries the state and adds up the weights.  Texts are traversed side by side, long
ones in segments: a state remembers two words, so a segment that starts two
tokens early at the root is in the right state when its own tokens begin.

The automaton of a large corpus fits no single machine, so each chunk of
documents gets the part its texts can reach: it asks the bucket of every
distinct n-gram of its texts, sending its own training counts along, and the
answers, the totals over all chunks, come back in the order asked.
However common an n-gram is, a chunk sends it once, and n-grams are dealt by all
their words, so no bucket depends on one frequent word.  Replies are
counts, a byte or so each.  Words are sent as text and compared exactly.  Pairs and
triples are sent as 40-bit hashes that do not depend on the bucket; as a bucket's
size is bounded, about one n-gram in a million shares its count with another, at
any size of the corpus.

Defined results: null and empty texts are one end token; a null doc_id is
trained on and never held out; repeated rows train as often as they occur;
without training text every word is unknown (N = 0, V = 0).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fundflow.llm import windows as W
from fundflow.llm.text import LOWER, SPACED, flat, gather, mix, pieces, span_hash, strings, words

MU = 50.0
#: Documents whose crc32 of the id leaves this remainder are held out.
PARTS, PART = 7, 2
#: Bytes of questions for each byte of text, for the number of buckets.
SPREAD = 2
#: Tokens that are traversed in one go; longer texts are cut.
SEGMENT = 256
HASH_BITS = 40  # of pairs and triples in messages
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
START = b"\n"  # no word holds white space
END = b""


def is_held_out(ids) -> np.ndarray:
    return np.array([k is not None and zlib.crc32(str(k).encode()) % PARTS == PART for k in ids], bool)


@dataclass
class Tokens:
    """A chunk's token stream: codes into a list of distinct words, END and START last."""

    words: pa.Array  # distinct words as binary
    head: np.ndarray  # code of the history of each token
    token: np.ndarray
    edge: np.ndarray  # n+1 token offsets of the rows
    held: np.ndarray  # of rows

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edge) - 1), np.diff(self.edge))


def tokens(table: pa.Table) -> Tokens:
    texts, parts, counts = table.column("text").combine_chunks(), [], [np.zeros(0, np.int64)]
    for a, b in pieces(texts):
        data, off = flat(texts.slice(a, b - a))
        data = LOWER[data]
        starts, ends, first = words(data, off, SPACED)
        parts.append(strings(*gather(data, starts, ends), pa.large_binary()))
        counts.append(np.diff(first))
    coded = (pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())).dictionary_encode()
    code, n = np.asarray(coded.indices).astype(np.int64), np.concatenate(counts)
    end = len(coded.dictionary)
    edge = np.concatenate([[0], np.cumsum(n + 1)])
    token = np.full(int(edge[-1]), end, np.int64)
    inside = np.ones(len(token), bool)
    inside[edge[1:] - 1] = False
    token[inside] = code
    head = np.empty(len(token), np.int64)
    head[1:] = token[:-1]
    head[edge[:-1]] = end + 1
    listed = pa.concat_arrays([coded.dictionary, pa.array([END, START], pa.large_binary())])
    return Tokens(listed, head, token, edge, is_held_out(table.column("doc_id").to_pylist()))


@dataclass
class Asked:
    """Distinct words, pairs and triples of a chunk, each sorted by bucket (n-grams then by hash)."""

    word: np.ndarray  # codes
    word_bucket: np.ndarray
    word_count: np.ndarray  # in the chunk's training rows
    pair: np.ndarray  # head * size + token
    pair_hash: np.ndarray
    pair_bucket: np.ndarray
    pair_count: np.ndarray
    pair_at: np.ndarray  # of each token of the stream: its pair
    triple_hash: np.ndarray
    triple_bucket: np.ndarray
    triple_count: np.ndarray
    triple_at: np.ndarray  # of each token: its triple, -1 for a text's first token
    triple_head: np.ndarray  # the pairs a triple begins and ends with
    triple_last: np.ndarray


def _sorted(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of n-grams by bucket and hash, the place of each in it, and both in that order."""
    bucket = (code % np.uint64(buckets)).astype(np.int64)
    short = mix(code + _FACTOR) >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((short, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place, short[order], bucket[order]


def asked(t: Tokens, buckets: int) -> Asked:
    size = len(t.words)
    data, off = flat(t.words)
    code = span_hash(data, off[:-1], off[1:])
    train = ~t.held[t.row]
    count = np.bincount(t.token[train], minlength=size)
    word_bucket = (mix(code) % np.uint64(buckets)).astype(np.int64)[:size - 1]  # START is no token
    word = np.argsort(word_bucket, kind="stable")
    pair, at = np.unique(t.head * size + t.token, return_inverse=True)
    pair_count = np.bincount(at, train, minlength=len(pair)).astype(np.int64)
    pair_code = mix(code[pair // size] * _FACTOR + code[pair % size])
    by_pair, pair_place, pair_hash, pair_bucket = _sorted(pair_code, buckets)
    # a triple is a pair and the token behind it
    inner = np.ones(len(t.token), bool)
    inner[t.edge[:-1]] = False
    inner = np.flatnonzero(inner)
    _, one, which = np.unique(at[inner - 1] * size + t.token[inner], return_index=True, return_inverse=True)
    ends = inner[one]
    triple_count = np.bincount(which, train[inner], minlength=len(one)).astype(np.int64)
    by, place, triple_hash, triple_bucket = _sorted(
        mix(pair_code[at[ends - 1]] * _FACTOR + code[t.token[ends]]), buckets)
    triple_at = np.full(len(t.token), -1, np.int64)
    triple_at[inner] = place[which]
    return Asked(word, word_bucket[word], count[:size - 1][word], pair[by_pair], pair_hash, pair_bucket,
                 pair_count[by_pair], pair_place[at], triple_hash, triple_bucket, triple_count[by], triple_at,
                 pair_place[at[ends - 1]][by], pair_place[at[ends]][by])


def _groups(bucket: np.ndarray):
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[edge].tolist(), edge.tolist(), np.append(edge[1:], len(bucket)).tolist())


def _texts(listed: pa.Array, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of the words with these codes."""
    data, off = flat(listed.take(pa.array(code)))
    return np.diff(off).astype(np.uint32), data


def questions(t: Tokens, a: Asked, buckets: int) -> tuple[list[int], list[bytes]]:
    out_bucket, out = [], []
    for bucket, x, y in _groups(a.word_bucket):
        out_bucket.append(bucket)
        out.append(W.pack(a.word_count[x:y].astype(np.uint32), *_texts(t.words, a.word[x:y])))
    for shift, at, count, code in ((buckets, a.pair_bucket, a.pair_count, a.pair_hash),
                                   (2 * buckets, a.triple_bucket, a.triple_count, a.triple_hash)):
        for bucket, x, y in _groups(at):
            out_bucket.append(shift + bucket)
            out.append(W.pack(count[x:y].astype(np.uint32), np.diff(code[x:y], prepend=np.uint64(0))))
    return out_bucket, out


def _asked_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sizes of the questions, training counts and words of all of them."""
    parts = [W.unpack(b) for b in bodies]
    length = np.concatenate([p[1] for p in parts]).astype(np.int64)
    data = np.concatenate([p[2] for p in parts])
    return (np.array([len(p[0]) for p in parts]), np.concatenate([p[0] for p in parts]).astype(np.int64),
            strings(data, np.concatenate([[0], np.cumsum(length)]), pa.large_binary()))


def _asked_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same for pairs or triples, as hashes."""
    parts = [W.unpack(b) for b in bodies]
    return (np.array([len(p[0]) for p in parts]), np.concatenate([p[0] for p in parts]).astype(np.int64),
            pa.array(np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])))


def _totals(counts: np.ndarray, what: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of each entry and the total of each code (of equal values)."""
    coded = what.dictionary_encode()
    code = np.asarray(coded.indices)
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, code, counts)
    return code, total


def answer(table: pa.Table, buckets: int) -> pa.Table:
    """Totals over all chunks, for each chunk in the order it asked."""
    bucket = table.column("bucket")[0].as_py()
    read = _asked_words if bucket < buckets else _asked_hashes
    sizes, counts, what = read(table.column("body").to_pylist())
    code, total = _totals(counts, what)
    end = np.cumsum(sizes)
    out = [W.pack(total[code[b - n:b]].astype(np.uint64)) for n, b in zip(sizes, end)]
    return W.bodies(np.asarray(table.column("chunk").combine_chunks()), [bucket] * len(out), out)


def vocabulary(table: pa.Table, buckets: int) -> pa.Table:
    """Training tokens and distinct training tokens of a bucket of words."""
    n = v = 0
    if table.column("bucket")[0].as_py() < buckets:
        _, counts, what = _asked_words(table.column("body").to_pylist())
        total = _totals(counts, what)[1]
        n, v = int(total.sum()), int((total > 0).sum())
    return pa.table({"n": pa.array([n], pa.int64()), "v": pa.array([v], pa.int64())})


@dataclass
class Automaton:
    """The part of the model a chunk can reach, in log10.

    States are numbered: the root 0, then words, then pairs.  ``failure`` and
    ``falls_to`` are the failure arc of each state (weight 0 where it was never a
    history).  ``arc[k]`` and ``to[k]`` are weight and target of the arcs that read the
    last token of an n-gram of k + 1 words; NaN where it was never seen, but for
    the root's arcs, which every word has.
    """

    failure: np.ndarray
    falls_to: np.ndarray
    first_pair: int
    arc: list[np.ndarray]
    to: list[np.ndarray]

    @classmethod
    def build(cls, a: Asked, size: int, word_total, pair_total, triple_total, n_train: int,
              n_vocabulary: int) -> "Automaton":
        head, token = a.pair // size, a.pair % size
        root = (word_total + 1) / (n_train + n_vocabulary + 1)
        history = np.append(word_total, word_total[-1])  # START precedes as many tokens as END ends
        second = (pair_total + MU * root[token]) / (history[head] + MU)
        third = (triple_total + MU * second[a.triple_last]) / (pair_total[a.triple_head] + MU)
        lost = np.concatenate([[MU], history + MU, pair_total + MU])
        word_state = np.where(word_total > 0, np.arange(1, size), 0)
        pair_state = np.where(pair_total > 0, size + 1 + np.arange(len(a.pair)), word_state[token])
        seen = lambda total, p: np.append(np.where(total > 0, np.log10(p), np.nan), np.nan)
        return cls(np.log10(MU / lost), np.concatenate([np.zeros(size + 1, np.int64), 1 + token]), size + 1,
                   [np.log10(root), seen(pair_total, second), seen(triple_total, third)],
                   [word_state, np.append(pair_state, 0), np.append(pair_state[a.triple_last], 0)])

    def traverse(self, t: Tokens, a: Asked) -> np.ndarray:
        """Weight of reading each token, the state carried from left to right."""
        row = t.row
        start = np.concatenate([np.arange(x, y, SEGMENT) for x, y in zip(t.edge[:-1], t.edge[1:])]
                               or [np.zeros(0, np.int64)]).astype(np.int64)
        stop = np.minimum(start + SEGMENT, t.edge[row[start] + 1])
        begin = np.maximum(start - 2, t.edge[row[start]])
        order = np.argsort(begin - stop, kind="stable")  # longest first: those still running lead
        start, stop, begin = start[order], stop[order], begin[order]
        state = np.where(begin == t.edge[row[start]], self.first_pair - 1, 0)  # START's state, or the root
        out = np.zeros(len(t.token))
        reads = (t.token, a.pair_at, a.triple_at)
        depth = np.repeat([0, 1, 2], [1, self.first_pair - 1, len(self.failure) - self.first_pair])
        for step in range(int((stop - begin).max(initial=0))):
            k = int(np.searchsorted(begin - stop, -step))
            at, now = begin[:k] + step, state[:k]
            weight, pending = np.zeros(k), np.ones(k, bool)
            for words_kept in (2, 1, 0):
                arc, to = self.arc[words_kept], self.to[words_kept]
                here = np.flatnonzero(pending & (depth[now] == words_kept))
                gram = reads[words_kept][at[here]]
                found = ~np.isnan(arc[gram])
                took, fell = here[found], here[~found]
                weight[took] += arc[gram[found]]
                weight[fell] += self.failure[now[fell]]
                now[took], now[fell] = to[gram[found]], self.falls_to[now[fell]]
                pending[took] = False
            own = at >= start[:k]
            out[at[own]] = weight[own]
        return out


def _in_order(replies: dict[int, bytes], bucket: np.ndarray, shift: int) -> np.ndarray:
    out = np.zeros(len(bucket), np.int64)
    for k, x, y in _groups(bucket):
        out[x:y] = W.unpack(replies[shift + k])[0]
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                    ("score", pa.float64())])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the columns of RESULT."""
    rows, total = W.dealt(docs, doc_id, text)
    buckets = max(1, -(-SPREAD * total // W.BUCKET_BYTES))

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        t = tokens(W.ordered(table)[0])
        return W.bodies(chunk, *questions(t, asked(t, buckets), buckets))

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        table = W.ordered(table)[0]
        t = tokens(table)
        a = asked(t, buckets)
        found = W.reply_map(replies)
        n, v = replies.column("n")[0].as_py(), replies.column("v")[0].as_py()
        size = len(t.words)
        word_total = np.zeros(size - 1, np.int64)
        word_total[a.word] = _in_order(found, a.word_bucket, 0)
        model = Automaton.build(a, size, word_total, _in_order(found, a.pair_bucket, buckets),
                                _in_order(found, a.triple_bucket, 2 * buckets), n, v)
        rows = table.num_rows
        row = t.row
        by_row = lambda x: np.bincount(row, x, minlength=rows)
        return pa.table([
            table.column("doc_id"), pa.array(t.held), pa.array(np.diff(t.edge), pa.int64()),
            pa.array(by_row(word_total[t.token] > 0).astype(np.int64)), pa.array([n] * rows, pa.int64()),
            pa.array(by_row(model.arc[0][t.token])), pa.array(by_row(model.traverse(t, a)))], schema=RESULT)

    asks = rows.groupBy("chunk").applyInArrow(ask, W.BODY).groupBy("bucket")
    sizes = asks.applyInArrow(lambda table: vocabulary(table, buckets), "n long, v long")
    replies = asks.applyInArrow(lambda table: answer(table, buckets), W.BODY).select(
        "*", sizes.agg(F.sum("n")).scalar().alias("n"), sizes.agg(F.sum("v")).scalar().alias("v"))
    return (rows.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                 "train_tokens long, base_score double, score double"))
