"""BPE encoding and decoding: speculate with greedy longest matches, verify pairs, repair.

For the distinct words of a batch, greedy longest match proposes tokens.  A
sequence is the one that merging by rank gives exactly when every adjacent
pair is what merging gives for the two tokens' characters alone, so the
pairs of all words are checked together: their unique codes are searched in a
sorted array of the pairs already judged, a new pair is merged once, and the
new verdicts are inserted in order.  Only words with a failing pair are merged exactly.

The vocabulary file is read once on the driver and broadcast: its size is that of
the file, fixed for a tokenizer.  Words already encoded are remembered up to
``REMEMBER`` words, then the memory starts anew: the bound changes speed,
never results.

Letters and numbers are those of the ``regex`` module, without the code points
that the tokenizers library's older tables leave unassigned: the library's
regular expressions are asked once a worker which of them it knows, and its
lower-casing for capitals that Python's tables do not know.

Defined results: null counts as empty; an empty text has no tokens and
decodes to an empty text.  A text of any length is encoded whole; one very
long word costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from fundflow.llm.text import pieces

REMEMBER = 500_000
WORD_END = "</w>"
#: Fixed values of the file format: the printable stand-ins of bytes.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from 256 on."""
    out = [chr(b) if b in _PRINTABLE else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in out]


def _every(pattern: str) -> list[str]:
    """All characters that match."""
    return regex.findall(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))


@lru_cache(1)
def unassigned() -> str:
    """Letters and numbers of ``regex`` that are neither to the tokenizers library, as ranges of a character class."""
    candidates = "".join(_every(r"[\p{L}\p{N}]"))
    rest = Split(Regex(r"[\p{L}\p{N}]+"), "removed").pre_tokenize_str(candidates)
    found = np.array([ord(c) for part, _ in rest for c in part], np.int64)
    runs = np.split(found, np.flatnonzero(np.diff(found) > 1) + 1) if len(found) else []
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


@lru_cache(1)
def capitals() -> dict[int, str]:
    """Small letters of the capitals that only the library's tables know, to translate by."""
    new = [c for c in _every(r"\p{Lu}") if unicodedata.category(c) == "Cn"]
    return {ord(c): small for c, small in zip(new, map(Lowercase().normalize_str, new)) if small != c}


class WordBpe:
    """A word-end BPE tokenizer as a vocabulary file describes it."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != WORD_END:
            raise ValueError("only vocabularies of lower-cased words with word ends are supported")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for name, k in [*self.ids.items(), *self.special.items()]:
            self.names[k] = name
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.ids[a], self.ids[b]] = rank
            self.merged.append(self.ids[a + b])
        inner = {t: k for t, k in self.ids.items() if not t.endswith(WORD_END) or t == WORD_END}
        self.ending = {t.removesuffix(WORD_END): k for t, k in self.ids.items() if t not in inner}
        # every beginning of an inner token: the token's id, or None where it only leads to one
        self.paths = {t[:k]: None for t in inner for k in range(1, len(t))} | inner
        self.longest = max(map(len, self.ending))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.capital = re.compile("[" + "".join(map(chr, capitals())) + "]").search if capitals() else lambda text: None
        self.newer = re.compile(f"[{unassigned()}]").search if unassigned() else lambda text: None
        self.newer_split = regex.compile(
            "(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{unassigned()}]]")
            .replace(r"[\p{L}]", rf"[\p{{L}}--[{unassigned()}]]")
            .replace(r"[\p{N}]", rf"[\p{{N}}--[{unassigned()}]]")).findall if unassigned() else self.split
        # the same words where no character is one that the two modules class differently
        self.plain_split = re.compile(pattern.replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d")
                                      .replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")).findall
        self.unplain = re.compile("[\x1c-\x1f\x85\xa0²³¹¼½¾]|[^\x00-\u024f]").search
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.bytes = byte_characters()
        self.inner = [self.ids[c] for c in self.bytes]  # a byte's symbol within a word, and at its end
        self.last = [self.ids[c + WORD_END] for c in self.bytes]
        self.known: dict[str, bytes] = {}
        self.judged = np.zeros(0, np.int64)  # codes of pairs, sorted
        self.verdicts = np.zeros(0, bool)
        self.repaired = 0

    # ---- text to words
    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, in normal form."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased by character: no final sigma
        text = text.lower()
        if not self.unplain(text):
            return self.plain_split(text)
        if self.capital(text):
            text = text.translate(capitals())
        return (self.newer_split if self.newer(text) else self.split)(text)

    # ---- words to tokens
    def symbols(self, word: str) -> list[int]:
        raw, inner = word.encode(), self.inner
        out = [inner[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out

    def merge(self, tokens: list[int]) -> list[int]:
        """Merge by rank, leftmost first: the defining result."""
        if len(tokens) > 32:
            return self.merge_long(tokens)
        tokens, rank, none = list(tokens), self.ranks.get, len(self.merged)
        ranks = [rank(pair, none) for pair in zip(tokens, tokens[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            tokens[k] = self.merged[best]
            del tokens[k + 1], ranks[k]
            if k < len(ranks):  # only the pairs beside the merged one change
                ranks[k] = rank((tokens[k], tokens[k + 1]), none)
            if k:
                ranks[k - 1] = rank((tokens[k - 1], tokens[k]), none)
        return tokens

    def merge_long(self, tokens: list[int]) -> list[int]:
        """The same in n log n steps."""
        tokens, n = list(tokens), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[pair], k) for k, pair in enumerate(zip(tokens, tokens[1:])) if pair in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if tokens[k] < 0 or right >= n or self.ranks.get((tokens[k], tokens[right])) != rank:
                continue
            tokens[k], tokens[right] = self.merged[rank], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    new = self.ranks.get((tokens[left], tokens[after[left]]))
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [t for t in tokens if t >= 0]

    def greedy(self, word: str) -> list[int]:
        text = word if word.isascii() and word.isprintable() else "".join(
            [self.bytes[b] for b in word.encode()])
        out, at, n, paths, ending, longest = [], 0, len(text), self.paths, self.ending, self.longest
        while at < n:
            token = ending.get(text[at:]) if n - at <= longest else None
            if token is not None:
                out.append(token)
                break
            end = found = at + 1
            token = paths[text[at]]
            while end < n - 1:
                end += 1
                piece = text[at:end]
                if piece not in paths:
                    break
                longer = paths[piece]
                if longer is not None:
                    token, found = longer, end
            out.append(token)
            at = found
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both tokens gives just these two."""
        ends = self.names[b].endswith(WORD_END) and len(self.names[b]) > len(WORD_END)
        first, second = self.names[a], self.names[b].removesuffix(WORD_END) if ends else self.names[b]
        chars = [self.ids[c] for c in first + second]
        if ends:
            chars[-1] = self.ids[second[-1] + WORD_END]
        return self.merge(chars) == [a, b]

    def judge(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair of sorted distinct codes is compatible."""
        at = np.searchsorted(self.judged, codes)
        fresh = np.ones(len(codes), bool)
        inner = at < len(self.judged)
        fresh[inner] = self.judged[at[inner]] != codes[inner]
        new = codes[fresh]
        good = np.fromiter((self.compatible(c >> 20, c & 0xFFFFF) for c in new.tolist()), bool, len(new))
        verdict = np.empty(len(codes), bool)
        verdict[fresh], verdict[~fresh] = good, self.verdicts[at[~fresh]]
        if len(self.judged) > 4 * REMEMBER:
            self.judged, self.verdicts = new, good
        elif len(new):
            self.judged = np.insert(self.judged, at[fresh], new)
            self.verdicts = np.insert(self.verdicts, at[fresh], good)
        return verdict

    def learn(self, new: Iterable[str]) -> None:
        """Encode distinct words: propose, verify all adjacent pairs at once, repair."""
        new = list(new)
        if not new:
            return
        proposals = [self.greedy(w) for w in new]
        sizes = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        inside = word[:-1] == word[1:]
        codes = ((flat[:-1] << 20) | flat[1:])[inside]
        distinct, at = np.unique(codes, return_inverse=True)
        failing = np.unique(word[:-1][inside][~self.judge(distinct)[at]]).tolist()
        for k in failing:
            proposals[k] = self.merge(self.symbols(new[k]))
        self.repaired += len(failing)
        for w, tokens in zip(new, proposals):
            self.known[w] = struct.pack(f"<{len(tokens)}I", *tokens)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.marks.split(text) if "<|" in text else [text]
            split.append([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.words(p)
                          for p in parts])
        distinct = {w for parts in split for p in parts if isinstance(p, list) for w in p}
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, distinct
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts])
                for parts in split]

    def decode(self, ids: bytes) -> str:
        """Token names joined by spaces: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: One tokenizer for each vocabulary in a Python worker, with the words it remembers.
_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as file:
        return WordBpe(json.load(file))


def tokenise(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids (binary, little-endian uint32), decoded.

    ``vocabulary`` is a path on the driver.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    name = hashlib.sha256(content.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(content)

    @F.arrow_udf("n_tokens long, ids binary, decoded string")
    def run(texts: pa.Array) -> pa.Array:
        if name not in _LOADED:
            _LOADED[name] = WordBpe(json.loads(shared.value))
        bpe = _LOADED[name]
        ids, decoded = [], []
        for a, b in pieces(texts, 1 << 20):
            mine = bpe.encode_batch([t or "" for t in texts.slice(a, b - a).to_pylist()])
            ids += mine
            decoded += map(bpe.decode, mine)
        return pa.StructArray.from_arrays(
            [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
             pa.array(decoded, pa.string())], names=["n_tokens", "ids", "decoded"])

    return (docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r"))
            .select("doc_id", "r.n_tokens", "r.ids", "r.decoded"))
