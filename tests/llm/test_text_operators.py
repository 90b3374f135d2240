"""License scan, decontamination, LM scoring and BPE against brute force."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from corpus_cases import LONG, PASSAGE, ROWS, docs, nothing, stored  # noqa: F401
from fundflow.llm import bpe, decontaminate, license_scan, lm_scoring
from fundflow.llm import queries as Q

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOWER))


def by_row(frame, columns):
    return sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=repr)


# ---------------------------------------------------------------- license scan
BASE = [("under the mit license".split(), "mit"), ("apache license version 2".split(), "apache-2"),
        ("cc by nc".split(), "cc-by-nc")]


def brute_base(rows):
    out = []
    for i, t in rows:
        w = words(t)
        at = [(k, label) for phrase, label in BASE for k in range(len(w)) if w[k:k + len(phrase)] == phrase]
        out.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None),
                    ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=repr)


def test_base_phrases(docs):
    frame = license_scan.scan(docs).cache()
    assert by_row(frame, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_base(ROWS)
    for r in frame.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    by_id = {r["doc_id"]: r["labels"] for r in frame.collect()}
    assert by_id[13] == "apache-2,apache-2.0,cc-by-nc,cc-by-nc-4.0,mit"
    assert by_id[10] == "" and by_id[4] == ""


def test_scan_empty(nothing):
    assert license_scan.scan(nothing).collect() == []


@pytest.mark.parametrize("text, labels", [
    ("this work is licensed under the gnu general public license version 3", ["gpl-3.0"]),
    ("spdx license identifier lgpl 2 1 or later", ["lgpl-2.1"]),
    ("released under the gnu affero general public license v3", ["agpl-3.0"]),
    ("dual licensed under mit license or the mozilla public license 2 0", ["mit", "mpl-2.0"]),
    ("permission is hereby granted free of charge to any person obtaining a copy", ["mit"]),
    ("available under the creative commons attribution sharealike 4 0", ["cc-by-sa-4.0"]),
    ("copyright 2021 all rights reserved", ["all-rights-reserved", "copyright"]),
    ("the general public licensed the premise of mitigation", []),
    ("the artistic director met the apache chief", []),
    ("epl 2 0 and afl scores of the weekend for cpl smith", []),
    ("an apache 2 0 license or the artistic license", ["apache-2.0", "artistic"]),
])
def test_rules(text, labels):
    found = license_scan.detect(text.split())
    assert sorted({rule.label for _, _, rule in found}) == labels
    for k, (a, b, _) in enumerate(found):  # nothing lies within another detection
        assert not any(x <= a and b <= y for j, (x, y, _) in enumerate(found) if j != k)


def test_rules_are_many_ordered_and_gated():
    rules = license_scan.rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    names = ["gnu affero general public license", "lgpl", "gpl", "gfdl", "apache license", "mpl", "epl license",
             "cddl", "cpl license", "eupl", "osl license", "afl license", "artistic license", "bsl license", "busl", "sspl",
             "psf", "zpl", "php license", "ofl", "odbl", "ms pl license", "ms rl license", "upl", "ncsa license", "bsd license", "mit license", "isc license", "zlib license",
             "wtfpl", "unlicense", "0bsd", "cc0", "cc by", "cc by sa", "creative commons attribution"]
    for name in names:
        assert license_scan.detect(f"x {name} y".split()), name


def example(pattern):
    """A text that a signature matches: optional parts left out, the first of alternatives, each class its first letter."""
    while (m := re.search(r"\((?:\?:)?([^()]*)\)(\?)?", pattern)):
        pattern = pattern[:m.start()] + ("" if m[2] else m[1].split("|")[0]) + pattern[m.end():]
    pattern = re.sub(r"\[[^]]*\](?:\{[^}]*\})?", "a ", pattern.split("|")[0])
    return " ".join(re.sub(r"\w?\?", "", pattern).split())


def test_signatures_are_found_by_their_own_text():
    """Each alone and within other words, through its keyword, as its label."""
    from fundflow.llm.license_texts import KINDS
    total = 0
    for signatures, _, _ in KINDS:
        for label, pattern in signatures:
            total += 1
            text = example(pattern)
            assert re.fullmatch(pattern, text), (pattern, text)
            words_ = f"so it says {text} and no more".split()
            assert any(d[2].label == label or d[2].priority >= 8 for d in license_scan.detect(words_)), (label, text)
            rule = next(r for r in license_scan.rules() if pattern in r.pattern.pattern)
            assert rule.keywords & set(text.split())
    assert total >= 180


@pytest.mark.parametrize("text", [
    "the author had permission to use the library and was granted a copy of the document free of charge",
    "a general public with a license to complain about the original work of the artistic director",
    "the software foundation of the house was provided as is by the contributors who met in boston",
    "redistribution of income in any form is not without restriction in the open government of the state",
    "apache helicopters and the mozilla mascot stood under the eclipse near the boost factory",
    "you may use the material in class and the origin of this story must be told",
    "his warranty covers fitness for running and the merchant of venice",
    "public domain knowledge is what the people dedicated to the village have",
])
def test_ordinary_prose_yields_nothing(text):
    assert license_scan.detect(text.split()) == []


def brute_uncovered(found):
    ordered = sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label, -d[2].confidence))
    kept = []
    for a, b, rule in ordered:
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, rule))
    return kept


def test_covered_detections():
    """Against all pairs: higher priorities cover, as high ones cover what is shorter, one of equal ones stays."""
    r = random.Random(12)
    some = [license_scan.Rule(f"l{k}", re.compile("x"), frozenset(), "", r.randint(2, 9), r.choice([0.3, 0.8]))
            for k in range(12)]
    for _ in range(300):
        found = set()
        for _ in range(r.randint(0, 40)):
            a = r.randint(0, 20)
            found.add((a, a + r.randint(0, 6), r.choice(some)))
        got = license_scan._uncovered(found)
        assert sorted(got, key=repr) == sorted(brute_uncovered(found), key=repr)


def test_many_detections_take_linear_time():
    words_ = "see the mit license and gpl version 3 or bsd license all rights reserved".split() * 40_000
    begin = time.perf_counter()
    found = license_scan.detect(words_)
    assert len(found) >= 160_000 and time.perf_counter() - begin < 60


def test_rules_reach_no_further_than_their_stretch():
    """A rule's longest match is within REACH words, so no detection is cut off."""
    for rule in license_scan.rules():
        words_ = re.sub(r"\(\?[:<!=]+|[()?\[\]]", " ", rule.pattern.pattern).replace("|", " ").split()
        assert len(words_) <= license_scan.REACH, rule.pattern.pattern


# ---------------------------------------------------------------- decontamination
ITEMS = [(1, PASSAGE), (2, "Short   TEXT"), (3, ""), (4, None), (None, "é à ü é à"), (5, "w7919 nothing"), (6, "spam"),
         (6, "spam"), (7, " ".join(f"w{k * 7919 % 1013}" for k in range(500, 520)))]


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    found |= windows[tuple(w[k:k + n])]
                    hit[k:k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination(spark, docs, block):
    """In one block and in several."""
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, row int")
    found = decontaminate.report(docs, bench, block_bytes=block).cache()
    want = brute_hits(ROWS, ITEMS)
    assert by_row(found, ("doc_id", "n_words", "n_hit", "items", "contaminated")) == want
    clean = decontaminate.clean_rows(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(not w[4] for w in want)


def test_decontamination_random(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 5, 13, 14, 30]))) for k in range(25)]
    rows = [(k, " ".join([text(r.randint(0, 40)), items[k % 25][1], text(5)])) for k in range(60)]
    found = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"),
                                 spark.createDataFrame(items, "item_id long, text string"))
    assert by_row(found, ("doc_id", "n_words", "n_hit", "items", "contaminated")) == brute_hits(rows, items)


def test_decontamination_repeated_items(spark, docs, monkeypatch):
    """Copies of an item fill no block, and change nothing."""
    items = ITEMS + [(99, PASSAGE)] * 300
    sizes, prepare = [], decontaminate.prepare
    monkeypatch.setattr(decontaminate, "prepare", lambda ids, *rest: sizes.append(len(ids)) or prepare(ids, *rest))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(docs, bench, block_bytes=4000)
    assert by_row(found, ("doc_id", "n_words", "n_hit", "items", "contaminated")) == brute_hits(ROWS, items)
    assert sum(sizes) == len(set(items))


def test_decontamination_long_items(spark, monkeypatch):
    """An item of many blocks: every window is in one piece, short rests are no windows of their own."""
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n))
    items = [(1, text(2000)), (2, text(12)), (3, None), (4, "x" * 5000), (5, "é" * 3000 + " " + text(40))]
    rows = []
    for k in range(80):
        at = r.randint(0, 1980)
        rows.append((k, " ".join([text(5), *items[0][1].split()[at:at + r.randint(5, 40)], text(5)])))
    rows += [(100, items[0][1]), (101, items[4][1]), (102, items[1][1])]
    found = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"),
                                 spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    assert by_row(found, ("doc_id", "n_words", "n_hit", "items", "contaminated")) == brute_hits(rows, items)
    # pieces: every window once, none shorter than a window
    w = words(items[0][1])
    batch = pa.record_batch([pa.array(["1"]), pa.array([items[0][1]])], names=["i", "t"])
    pieces = [words(x["t"][0].as_py()) for x in decontaminate._item_pieces(500, 13)([batch])]
    assert [p[k:k + 13] for p in pieces for k in range(len(p) - 12)] == [w[k:k + 13] for k in range(len(w) - 12)]
    assert len(pieces) > 5


def test_decontamination_shared_hashes(monkeypatch):
    """Words of the benchmark that share a hash are told apart by their bytes."""
    whole = decontaminate.span_hash
    monkeypatch.setattr(decontaminate, "span_hash", lambda *x: whole(*x) & np.uint64(3))
    r = random.Random(7)
    text = lambda n: " ".join(f"{r.choice('abcdefghij')}{r.randint(0, 3)}" for _ in range(n))
    items = [(k, text(r.choice([1, 2, 14, 30]))) for k in range(12)]
    rows = [(k, " ".join([text(20), items[k % 12][1], text(9)])) for k in range(40)]
    test = decontaminate.prepare([str(i) for i, _ in items], [t for _, t in items])
    assert test.deep > 5
    hit, first, row, window = decontaminate.shard_hits(test, pa.array([t for _, t in rows]))
    names = [set() for _ in rows]
    for k, x in zip(row.tolist(), window.tolist()):
        names[k].update(test.items[x])
    got = [(i, int(b - a), int(hit[a:b].sum()), sorted(names[k])) for k, ((i, _), a, b)
           in enumerate(zip(rows, first, first[1:]))]
    assert sorted(got, key=repr) == sorted([x[:4] for x in brute_hits(rows, items)], key=repr)


def test_decontamination_empty(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(nothing, none).collect() == []
    assert decontaminate.report(docs, none).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.clean_rows(docs, none).count() == len(ROWS)


def brute_longest(docs, items, width):
    """Longest match of every item suffix, word by word, over all document places."""
    out = {}
    texts = [words(t) for _, t in docs]
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - width + 1) if w else 0):
            need, best = min(width, len(w) - at), 0
            for t in texts:
                for p in range(len(t)):
                    n = 0
                    while at + n < len(w) and p + n < len(t) and w[at + n] == t[p + n]:
                        n += 1
                    best = max(best, n)
            if best >= need:
                key = ("null" if item is None else str(item), at)
                out[key] = max(best, out.get(key, 0))
    return out


def check_longest(frame, docs, items, width):
    got = {(r["item_id"], r["item_start"]): r for r in frame.collect()}
    assert {k: r["length"] for k, r in got.items()} == brute_longest(docs, items, width)
    for (item, at), r in got.items():  # the place named holds those words
        spans = [words(t)[at:at + r["length"]] for i, t in items if ("null" if i is None else str(i)) == item]
        assert any(words(t)[r["doc_start"]:r["doc_start"] + r["length"]] in spans
                   for i, t in docs if i == r["doc_id"])


@pytest.mark.parametrize("width,block_bytes", [(13, 8 << 20), (3, 8 << 20), (1, 8 << 20), (3, 200)])
def test_longest_matches(spark, width, block_bytes):
    r = random.Random(width * block_bytes)
    text = lambda n: " ".join(r.choice(["A", "b", "c", "no"]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 5, 30]))) for k in range(12)] + [(None, "b c b"), (3, "a a a a a"), (5, None)]
    rows = [(k, text(r.choice([0, 3, 40]))) for k in range(25)] + [(None, "c b no"), (70, None), (71, "a " * 30)]
    rows += [(100 + k, f"{text(4)} {items[k][1]} {text(3)}") for k in range(12)] + [(9, rows[9][1])]
    got = decontaminate.longest_matches(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), width=width, block_bytes=block_bytes)
    check_longest(got, rows, items, width)


def test_longest_matches_long(docs, spark, nothing):
    """Matches far longer than a window, over all awkward rows; empty tables."""
    items = [("x", "nowhere " + " ".join(LONG.split()[300:2000])), ("y", "spam " * 250), ("z", f"before {PASSAGE} after"), ("e", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r["item_id"], r["item_start"]): r["length"] for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got[("x", 1)] == 1700 and ("x", 0) not in got and got[("y", 0)] == 250 and got[("z", 1)] == 60
    assert not [k for k in got if k == ("z", 0) or k[0] == "e"]
    assert decontaminate.longest_matches(nothing, bench).collect() == []
    assert decontaminate.longest_matches(docs, bench.filter("false")).collect() == []


# ---------------------------------------------------------------- LM scoring
def trained(texts):
    """Counts of words, pairs and triples of token lists, and p(w | u, v) by its definition."""
    c, pairs, triples = Counter(), Counter(), Counter()
    for w in texts:
        c.update(w)
        pairs.update(zip(["<s>"] + w, w))
        triples.update(zip((["<s>"] + w), w, w[1:]))
    n, v, mu = sum(c.values()), len(c), lm_scoring.MU
    history = dict(c) | {"<s>": c[None]}

    def p(x, *before):
        if not before:
            return (c[x] + 1) / (n + v + 1)
        seen, count = ((pairs, history.get(before[0], 0)) if len(before) == 1 else (triples, pairs[before]))
        return (seen[(*before, x)] + mu * p(x, *before[1:])) / (count + mu)

    return c, n, p


def brute_lm(rows):
    texts = [(i, words(t, SPACED) + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c, n, p = trained([w for _, w, held in texts if not held])
    out = []
    for i, w, held in texts:
        line = ["<s>"] + w
        model = sum(math.log10(p(x, *line[max(0, k - 1):k + 1])) for k, x in enumerate(w))
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), model))
    return out


def close_rows(got, want):
    key = lambda r: (repr(r[0]), r[1:5], round(r[5], 3))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_lm(docs):
    got = [tuple(r) for r in lm_scoring.score(docs).collect()]
    close_rows(got, brute_lm(ROWS))


def test_lm_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring.W, "BUCKET_BYTES", 2000)
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["The", "the", "a", "b.", "é", f"x{k}"]) for _ in range(r.randint(0, 60))))
            for k in range(80)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    close_rows([tuple(r) for r in got], brute_lm(rows))


def chunk_model(texts):
    """Tokens, questions and automaton of one chunk that knows its own training rows only."""
    table = pa.table({"doc_id": pa.array([k for k, _ in texts], pa.int64()),
                      "text": pa.array([t for _, t in texts], pa.string())})
    t = lm_scoring.tokens(table)
    a = lm_scoring.asked(t, 1)
    size = len(t.words)
    word = np.zeros(size - 1, np.int64)
    word[a.word] = a.word_count
    return t, a, lm_scoring.Automaton.build(a, size, word, a.pair_count, a.triple_count, int(word.sum()),
                                            int((word > 0).sum()))


def test_lm_sums_to_one():
    """From every state: arcs, and what its failure arc leaves to the shorter state, over words and one unknown."""
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    free = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2]
    vocabulary = ["a", "b", "c", "unknown"]  # one held-out text asks for every triple, so the chunk knows all arcs
    asks = " ".join(" ".join(x) for x in itertools.product(vocabulary, repeat=4))
    texts = [(free[0], "a b a c a b a"), (free[1], "b b a c"), (free[2], ""), (held, asks)]
    t, a, model = chunk_model(texts)
    names = [w.decode() for w in t.words.to_pylist()]
    size, end = len(names), len(names) - 2
    pair_of = {divmod(int(x), size): k for k, x in enumerate(a.pair)}
    triple_of = {(int(head), int(a.pair[last]) % size): k
                 for k, (head, last) in enumerate(zip(a.triple_head, a.triple_last))}

    def p(state, x):
        if state == 0:
            return 10 ** model.arc[0][x]
        gram = (pair_of.get((state - 1, x)) if state < model.first_pair
                else triple_of.get((state - model.first_pair, x)))
        weight = math.nan if gram is None else model.arc[1 if state < model.first_pair else 2][gram]
        if not math.isnan(weight):
            return 10 ** weight
        return 10 ** model.failure[state] * p(int(model.falls_to[state]), x)

    checked = 0
    for state in range(len(model.failure)):
        last = state - 1 if state < model.first_pair else int(a.pair[state - model.first_pair]) % size
        if state and last == end:
            continue  # nothing follows the end
        assert math.isclose(sum(p(state, x) for x in range(size - 1)), 1), state
        checked += 1
    assert checked > 20 and (model.failure < 0).sum() > 5


def test_lm_state_is_carried(monkeypatch):
    """Segments of any length give the weights of one unbroken traversal, those of the definition."""
    r = random.Random(11)
    texts = [(k, " ".join(r.choice("abcdefg") for _ in range(r.choice([0, 1, 2, 3, 40, 700])))) for k in range(60)]
    t, a, model = chunk_model(texts)
    _, _, p = trained([x.split() + [None] for k, x in texts if zlib.crc32(str(k).encode()) % 7 != 2])
    want = []
    for _, x in texts:
        line = ["<s>"] + x.split() + [None]
        want += [math.log10(p(line[k], *line[max(0, k - 2):k])) for k in range(1, len(line))]
    for segment in (1, 2, 3, 7, 256, 10 ** 6):
        monkeypatch.setattr(lm_scoring, "SEGMENT", segment)
        assert np.allclose(model.traverse(t, a), want, rtol=1e-10, atol=0)


def test_lm_empty(spark, nothing):
    assert lm_scoring.score(nothing).collect() == []
    alone = lm_scoring.score(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert alone[0]["n_tokens"] == 1 and alone[0]["train_tokens"] == 1


# ---------------------------------------------------------------- BPE
def library(text):
    t = Tokenizer.from_file(VOCABULARY)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_bpe_rows(docs):
    got = by_row(bpe.tokenise(docs, VOCABULARY).selectExpr("doc_id", "n_tokens", "sha2(ids, 256) i", "decoded"),
                 ("doc_id", "n_tokens", "i", "decoded"))
    want = []
    for i, t in ROWS:
        ids, decoded = library(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), decoded))
    assert got == sorted(want, key=repr)


def test_bpe_new_code_points():
    """Letters and numbers that the library's tables do not know, and others beside them, are cut as it does."""
    own, t, r = bpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(9)
    every = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    new = [c for c in every if own.newer(chr(c))]
    points = (r.sample(new, 3000) if len(new) > 3000 else new) + r.sample(every, 3000) + list(range(0x80, 0x3000))
    texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}" for c in points]
    texts += [f"x{chr(a)}{chr(b)}Y{chr(b)}" for a, b in zip(points, reversed(points))]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert own.encode_batch(texts) == want


def test_bpe_judged_pairs(monkeypatch):
    """Verdicts are the same whether a pair is new, known or forgotten."""
    monkeypatch.setattr(bpe, "REMEMBER", 20)
    own, r = bpe.load(VOCABULARY), random.Random(10)
    ids = sorted(own.ranks)[:400]
    for _ in range(30):
        codes = np.unique([a << 20 | b for a, b in r.sample(ids, 25)]).astype(np.int64)
        assert own.judge(codes).tolist() == [own.compatible(c >> 20, c & 0xFFFFF) for c in codes.tolist()]
        assert (np.diff(own.judged) > 0).all() and len(own.judged) == len(own.verdicts) <= 105
    assert own.judge(np.zeros(0, np.int64)).tolist() == []


def test_bpe_empty(nothing):
    assert bpe.tokenise(nothing, VOCABULARY).collect() == []


def test_bpe_like_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 500)  # the memory starts anew now and then
    own, t, r = bpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyzéßÑİΣ'<|>0123²½ \n\t!.,  　漢字🙂\x00\x1ć"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice("etaoin shrdlu") for _ in range(200)) for _ in range(300)]
    texts += ["thsh" * 9000, "a" * 5001, "<|endoftext|><|startoftext|>x<|endoftext", "'S 'LL can't", "é"]
    texts += [f"a{chr(k)}b {chr(k)}1" for k in range(0x250)]
    for a in range(0, len(texts), 100):
        part = texts[a:a + 100]
        for text, ids, want in zip(part, own.encode_batch(part), t.encode_batch(part, add_special_tokens=False)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, text[:80]
            assert own.decode(ids) == t.decode(want.ids, skip_special_tokens=False)
    assert own.repaired > 0


# ---------------------------------------------------------------- registered queries
def test_query_columns(spark):
    want = {
        "op2_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
        "op5_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op6_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    for name, columns in want.items():
        assert set(Q.QUERIES[name](spark, "/root/testdata/sf0.001").columns) == columns
