"""Importance resampling, piecewise fingerprints and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpus_cases import PASSAGE, ROWS, docs, nothing, stored  # noqa: F401
from fundflow.llm import fill_in_middle, piecewise, resample, swar
from fundflow.llm import queries as Q
from fundflow.llm.text import flat

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
CHARS = ["a", "Z", "bc", " ", "\n", "é", "ß", "漢", "😀", "<", ">", "P", "S", "M", "@", "[", "`", "{", "\x00", "9", "́"]


def by_row(frame, columns):
    return sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=repr)


def texts_of(seed, n, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(CHARS) for _ in range(r.randint(0, most))) for _ in range(n)]


# ---------------------------------------------------------------- marked bytes
@pytest.mark.parametrize("seed", range(4))
def test_units_and_code_points(seed):
    texts = texts_of(seed, 60) + ["", "abc", "def", ""]
    data, off = flat(pa.array(texts))
    ends = swar.unit_ends(data, off)
    first = ends.rank(off)
    units = [UNIT.findall(t) for t in texts]
    assert np.diff(first).tolist() == [len(u) for u in units]
    at = ends.select(np.arange(first[-1])) + 1
    want = [int(o) + len("".join(u[:k + 1]).encode()) for o, u in zip(off, units) for k in range(len(u))]
    assert at.tolist() == want
    points = swar.code_points(swar.words_of(data))
    for k in (0, 1, 5, 40):
        got = swar.code_point_at(points, off, np.full(len(texts), k)) - off[:-1]
        assert got.tolist() == [len(t[:k].encode()) for t in texts]


# ---------------------------------------------------------------- fill-in-middle
def brute_fim(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def fim(frame):
    done = fill_in_middle.transform(frame)
    done = done.withColumn("restored", fill_in_middle.restored(done["output"], done["form"]))
    return by_row(done, ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"))


def test_fill_in_middle(docs):
    assert fim(docs) == sorted([brute_fim(i, t) for i, t in ROWS], key=repr)


def test_fill_in_middle_random(spark):
    rows = [(k, t) for k, t in enumerate(texts_of(7, 600))]
    rows += [(1000 + k, f"{x}a<P> b") for k, x in enumerate(["", "<", "<P", "é"])]
    rows += [(2000 + k, t) for k, t in enumerate(["<P", "P><", "<S", "S>", "<", ">M<", "<M"] * 8)]
    got = fim(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted([brute_fim(i, t) for i, t in rows], key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_empty(nothing):
    assert fill_in_middle.transform(nothing).collect() == []


# ---------------------------------------------------------------- resampling
def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_grams(text, n):
    w = words(text)
    return [" ".join(w[k:k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]


def brute_resample(rows, target, n=1, buckets=10_000, percent=10, least=20):
    code = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(code(g) for _, t in rows for g in brute_grams(t, n))
    t_ = Counter(code(g) for t in target for g in brute_grams(t, n))
    all_s, all_t = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log(
        (t_[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, t in rows:
        g = brute_grams(t, n)
        weight = sum(gain(code(x)) for x in g)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None, len(words(t)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("n, segment", [(1, 1 << 20), (1, 40), (3, 1 << 20), (3, 40), (2, 1)])
def test_resampling(spark, docs, n, segment, monkeypatch):
    """Edge cases, features of several words, and segments that end all over the texts."""
    rows = ROWS if segment > 1000 else [(i, t[:3000] if t else t) for i, t in ROWS]
    frame = docs if segment > 1000 else spark.createDataFrame(rows, "doc_id long, text string")
    target = [PASSAGE, "the short text", None, "", "ham É"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    gain = resample.gains(*(sum((np.bincount(b, minlength=500) for _, b, _ in resample.grams(pa.array(x), n, 500)),
                                np.zeros(500, np.int64)) for x in ([t for _, t in rows], target)))
    monkeypatch.setattr(resample, "SEGMENT_BYTES", segment)
    texts = pa.array([t for _, t in rows], pa.string())
    got = [Counter() for _ in rows]
    for row, bucket, _ in resample.grams(texts, n, 500):
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r][b] += 1
    assert got == [Counter(zlib.crc32(g.encode()) % 500 for g in brute_grams(t, n)) for _, t in rows]
    assert len(gain) == 500
    if segment > 1000:
        done = resample.resample(frame, bench, n=n, percent=40)
        assert by_row(done, COLUMNS) == brute_resample(rows, target, n, percent=40)


def test_resampling_ranks_over_partitions(spark):
    """Equal scores and a hot id: every rank occurs once, in order."""
    r = random.Random(3)
    rows = [(k if k % 3 else 7, " ".join(r.choice("abcdefgh") for _ in range(r.randint(10, 40)))) for k in range(1500)]
    target = ["a a a b"]
    got = resample.resample(stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)),
                            spark.createDataFrame([(t,) for t in target], "text string"))
    want = brute_resample(rows, target)
    assert by_row(got, ("doc_id", "n_features", "weight", "score")) == sorted((x[:4] for x in want), key=repr)
    ranked = sorted((x["rank"], -x["score"], x["doc_id"]) for x in got.collect() if x["rank"])
    assert [x[0] for x in ranked] == list(range(1, len(ranked) + 1)) and ranked == sorted(ranked, key=lambda x: x[1:])
    assert len(ranked) == sum(len(t.split()) >= 20 for _, t in rows) // 10


def test_resampling_empty(spark, docs, nothing):
    bench = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(nothing, bench).collect() == []
    none = resample.resample(docs, bench.filter("false")).collect()
    assert len(none) == len(ROWS) and all(r["weight"] <= 0 or r["n_features"] for r in none)


# ---------------------------------------------------------------- fingerprints
MOD = 1 << 64


def mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD % MOD
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 % MOD
    return h ^ (h >> 33)


def brute_fingerprint(text):
    raw = (text or "").encode()
    levels = {}
    for i in range(6, len(raw)):
        h = mix(int.from_bytes(raw[i - 6:i + 1], "little"))
        levels[i] = min((h & -h).bit_length() - 1 if h else 64, 40)
    count = lambda k: sum(v >= k for v in levels.values())
    k = next(k for k in range(41) if count(k) < 64 or k == 40)
    if k and count(k) < 16:
        k -= 1
    value = [mix((b + 1) * 0x9E3779B97F4A7C15 % MOD) for b in range(256)]
    parts = [str(k)]
    for s in range(3):
        cuts = [i + 1 for i, v in sorted(levels.items()) if v >= k + s][:63]
        edges, letters = [0, *cuts, len(raw)], ""
        for a, b in zip(edges, edges[1:]):
            if b > a:
                h = sum(value[c] * pow(0x9E3779B97F4A7C15, j, MOD) for j, c in enumerate(raw[a:b])) % MOD
                letters += chr(piecewise.ALPHABET[mix((h + b - a) % MOD) >> 58])
        parts.append(letters)
    return ":".join(parts)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_likeness(a, b):
    a, b = a.split(":"), b.split(":")
    k = max(int(a[0]), int(b[0]))
    if abs(int(a[0]) - int(b[0])) > 2:
        return 0.0
    x, y = a[1 + k - int(a[0])], b[1 + k - int(b[0])]
    return 1 - levenshtein(x, y) / max(len(x), len(y), 1)


SOME = [t for _, t in ROWS if t is None or len(t) < 20_000] + texts_of(1, 30, 400) + ["ab" * 900, "a line of it\n" * 300]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_fingerprints(block, monkeypatch):
    """Also where hashes run over many blocks."""
    monkeypatch.setattr(piecewise, "BLOCK", block)
    monkeypatch.setattr(piecewise._Powers, "_made", None)
    got = piecewise.fingerprints(*flat(pa.array(SOME, pa.string())))
    assert got == [brute_fingerprint(t) for t in SOME]
    assert all(len(s) <= 64 for x in got for s in x.split(":")[1:])


def test_edit_distances():
    r = random.Random(5)
    word = lambda: "".join(r.choice("AB+/z") for _ in range(r.choice([0, 1, 5, 31, 63, 64])))
    pairs = [(word(), word()) for _ in range(150)]
    got = piecewise.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [levenshtein(a, b) for a, b in pairs]
    prints = [brute_fingerprint(t) for t in SOME[:20]]
    both = [(a, b) for a in prints for b in prints]
    assert np.allclose(piecewise.likenesses([a for a, _ in both], [b for _, b in both]),
                       [brute_likeness(a, b) for a, b in both])


def brute_edits(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = (brute_fingerprint(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b,
                    round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return sorted(out, key=repr)


def edited(frame):
    done = piecewise.edited_neighbours(frame)
    return sorted([(*r[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in done.collect()], key=repr)


@pytest.mark.parametrize("batch", [10_000, 2])
def test_edited_neighbours(spark, batch):
    """Every document meets the next, also across batches, partitions and the end of the order."""
    rows = [(3 * k - 20, t) for k, t in enumerate(SOME)] + [(None, "no id É " * 9)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        assert edited(stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute_edits(rows)
        assert edited(spark.createDataFrame(rows[:1], "doc_id long, text string")) == brute_edits(rows[:1])
    finally:
        spark.conf.set(name, before)


def test_edited_neighbours_of_all_rows(docs, nothing):
    """Repeated and null ids: a result for each row, the fingerprint of its text."""
    got = piecewise.edited_neighbours(docs).select("doc_id", "n_chars", "fingerprint").collect()
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(((i, len(t or "")) for i, t in ROWS), key=repr)
    small = {(r[0], r[2]) for r in got if r[1] < 20_000}
    assert small == {(i, brute_fingerprint(t)) for i, t in ROWS if len(t or "") < 20_000}
    assert piecewise.edited_neighbours(nothing).collect() == []


def test_edits_stay_near(spark):
    """On the test documents an edit is nearer than a stranger."""
    got = Q.op12_piecewise_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200
    assert np.mean([r["near_edited"] for r in got]) > 0.4 > 2 * np.mean([r["near_next"] for r in got])
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_columns_of_fingerprints(spark):
    frame = spark.createDataFrame([("a b c " * 40, "a b c " * 40), (None, ""), ("x", None)], "a string, b string")
    prints = frame.select(piecewise.fingerprint(frame["a"]).alias("a"), piecewise.fingerprint(frame["b"]).alias("b"))
    assert [r[0] for r in prints.select(piecewise.likeness(prints["a"], prints["b"])).collect()][:2] == [1.0, 1.0]
