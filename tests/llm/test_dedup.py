"""Deduplication operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from fundflow.llm import components, exact_dedup, simhash, substring_dedup, suffix_dedup, windows as W
from corpus_cases import PASSAGE, ROWS, docs, nothing, stored  # noqa: F401

BIG = float("inf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(frame, columns):
    return sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=repr)


def brute_windows(rows, units, size):
    """Removed mask of each row's units."""
    low = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - size + 1):
            w = tuple(u[k:k + size])
            low[w] = min(low.get(w, BIG), BIG if i is None else i)
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - size + 1):
            if low[tuple(u[k:k + size])] < (BIG if i is None else i):
                gone[k:k + size] = [True] * size
        out.append(gone)
    return out


def brute_words(rows, size=13):
    out = []
    for (i, t), gone in zip(rows, brute_windows(rows, lambda t: WORD.findall(t or ""), size)):
        kept = " ".join(w for w, g in zip(WORD.findall(t or ""), gone) if not g)
        out.append((i, len(gone), sum(gone), kept))
    return sorted(out, key=repr)


def brute_bytes(rows, size=50):
    out = []
    for (i, t), gone in zip(rows, brute_windows(rows, lambda t: (t or "").encode(), size)):
        raw = (t or "").encode()
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def bytes_of(frame):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"]))
                   for r in frame.collect()], key=repr)


def noisy(seed, n=120):
    """Texts of few words, so windows repeat in many contexts."""
    r = random.Random(seed)
    lines = [" ".join(r.choice("abc") for _ in range(r.randint(10, 30))) for _ in range(8)]
    return [(r.choice([None, *range(40)]), " ".join(r.choice(lines + ["zz", "ab c"]) for _ in range(r.randint(0, 6))))
            for _ in range(n)]


def test_substrings(docs):
    got = by_row(substring_dedup.dedup_substrings(docs), ("doc_id", "n_words", "n_removed", "kept_text"))
    assert got == brute_words(ROWS)


@pytest.mark.parametrize("from_files", [True, False])
def test_repeated_rows_spread_over_chunks(spark, from_files):
    """However often a row repeats, each chunk has its part of them; a read split differently deals the same."""
    frame = spark.createDataFrame([(k % 2 or None, "all the same") for k in range(2000)], "doc_id long, text string")
    if from_files:
        frame = stored(spark, frame.repartition(3))
    rows, total = W.dealt(frame, "doc_id", "text")
    assert total == 2000 * len("all the same")
    size = lambda: {(r["chunk"], r["doc_id"]): r["count"] for r in rows.groupBy("chunk", "doc_id").count().collect()}
    first = size()
    assert max(first.values()) < 200 and sum(first.values()) == 2000
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1k")
        assert size() == first
    finally:
        spark.conf.set(name, before)


def test_exploded_rows_spread_over_chunks(spark):
    """Rows made of one row of a file share its number, not its chunk; plain reads keep theirs."""
    frame = stored(spark, spark.createDataFrame([(1, "all the same")], "doc_id long, text string"))
    many = frame.selectExpr("doc_id", "text", "explode(sequence(1, 2000)) as k")
    assert not W._rows_of_files(many) and not W._rows_of_files(many.filter("k > 0").select("doc_id", "text"))
    assert not W._rows_of_files(frame.crossJoin(spark.range(5))) and not W._rows_of_files(frame.union(frame))
    assert W._rows_of_files(frame) and W._rows_of_files(frame.filter("doc_id > 0").selectExpr("*", "text as t"))
    for rows in (many, frame.crossJoin(spark.range(2000)), frame.union(frame).crossJoin(spark.range(1000))):
        sizes = [r["count"] for r in W.dealt(rows, "doc_id", "text")[0].groupBy("chunk").count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 400


def test_repeated_rows_keep_their_results(spark):
    """Copies of a row in different chunks leave each other alone; the smallest id's rows stay whole."""
    rows = [(7, f"a {PASSAGE}")] * 60 + [(None, PASSAGE)] * 60 + [(9, f"{PASSAGE} z")] * 3
    frame = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = by_row(substring_dedup.dedup_substrings(frame), ("doc_id", "n_words", "n_removed", "kept_text"))
    assert got == brute_words(rows)
    assert bytes_of(suffix_dedup.dedup_bytes(frame)) == brute_bytes(rows)


def test_substrings_empty(nothing):
    assert substring_dedup.dedup_substrings(nothing).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_few_words(spark, seed, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_BYTES", 1500)  # several buckets, so some minimisers are hot
    rows = noisy(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(substring_dedup.dedup_substrings(frame), ("doc_id", "n_words", "n_removed", "kept_text"))
    assert got == brute_words(rows)


def test_bytes(docs):
    assert bytes_of(suffix_dedup.dedup_bytes(docs)) == brute_bytes(ROWS)


def test_bytes_empty(nothing):
    assert suffix_dedup.dedup_bytes(nothing).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_few_symbols(spark, seed, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_BYTES", 1500)
    rows = noisy(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert bytes_of(suffix_dedup.dedup_bytes(frame, length=23, gram=9)) == brute_bytes(rows, 23)


def test_suffix_order():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(0, 120))
        s = r.integers(1, int(r.integers(2, 5)), n).astype(np.int64)
        assert suffix_dedup.suffix_order(s, 10 ** 9).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())


def test_equal_hashes_are_settled_by_bytes():
    data = np.frombuffer(b"aaabbbaaaccc", np.uint8)
    start, length = np.array([0, 3, 6, 9]), np.full(4, 3)
    h = np.zeros(4, np.uint64)  # one hash for all
    least = W.smallest_ids(data, start, length, np.argsort(h), np.array([1, 1, 2, 2]), h)
    assert least.tolist() == [1, 1, 1, 2]


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for i, t in rows:
        g = sorted(groups[norm(t)])
        keep = rows[g[0][3]][0]
        out.append((i, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def test_exact(docs):
    frame = exact_dedup.exact_dedup(docs).cache()
    want, groups = brute_exact(ROWS)
    assert by_row(frame, ("doc_id", "keep_id", "group_size", "text_sha256")) == want
    assert frame.filter("kept").count() == groups
    assert frame.filter("kept and not (doc_id <=> keep_id)").count() == 0
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_exact_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert exact_dedup.kept_rows(nothing).collect() == []


@pytest.mark.parametrize("kept_rows", [exact_dedup.kept_rows, simhash.kept_rows])
def test_kept_rows_hold_when_splits_change(spark, kept_rows):
    """What stays is the same if the next read of docs is split differently."""
    r = random.Random(6)
    rows = [(k, " ".join(str(r.random()) for _ in range(12))) for k in range(400)]
    rows += [(k + 400, t) for k, t in rows[::2]]
    frame = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "2k")
        kept = kept_rows(frame)
        spark.conf.set(name, "64m")
        got = sorted(x["doc_id"] for x in kept.select("*").collect())
    finally:
        spark.conf.set(name, before)
    assert got == list(range(400))


def test_index_takes_batches(spark):
    """A second batch finds what the first brought, and brings what is new."""
    index = exact_dedup.DigestIndex.fresh(spark)
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "ab"), (4, "d"), (5, "d "), (6, "d")], "doc_id long, text string")
    first = exact_dedup.exact_dedup(one, index=index)
    assert by_row(first, ("doc_id", "keep_id", "kept")) == [(1, 1, True), (2, 2, True)]
    second = exact_dedup.exact_dedup(two, index=index)
    assert by_row(second, ("doc_id", "keep_id", "kept")) == [
        (3, 1, False), (4, 5, False), (5, 5, True), (6, 5, False)]
    assert index.read().count() == 3


def test_batches_and_reruns(spark):
    """Three batches of documents keep what one brute-force pass in their order keeps; a batch run again, also after
    later ones or a compaction, keeps the same rows; fresh indexes leave no table."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    parts, seen, want = [table.filter(f"doc_id % 3 = {k}") for k in range(3)], {}, []
    for k in range(3):
        mine = sorted((i for i in rows if i % 3 == k), key=lambda i: (-len(rows[i] or ""), i))
        for i in mine:
            seen.setdefault(norm(rows[i]), i)
        want.append({i: seen[norm(rows[i])] for i in mine})
    before = {t.name for t in spark.catalog.listTables()}
    index = exact_dedup.DigestIndex(spark, "known_digests_test")
    try:
        keep = lambda k, **o: {r["doc_id"]: r["keep_id"]
                               for r in exact_dedup.exact_dedup(parts[k], index=index, **o).collect()}
        assert [keep(0), keep(0), keep(1)] == [want[0], want[0], want[1]]
        assert [keep(2, batch="third"), keep(0), keep(2, batch="third")] == [want[2], want[0], want[2]]
        assert index.read().count() == len(seen) == index.read().select("digest").distinct().count()
        index.compact()
        assert len(index.read().inputFiles()) <= index.buckets
        kept = exact_dedup.kept_rows(parts[1], index=index)
        assert {r["doc_id"] for r in kept.collect()} == {i for i, k in want[1].items() if i == k}
    finally:
        index.drop()
    assert exact_dedup.exact_dedup(table).filter("kept").count() == len(seen)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_exact_runs_no_python(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_print(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(k) for k in range(n)]


def brute_simhash(rows):
    prints = [brute_print(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(len(rows), near)
    low = {}
    for (i, _), g in zip(rows, root):
        low[g] = min(low.get(g, BIG), BIG if i is None else i)
    return sorted([(i, f"{p:016x}", None if low[g] == BIG else low[g]) for (i, _), p, g in zip(rows, prints, root)],
                  key=repr), len(set(root))


def test_simhash(docs):
    want, groups = brute_simhash(ROWS)
    assert by_row(simhash.simhash_dedup(docs), ("doc_id", "fingerprint", "component_id")) == want
    kept = simhash.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_simhash_empty(nothing):
    assert simhash.simhash_dedup(nothing).collect() == []


def test_simhash_keeps_a_row_of_each_component(spark):
    """Components that share their smallest id both keep a row; near copies without ids keep one."""
    r = random.Random(8)
    text = lambda: " ".join(f"t{r.randrange(10 ** 6)}" for _ in range(400))
    one, two, three, four = text(), text(), text(), text()
    rows = [(1, one), (1, two), (2, two), (None, three), (None, three + " end"), (None, four), (5, four), (4, four)]
    prints = [brute_print(t) for _, t in rows]
    assert prints[3] != prints[4] and (prints[3] ^ prints[4]).bit_count() <= 4
    frame = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = [(x["doc_id"], x["text"]) for x in simhash.kept_rows(frame).collect()]
    assert sorted(got, key=repr) == sorted([(1, one), (1, two), (None, three), (4, four)], key=repr)


def test_simhash_lower_cases_ascii(spark):
    """Texts that differ in A-Z only have the fingerprint of the lower-cased text; other letters keep their case."""
    low = "the quick brown fox jumps over the lazy dog à la carte é " + " ".join(f"w{k}" for k in range(20))
    rows = [(1, low), (2, low.upper().replace("À", "à").replace("É", "é")), (3, low.title().replace("À", "à")),
            (4, "Àbc DEF"), (5, "àbc def"), (6, "@[`{ AZ"), (7, "@[`{ az")]
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_dedup(frame).collect()}
    assert got == {i: f"{brute_print(lower(t)):016x}" for i, t in rows}
    assert got[1] == got[2] and got[4] != got[5] and got[6] == got[7]


def test_bit_sliced_distances():
    r = np.random.default_rng(0)
    values = []
    for base in r.integers(0, 2 ** 63, 20, dtype=np.uint64).tolist():
        for _ in range(10):
            for k in r.integers(0, 64, int(r.integers(0, 7))).tolist():
                base ^= 1 << k
            values.append(base)
    v = np.unique(np.array(values, np.uint64))
    for radius in (0, 1, 3, 4, 6):
        got = {p for a, b in simhash.close(v, v, radius) for p in zip(a.tolist(), b.tolist())}
        assert got == {(a, b) for a in range(len(v)) for b in range(len(v))
                       if (int(v[a]) ^ int(v[b])).bit_count() <= radius}


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_connect_in_tiles(spark, tile, monkeypatch):
    """A dense cluster, cut into tiles or not, and far fingerprints."""
    monkeypatch.setattr(simhash.tiled, "__defaults__", (tile,))
    r = random.Random(2)
    values = {0}
    while len(values) < 150:
        values.add(r.choice(sorted(values)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    values |= {r.getrandbits(63) for _ in range(50)}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = stored(spark, spark.createDataFrame(signed, "fp long"))
    links = [(a["a"], a["b"]) for a in simhash.fingerprint_links(nodes).collect()]
    at = {v: k for k, (v,) in enumerate(signed)}
    want = roots(len(values), [(a, b) for a in range(len(values)) for b in range(a)
                               if (values[a] ^ values[b]).bit_count() <= 4])
    assert roots(len(values), [(at[a], at[b]) for a, b in links]) == want


@pytest.mark.parametrize("distinct", [10, 10 ** 8, 10 ** 11])
def test_block_plan_covers(distinct):
    plan, agree = simhash.block_plan(distinct)
    assert sum(w for _, w in plan) == 64 and len(plan) - 4 == agree


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}
