"""Classifiers on held-out rows, the pipeline, and the queries that SQL can express."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_MID, SF_SMALL
from corpus_cases import ROWS, docs, nothing, stored  # noqa: F401
from fundflow.llm import decontaminate, language_id, quality
from fundflow.llm import queries as Q
from oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    problems, *_ = compare(spark, duck(SF_SMALL), name, E.queries()[name](spark, SF_SMALL), Q.ORACLE_SQL[name])
    assert not problems, problems


def test_all_registered():
    numbers = {re.match(r"op(\d+)_", n)[1] for n in Q.QUERIES}
    assert numbers == {str(k) for k in range(1, 14)}
    assert set(Q.QUERIES) | {"pipeline"} <= set(E.queries())


# ---------------------------------------------------------------- language ID
def test_language_held_out(spark):
    table = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert len(got) > 150 and right / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs, nothing):
    got = language_id.identify(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["lang_pred"] in ("en", "und")
    assert sum(r["lang_pred"] == "und" for r in got) == sum(
        t is None or not any(c.isalpha() for c in t) for _, t in ROWS)
    assert language_id.identify(nothing).collect() == []
    kept = language_id.determined_rows(docs)
    assert kept.columns == docs.columns
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(unlabelled).first()["lang_pred"] == "und"


def test_language_reads_text_only(spark):
    """Another lang, id or source at prediction changes nothing."""
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language_id.train(table)
    one = language_id.identify(table, model).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
    other = table.selectExpr("doc_id", "text", "'xx' as lang")
    assert one == language_id.identify(other, model).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()


def test_language_training_bound(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language_id.train(table, max_rows=50)
    assert model.labels == ["de", "en", "es", "fr"]


def test_language_sample_keeps_rare_labels(spark):
    """Above the bound every label has its own sample, a rare one all its rows; one without n-grams is not scored."""
    rows = [(k, f"the house number {k} and the garden of the town", "en") for k in range(6000)]
    rows += [(k, "talo on pieni ja puutarha vihreä", "fi") for k in (7001, 7002)]
    rows += [(k, "", "none") for k in range(8000, 8003)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=100)
    assert model.labels == ["en", "fi"]
    assert all(len(np.unique(x)) > 1 for x in model.log_prob)  # none is flat
    assert np.allclose(np.exp(model.log_prior), [6000 / 6002, 2 / 6002])
    asked = spark.createDataFrame([(1, "pieni talo ja vihreä puutarha", None), (2, "the garden and the house", None)],
                                  "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, model).collect()}
    assert got == {1: "fi", 2: "en"}


def brute_grams(text):
    """Bins of all 1- to 3-grams, one character after the other."""
    full = (1 << 64) - 1
    fold = lambda c: (c.lower() if "a" <= c.lower() <= "z" else " ") if c < "\x80" else (
        c.lower() if "\xc0" <= c <= "\xde" else c)
    text = "".join(map(fold, text))
    out = []
    for n in (1, 2, 3):
        for k in range(len(text) - n + 1):
            code = ord(text[k]) + n
            for c in text[k + 1:k + n]:
                code = code * 0x100000001B3 + ord(c) & full
            code = code * 0x9E3779B97F4A7C15 & full
            code = (code ^ code >> 29) * 0xBF58476D1CE4E5B9 & full
            out.append(code >> 48)
    return out


def brute_bayes(known, asked):
    """(label, posterior) of each asked text by multinomial naive Bayes with counters."""
    counts, rows = {}, Counter()
    for text, label in known:
        if text is not None and label is not None:
            counts.setdefault(label, Counter()).update(brute_grams(text))
            rows[label] += 1
    labels = sorted(x for x in counts if counts[x])
    out = []
    for text in asked:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        z = []
        for x in labels:
            total = sum(counts[x].values()) + 0.5 * 65536
            z.append(math.log(rows[x] / sum(rows[y] for y in labels))
                     + sum(math.log((counts[x][b] + 0.5) / total) for b in brute_grams(text)))
        out.append((labels[z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z)))
    return out


def test_language_brute_force(spark):
    """Every prediction and score against counters, n-gram by n-gram; labels that tie go to the first."""
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
             .filter("length(text) < 1500").select("doc_id", "text", "lang").collect()]
    r = random.Random(8)
    table += [(None, "Ärger über ÜBUNG ×÷ ß", "de"), (10 ** 6, "", "en"), (10 ** 6 + 1, None, "fr"),
              (10 ** 6 + 2, "123 !?", "es"), (10 ** 6 + 3, "?", None), (10 ** 6 + 4, "𝒳 ﬁ 漢字", None)]
    table += [(10 ** 6 + 5 + k, " ".join(r.choice(["der", "la", "the", "y", "et", "É"]) for _ in range(4)), None)
              for k in range(30)]
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2
    want = brute_bayes([(t, x) for k, t, x in table if not out(k)], [t for _, t, _ in table])
    got = language_id.identify(spark.createDataFrame(table, "doc_id long, text string, lang string"))
    key = lambda x: (x[0] is None, x[0] or 0)
    got = sorted([(x["doc_id"], x["held_out"], x["lang_pred"], x["score"]) for x in got.collect()], key=key)
    want = sorted([(k, out(k), *w) for (k, _, _), w in zip(table, want)], key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-3, atol=1e-6)
    assert len({x[2] for x in want}) == 5 and sum(x[1] for x in want) > 20


def test_language_ties_and_a_label_named_und(spark, tmp_path):
    """Labels of one distribution tie: the first by name; a label ``und`` does not drop its documents."""
    rows = [(k, "one and the same text", x) for k, x in enumerate(["zz", "aa", "mm"] * 4) if not k % 4 == 2]
    known = spark.createDataFrame([(k, "one and the same text", x) for k, x in enumerate(["zz", "aa", "mm"])],
                                  "doc_id long, text string, lang string")
    model = language_id.train(known)
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(asked, model).collect()} == {"aa"}
    named = spark.createDataFrame([(k, f"word number {k}", "und") for k in range(12)] + [(90, "", "und"), (91, None, "en")],
                                  "doc_id long, text string, lang string")
    kept = language_id.determined_rows(stored(spark, named)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(12))


# ---------------------------------------------------------------- quality
def test_quality_held_out(spark):
    table, labels = (spark.read.parquet(f"{SF_MID}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.score_quality(table, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 60 and right / len(got) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (10, 0), (10, 0), (11, 0), (None, 1), (8, 1), (3, None)],
                                   "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1  # null counts as empty
    assert quality.score_quality(nothing, labels).collect() == []
    none = quality.score_quality(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_foreign_labels(spark):
    """Labels of ids that no document has take no training row's place."""
    table, labels = (spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("documents", "labels"))
    foreign = spark.range(10 ** 9, 10 ** 9 + 50_000).selectExpr("id as doc_id", "1 as quality")
    score = lambda known: [tuple(r) for r in quality.score_quality(table, known).orderBy("doc_id").collect()]
    own = labels.select("doc_id", labels["quality"].cast("int").alias("quality"))
    assert score(own) == score(own.unionByName(foreign))


def brute_tree(g, h, leaves, ridge):
    """Values by bin: the best of all splits of all leaves, one after the other."""
    value = lambda a, b: sum(g[a:b]) / (sum(h[a:b]) + ridge)
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, leaf, cut = max(((worth(a, k) + worth(k, b) - worth(a, b), (a, b), k)
                               for a, b in parts for k in range(a + 1, b)), default=(0, None, None))
        if gain <= 1e-12:
            break
        parts.remove(leaf)
        parts += [(leaf[0], cut), (cut, leaf[1])]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [value(a, b)] * (b - a)
    return out


def test_quality_steps_and_cells():
    """Boosted trees against exhaustive splits; scores against cells looked up one by one."""
    r = np.random.default_rng(4)
    spec = quality.BoostSpec(bins=8, pair_bins=4, rounds=5, pair_rounds=3, pairs=2)
    for _ in range(100):
        g, h = r.normal(size=8), r.random(8)
        assert np.allclose(quality._tree(g, h, spec), brute_tree(g.tolist(), h.tolist(), spec.leaves, spec.ridge))
    x = r.normal(size=(200, 4))
    model = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), spec)
    want = []
    for row in x:
        bin_of = lambda cuts, k: sum(c <= row[k] for c in cuts[k])
        z = model.intercept + sum(t[bin_of(model.cuts, k)] for k, t in enumerate(model.tables))
        z += sum(t[bin_of(model.pair_cuts, a), bin_of(model.pair_cuts, b)]
                 for (a, b), t in zip(model.pairs, model.pair_tables))
        want.append(1 / (1 + math.exp(-z)))
    assert np.allclose(model.score(x), want) and len(model.pairs) == 2


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, docs, tmp_path):
    """Columns stay, each decision takes effect, the last stage has a row for each that is left."""
    bench = spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, left, str(tmp_path))
        if k < 4:
            assert done.columns == docs.columns
            done = stored(spark, done)
            assert done.count() <= left.count()
        else:
            assert done.count() == left.count()
        left = done
    ids = {r["doc_id"] for r in left.collect()}
    assert 8 in ids and not ids & {4, 5, 9, 15}  # empty and letterless texts go
    assert not ids & {1, 2, 3}  # the benchmark's passage
    assert 16 not in ids and -3 in ids  # copies: the smallest id stays


def test_pipeline_empty(spark, nothing, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = nothing
    for _, stage in corpus_pipeline.STAGES:
        left = stored(spark, stage(spark, left, str(tmp_path)))
    assert left.count() == 0


def test_pipeline_is_clean(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").join(got.select("doc_id"), "doc_id")
    assert table.count() == got.count()
    again = decontaminate.report(table, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))
    assert again.filter("contaminated").count() == 0
