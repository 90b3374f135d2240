import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Python workers start with the environment of the session
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

PASSAGE = " ".join(f"passage{k % 17}x{k}" for k in range(60))
LONG = " ".join(f"w{k * 7919 % 1013}" for k in range(30_000))

#: (doc_id, text): nulls, empties, ties, repeated rows, copies, shared passages, a very long text.
ROWS = [
    (1, f"Alpha beta. {PASSAGE} the end of one"),
    (2, f"other start\n{PASSAGE}\tand another end"),
    (3, f"Alpha  beta.\n{PASSAGE} the end of one"),
    (4, ""),
    (5, None),
    (None, f"no id here {PASSAGE} indeed"),
    (None, None),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "short text"),
    (8, "short text"),
    (9, " \t\n "),
    (10, "spam " * 300),
    (11, "spam " * 200 + "ham"),
    (12, "é à ü " * 20 + PASSAGE),
    (13, "Licensed under the MIT License. See CC-BY-NC 4.0, or the Apache License,\nVersion 2.0!"),
    (14, "under the mit license under the mit license cc by nc"),
    (15, "1234 !!! 5678"),
    (-3, "x" * 5000),
    (16, "x" * 5000),
    (17, "ab" * 40 + "\x00\x01" + "ab" * 40),
    (18, "<|endoftext|> ΑΣ ﬁ don't É"),
]

CLASHES = ("chunk", "bucket", "body", "row", "m", "fp", "row_key", "digest", "kept", "guess", "r", "label",
           "keep_id", "n_words", "score", "a", "b", "lang_pred", "held_out", "key")


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with further columns that share names with results and helpers."""
    frame = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in ROWS],
                                  "doc_id long, text string, lang string, source string").repartition(3)
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'{name}' as {name}")
    return stored(spark, frame)


def stored(spark, frame):
    from fundflow.session import scratch_path
    path = scratch_path(spark, "test-docs")
    frame.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return stored(spark, docs.filter("false"))
