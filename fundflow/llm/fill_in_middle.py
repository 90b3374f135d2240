"""Fill-in-middle transformation: cut at unit boundaries, reorder, restore exactly.

A text's units are ``[A-Za-z]+|[^A-Za-z]``.  Their last bytes are marked in
64-bit words (``swar``), the units counted by word, and the byte behind a
given number of units is found by searching the running counts and resolving
the place within the word.  No unit is ever a Python object.

Two hashes of the id choose the cuts, two more the form: ``plain`` (the text
as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
A text that is empty or holds a sentinel is always plain, so every sentinel
occurs once in the other forms and ``restored`` is exact.

Defined results: null counts as empty; a null id is hashed as ``null``; rows
of equal ids are cut alike where their texts are; an empty table gives no
rows.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fundflow.llm import swar
from fundflow.llm.text import flat, pieces, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of these in the order suffix, prefix, middle.
CUT_RATE, SPM_RATE = 90, 20
SEED = 1

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                   ("middle_chars", pa.int64()), ("output", pa.string())])


def holds_sentinel(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each row, whether one of the sentinels occurs in it."""
    out = np.zeros(len(off) - 1, bool)
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(off, at, side="right") - 1
    out[row[at + 3 <= off[row + 1]]] = True
    return out


def cut(data: np.ndarray, off: np.ndarray, h: np.ndarray):
    """Units of each row, end bytes of its prefix and middle, and code points of both.

    ``h`` is rows x 2: the hashes that choose the cuts.
    """
    w = swar.words_of(data)
    ends = swar.unit_ends(data, off, w)
    first = ends.rank(off)
    n = np.diff(first)
    units = np.sort(h % (n + 1)[:, None], axis=1)
    at = np.repeat(off[:-1, None], 2, axis=1)
    some = units > 0
    at[some] = ends.select((first[:-1, None] + units - 1)[some]) + 1
    points = swar.code_points(w)
    before = points.rank(np.column_stack([off[:-1], at]))
    return n, at, np.diff(before, axis=1)


def transform_batch(texts: pa.Array, *hashes: pa.Array) -> pa.Array:
    h = np.column_stack([np.asarray(x).astype(np.int64) for x in hashes]).reshape(-1, 4)
    tags = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    counts, forms, chars, outputs = [], [], [], []
    for a, b in pieces(texts):
        data, off = flat(texts.slice(a, b - a))
        n, at, points = cut(data, off, h[a:b, :2])
        plain = (n == 0) | holds_sentinel(data, off) | (h[a:b, 2] % 100 >= CUT_RATE)
        form = np.where(plain, "plain", np.where(h[a:b, 3] % 100 < SPM_RATE, "spm", "psm"))
        whole, parts, size = memoryview(data), [], []
        for x, y, p, m, kind in zip(off[:-1].tolist(), off[1:].tolist(), *at.T.tolist(), form.tolist()):
            if kind == "plain":
                parts.append(whole[x:y])
            elif kind == "psm":
                parts += (tags[0], whole[x:p], tags[1], whole[m:y], tags[2], whole[p:m])
            else:
                parts += (tags[1], whole[m:y], tags[0], whole[x:p], tags[2], whole[p:m])
            size.append(y - x + (0 if kind == "plain" else 9))
        out = np.frombuffer(b"".join(parts), np.uint8)
        outputs.append(strings(out, np.concatenate([[0], np.cumsum(size)])))
        counts.append(n)
        forms += form.tolist()
        chars.append(np.where(plain[:, None], -1, points))
    chars = np.concatenate(chars) if chars else np.zeros((0, 2), np.int64)
    known = lambda k: pa.array(chars[:, k], pa.int64(), mask=chars[:, k] < 0)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(forms, pa.string()), known(0), known(1),
         pa.concat_arrays(outputs) if outputs else pa.array([], pa.string())], fields=list(_KIND))


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id and the columns of RESULT."""
    run = F.arrow_udf(transform_batch, RESULT)
    return (docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text), *hashes(F.col(doc_id), seed)).alias("r"))
            .select("doc_id", "r.*"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, exactly."""
    part = lambda c, tag, k: F.split_part(c, F.lit(tag), F.lit(k))
    middle, head = part(output, MIDDLE, 2), part(output, MIDDLE, 1)
    psm = F.concat(F.substring(part(head, SUFFIX, 1), len(PREFIX) + 1, 2**31 - 1), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, F.substring(part(head, PREFIX, 1), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
