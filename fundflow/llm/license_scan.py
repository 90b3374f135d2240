"""License scan: ordered signature rules behind a keyword prefilter.

A text is reduced to its words (lower-cased, separated by one space), so
line breaks, punctuation and case do not matter to a rule.  Rules are
regular expressions over that form, ordered by priority.  Word hashes of a
whole batch are looked up among all rules' keywords at once; a rule runs only
near a keyword of its own.  Detections are word intervals; one that lies
within a detection of a higher priority, or of the same priority and longer,
is suppressed.  The base phrases are reported apart and never suppressed.

The rules are signatures from the license texts themselves (``license_texts``:
grants, headers, conditions, warranty clauses), notices, and names: each phrasing
around the name of each license version.  A signature's keyword is its longest
word that stands in every match.

Defined results: null counts as empty; a text without detections has null
first_word and last_word, empty labels and score 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fundflow.llm.license_texts import KINDS
from fundflow.llm.text import ALNUM, LOWER, flat, pieces, span_hash, words

# The contract's phrases and labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Family, pattern of the name in normal form, keywords, versions ("" for none).  Every match of
#: a name holds one of its keywords as a word; ``x*`` is x alone, with a v, or with a version.
FAMILIES = (
    ("agpl", r"(?:gnu )?(?:affero (?:gnu )?general public licen[cs]e|agpl(?:v| v)?)", "affero agpl*", ("1.0", "3.0", "")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl(?:v| v)?", "lesser library lgpl*", ("2.0", "2.1", "3.0", "")),
    ("gpl", r"(?:gnu )?general public licen[cs]e|(?:gnu )?gpl(?:v| v)?", "general gpl*", ("1.0", "2.0", "3.0", "")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", "documentation gfdl*", ("1.1", "1.2", "1.3", "")),
    ("apache", r"apache(?: software)? licen[cs]e|apache", "apache", ("1.0", "1.1", "2.0", "")),
    ("mpl", r"mozilla public licen[cs]e|mpl", "mozilla mpl*", ("1.0", "1.1", "2.0", "")),
    ("epl", r"eclipse public licen[cs]e|epl", "eclipse epl*", ("1.0", "2.0", "")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", "distribution cddl*", ("1.0", "1.1", "")),
    ("cpl", r"common public licen[cs]e|cpl", "common cpl*", ("1.0", "")),
    ("eupl", r"european union public licen[cs]e|eupl", "european eupl*", ("1.0", "1.1", "1.2", "")),
    ("osl", r"open software licen[cs]e|osl", "software osl*", ("1.0", "2.0", "2.1", "3.0", "")),
    ("afl", r"academic free licen[cs]e|afl", "academic afl*", ("1.1", "2.0", "2.1", "3.0", "")),
    ("artistic", r"artistic licen[cs]e|artistic", "artistic", ("1.0", "2.0", "")),
    ("bsl", r"boost software licen[cs]e|bsl", "boost bsl*", ("1.0", "")),
    ("busl", r"business source licen[cs]e|busl", "business busl*", ("1.1", "")),
    ("sspl", r"server side public licen[cs]e|sspl", "server sspl*", ("1.0", "")),
    ("psf", r"python software foundation licen[cs]e|psf(?: licen[cs]e)?", "python psf*", ("2.0", "")),
    ("zpl", r"zope public licen[cs]e|zpl", "zope zpl*", ("2.0", "2.1", "")),
    ("php", r"php licen[cs]e", "php", ("3.0", "3.01", "")),
    ("ofl", r"(?:sil )?open font licen[cs]e|ofl", "font ofl*", ("1.0", "1.1", "")),
    ("odbl", r"open (?:data commons )?open database licen[cs]e|open database licen[cs]e|odbl", "database odbl*", ("1.0", "")),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", "microsoft ms", ("",)),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms rl", "microsoft ms", ("",)),
    ("upl", r"universal permissive licen[cs]e|upl", "universal upl*", ("1.0", "")),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", ("",)),
    ("bsd-2-clause", r"(?:2 clause|simplified|freebsd) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?", "bsd", ("",)),
    ("bsd-3-clause", r"(?:3 clause|new|modified|revised) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?", "bsd", ("",)),
    ("bsd-4-clause", r"(?:4 clause|original) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?", "bsd", ("",)),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd", ("",)),
    ("mit", r"mit(?: x11)? licen[cs]e|expat licen[cs]e|x11 licen[cs]e", "mit expat x11", ("",)),
    ("isc", r"isc licen[cs]e", "isc", ("",)),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ("",)),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", "fuck wtfpl*", ("2.0", "")),
    ("unlicense", r"unlicen[cs]e", "unlicense unlicence", ("",)),
    ("0bsd", r"zero clause bsd(?: licen[cs]e)?|0bsd", "bsd 0bsd", ("",)),
    ("cc0", r"(?:creative commons )?cc0|creative commons zero", "cc0 zero", ("1.0", "")),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivs|noderivatives|no derivatives)", "cc commons", ("2.0", "2.5", "3.0", "4.0", "")),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)", "cc commons", ("2.0", "2.5", "3.0", "4.0", "")),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)", "cc commons", ("2.0", "2.5", "3.0", "4.0", "")),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivs|noderivatives|no derivatives)", "cc commons", ("2.0", "2.5", "3.0", "4.0", "")),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)", "cc commons", ("2.0", "2.5", "3.0", "4.0", "")),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)", "cc commons", ("2.0", "2.5", "3.0", "4.0", "")),
)

#: Short names that ordinary prose uses too (people, leagues, helicopters): alone they name a license
#: only before the word itself.
PROSE = {"apache": "apache", "artistic": "artistic", "epl": "epl", "cpl": "cpl", "afl": "afl", "osl": "osl",
         "bsl": "bsl", "ms-pl": "ms pl", "ms-rl": "ms rl"}

#: Pattern around NAME, word it needs beside the name's, priority (higher wins), confidence.
PHRASINGS = (
    (r"spdx licen[cs]e identifier NAME", "spdx", 5, 1.0),
    (r"(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?NAME(?: as published by the free software foundation)?", "under", 4, 0.95),
    (r"(?:this|the) (?:work|program|software|library|file|document|project|code) is (?:licen[cs]ed |distributed |released |made available )?(?:subject to|under|governed by) (?:the )?(?:terms of )?(?:the )?NAME", "is", 4, 0.95),
    (r"(?:see|refer to|read) the NAME(?: for (?:more )?details)?", "the", 3, 0.8),
    (r"NAME", "", 2, 0.6),
)

#: Label, pattern, keyword (a word of every match), priority, confidence: texts that name no license.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 5, 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 5, 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission", 5, 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty", "warranty", 3, 0.5),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 5, 0.95),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "domain", 3, 0.8),
    ("all-rights-reserved", r"all rights reserved", "reserved", 1, 0.5),
    ("proprietary", r"(?:proprietary and confidential|unauthorized copying of this file)", "proprietary unauthorized", 3, 0.7),
    ("copyright", r"copyright (?:c )?(?:1[89]|20)\d\d", "copyright", 1, 0.3),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: frozenset[str]  # one of these words, and
    beside: str  # this one if not empty, must stand near
    priority: int
    confidence: float


def _version(version: str) -> str:
    """Pattern of a version in normal form: digits are words of their own."""
    major, _, minor = version.partition(".")
    tail = f" {minor}" if minor != "0" else "(?: 0)?"
    return rf" ?(?:v|version|ver)? ?{major}{tail}(?! \d)(?: or later| or any later version| only)?"


def _keywords(words: str, versions: tuple[str, ...] = ()) -> frozenset[str]:
    out = set()
    for word in words.split():
        stem = word.rstrip("*")
        out.add(stem)
        if word.endswith("*"):
            out |= {stem + v + major for v in ("", "v") for major in ("", *(x.partition(".")[0] for x in versions))}
    return frozenset(out)


def _always(pattern: str) -> frozenset[str]:
    """For each alternative of a pattern the longest word outside its groups."""
    out = set()
    for part in re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)[?*]?|\[[^]]*\](?:\{[^}]*\}|[?*+])?", "", pattern).split("|"):
        plain = [w for w in part.split() if w.isalnum()]
        out.add(max(plain, key=len))
    return frozenset(out)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out = []
    for family, name, words_, versions in FAMILIES:
        keywords = _keywords(words_, versions)
        for version in versions:
            tail = _version(version) if version else ""
            named = f"(?:{name}){tail}"
            alone = named
            if family in PROSE:
                short = PROSE[family]
                alone = f"(?:(?:{name.removesuffix('|' + short)}){tail}|{short}{tail} licen[cs]e)"
            label = f"{family}-{version}" if version else family
            for around, beside, priority, confidence in PHRASINGS:
                around = around.replace("NAME", alone if around == "NAME" else named)
                pattern = r"(?<![^ ])" + around + r"(?![^ ])"
                out.append(Rule(label, re.compile(pattern), keywords, beside,
                                2 * priority + bool(version), confidence))
    for label, pattern, words_, priority, confidence in NOTICES:
        out.append(Rule(label, re.compile(r"(?<![^ ])" + pattern + r"(?![^ ])"), _keywords(words_), "",
                        2 * priority, confidence))
    for signatures, priority, confidence in KINDS:
        for label, pattern in signatures:
            out.append(Rule(label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), _always(pattern), "",
                            2 * priority, confidence))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def gate() -> tuple[np.ndarray, dict[str, list[Rule]]]:
    """The prefilter: sorted hashes of the words of which every detection and every base phrase
    holds one, and the rules by keyword."""
    index: dict[str, list[Rule]] = {}
    for rule in rules():
        for word in rule.keywords:
            index.setdefault(word, []).append(rule)
    listed = sorted(set(index) | {"license", "nc"})
    data = np.frombuffer("".join(listed).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in listed])
    start = np.concatenate([[0], end[:-1]])
    return np.sort(span_hash(data, start, end)), index


#: No rule matches more words than this (a test holds the rules to it): a detection lies within
#: this many words of its keyword, so only those stretches of a text are searched.
REACH = 64


def detect(words_: list[str]) -> list[tuple[int, int, Rule]]:
    """(first word, last word, rule) of the detections that stay, in a text's words."""
    index = gate()[1]
    found: set[tuple[int, int, Rule]] = set()
    at = [k for k, w in enumerate(words_) if w in index]
    k = 0
    while k < len(at):
        begin = max(0, at[k] - REACH)
        end = at[k] + REACH + 1
        while k < len(at) and at[k] - REACH <= end:  # stretches that touch are one
            end = at[k] + REACH + 1
            k += 1
        found |= set(_search(words_[begin:end], begin, index))
    return sorted(_uncovered(found), key=lambda d: (d[0], d[1], d[2].label))


def _uncovered(found: set[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections within none of a higher priority, and none as high and longer (of equal ones the first label).

    Containment carries over (what covers a covering one covers the covered),
    so each is held against all, not only those that stay: one sweep by start,
    longest first, with the furthest end so far of each priority.
    """
    out, ends = [], [-1] * (max((d[2].priority for d in found), default=0) + 1)
    waiting: list[tuple[int, int, Rule]] = []

    def settle():  # detections of one interval: the highest priority's first label, if nothing reached this far
        if waiting:
            a, b, rule = min(waiting, key=lambda d: (-d[2].priority, d[2].label, -d[2].confidence))
            if max(ends[rule.priority:]) < b:
                out.append((a, b, rule))
            for x, y, r in waiting:
                ends[r.priority] = max(ends[r.priority], y)
            waiting.clear()

    for d in sorted(found, key=lambda d: (d[0], -d[1])):
        if waiting and waiting[0][:2] != d[:2]:
            settle()
        waiting.append(d)
    settle()
    return out


def _search(stretch: list[str], begin: int, index: dict[str, list[Rule]]):
    present = set(stretch)
    text = " ".join(stretch)
    start = np.cumsum([0] + [len(w) + 1 for w in stretch])
    for rule in {r for w in present for r in index.get(w, ())}:
        if rule.beside and rule.beside not in present:
            continue
        for m in rule.pattern.finditer(text):
            first = int(np.searchsorted(start, m.start(), side="right")) - 1
            last = int(np.searchsorted(start, m.end() - 1, side="right")) - 1
            yield begin + first, begin + last, rule


def base_places(words_: list[str]) -> list[tuple[int, str]]:
    """(word index, label) of all places of the base phrases in a text's words."""
    out = []
    for phrase, label in BASE:
        sought = phrase.split()
        at = -1
        while True:
            try:
                at = words_.index(sought[0], at + 1)
            except ValueError:
                break
            if words_[at:at + len(sought)] == sought:
                out.append((at, label))
    return out


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, detections array<struct<first:long, last:long, label:string, confidence:double>>")


NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0,
           "detections": []}


def _report(words_: list[str]) -> dict:
    places, found = base_places(words_), detect(words_)
    base = {label for _, label in places}
    miss = 1.0
    for _, _, rule in found:
        miss *= 1 - rule.confidence
    return {"n_base": len(places),
            "first_word": min((k for k, _ in places), default=None),
            "last_word": max((k for k, _ in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {rule.label for _, _, rule in found})),
            "score": 1.0 if base else 1 - miss,
            "detections": [{"first": x, "last": y, "label": r.label, "confidence": r.confidence}
                           for x, y, r in found]}


def scan_batch(texts: pa.Array) -> pa.Array:
    rows = []
    hashes = gate()[0]
    for a, b in pieces(texts):
        data, off = flat(texts.slice(a, b - a))
        data = LOWER[data]
        starts, ends, first = words(data, off, ALNUM)
        code = span_hash(data, starts, ends)
        key = hashes[np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)] == code
        hits = np.concatenate([[0], np.cumsum(key)])[first]
        for k, n in enumerate(np.diff(first).tolist()):
            if hits[k + 1] == hits[k]:
                rows.append({"n_words": n} | NOTHING)
                continue
            x, y = first[k], first[k + 1]
            raw = data[starts[x]:ends[y - 1]].tobytes()
            shift = int(starts[x])
            rows.append({"n_words": n} | _report(
                [raw[p - shift:q - shift].decode() for p, q in zip(starts[x:y].tolist(), ends[x:y].tolist())]))
    detection = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()),
                           ("confidence", pa.float64())])
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                      ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                      ("score", pa.float64()), ("detections", pa.list_(detection))])
    return pa.array(rows, kind)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id and the columns of SCHEMA."""
    run = F.arrow_udf(scan_batch, SCHEMA)
    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.*")
