"""License scans: one Aho-Corasick pass for phrases and tags, then the expressions behind the tags.

Every text is lower-cased in A-Z and reduced to its words with one space
between, so that the automaton finds a phrase wherever its words stand
consecutively, whatever parts them. Where it finds an identifier tag, the
expression after the tag in the original text, which is the longest leading part
of the line that is one, goes through a shunting-yard parser (``with`` binds before ``and``, ``and`` before ``or``) and its postfix
form is evaluated: the labels of all its licenses, and whether the licensee can
comply by permissive terms alone (``and``: both sides, ``or``: either side,
``with``: as its license).

Defined cases: a null text is an empty one; phrases may overlap and each place
counts; a malformed expression, one that breaks off after an operator among them, gives
no labels but its tag counts for the score; a full stop after an identifier ends
the expression; a word after ``and`` or ``or`` is taken for an identifier;
rows with null or equal ids are scanned like others; ids are integers, or strings that
are read as such. Phrases of one label and kind count once for the score, the surest
of them. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy

#: Phrases of the base scan and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Names and sentences of further licenses and notices, their labels, and how sure each is.
NOTICES = (
    ("gnu lesser general public license", "lgpl", 0.8),
    ("gnu library general public license", "lgpl", 0.8),
    ("gnu affero general public license", "agpl", 0.8),
    ("gnu free documentation license", "gfdl", 0.8),
    ("this program is free software you can redistribute it and or modify", "gpl", 0.7),
    ("this library is free software you can redistribute it and or modify", "lgpl", 0.7),
    ("mozilla public license", "mpl", 0.8),
    ("subject to the terms of the mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.8),
    ("eclipse distribution license", "bsd", 0.7),
    ("common development and distribution license", "cddl", 0.8),
    ("common public license", "cpl", 0.7),
    ("european union public licence", "eupl", 0.8),
    ("academic free license", "afl", 0.7),
    ("open software license", "osl", 0.6),
    ("artistic license", "artistic", 0.7),
    ("boost software license", "bsl", 0.8),
    ("python software foundation license", "python", 0.8),
    ("php license", "php", 0.5),
    ("ruby license", "ruby", 0.5),
    ("zlib license", "zlib", 0.6),
    ("isc license", "isc", 0.6),
    ("bsd license", "bsd", 0.6),
    ("2 clause bsd", "bsd", 0.7),
    ("3 clause bsd", "bsd", 0.7),
    ("the unlicense", "unlicense", 0.6),
    ("do what the fuck you want to public license", "wtfpl", 0.9),
    ("microsoft public license", "ms-pl", 0.8),
    ("microsoft reciprocal license", "ms-rl", 0.8),
    ("sil open font license", "ofl", 0.8),
    ("open data commons open database license", "odbl", 0.8),
    ("open database license", "odbl", 0.7),
    ("creative commons attribution", "cc-by", 0.6),
    ("creative commons attribution sharealike", "cc-by-sa", 0.8),
    ("creative commons attribution share alike", "cc-by-sa", 0.8),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.8),
    ("creative commons attribution noderivatives", "cc-by-nd", 0.8),
    ("creative commons zero", "cc0", 0.7),
    ("cc0 1 0 universal", "cc0", 0.9),
    ("cc by sa", "cc-by-sa", 0.7),
    ("cc by nc", "cc-by-nc", 0.7),
    ("cc by nd", "cc-by-nd", 0.7),
    ("dedicated to the public domain", "public-domain", 0.6),
    ("released into the public domain", "public-domain", 0.6),
    ("free and unencumbered software released into the public domain", "unlicense", 0.9),
    ("server side public license", "sspl", 0.8),
    ("business source license", "busl", 0.8),
    ("elastic license", "elastic", 0.6),
    ("commons clause", "commons-clause", 0.6),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.8),
    ("permission is hereby granted free of charge", "mit", 0.7),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 0.8),
    ("redistribution and use in source and binary forms", "bsd", 0.7),
    ("licensed under the apache license version 2 0", "apache", 0.9),
    ("you may not use this file except in compliance with the license", "apache", 0.5),
    ("this software is provided as is without any express or implied warranty", "zlib", 0.5),
    ("proprietary and confidential", "proprietary", 0.6),
    ("unauthorized copying of this file", "proprietary", 0.6),
)
TAG = "spdx license identifier"
SURE_BASE, SURE_TAG, SURE_BROKEN = 0.6, 0.9, 0.3
#: Families of license identifiers of the public list, by how they begin; the longest that fits is an identifier's family.
FAMILIES = (
    "0bsd", "aal", "afl", "agpl", "apache", "apl", "apsl", "artistic", "beerware", "blueoak", "bsd", "bsl", "busl", "bzip2", "catosl", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0", "cddl", "cecill", "clartistic",
    "cpal", "cpl", "curl", "ecl", "efl", "elastic", "epl", "eudatagrid", "eupl", "fair", "frameworx", "fsfap", "ftl", "gfdl", "gpl", "hpnd", "icu", "ijg", "imagemagick", "intel", "ipa", "ipl", "isc", "json", "lgpl", "libpng", "liliq", "lpl", "lppl", "miros",
    "mit", "motosoto", "mpl", "ms-pl", "ms-rl", "mulanpsl", "multics", "nasa", "naumen", "ncsa", "ngpl", "nokia", "npl", "ntp", "oclc", "odbl", "odc-by", "ofl", "ogtsl", "oldap", "openssl", "oset-pl", "osl", "php", "postgresql", "psf", "python", "qpl", "rpl",
    "rpsl", "rscpl", "ruby", "simpl", "sissl", "sleepycat", "spl", "sspl", "ucl", "unicode", "unlicense", "upl", "vim", "vsl", "w3c", "watcom", "wtfpl", "x11", "xnet", "zlib", "zpl",
)
#: Families under which any use is allowed that keeps the notice.
PERMISSIVE = frozenset((
    "0bsd", "aal", "afl", "apache", "artistic", "beerware", "blueoak", "bsd", "bsl", "bzip2", "cc-by", "cc0", "curl", "ecl", "efl", "fair", "fsfap", "ftl", "hpnd", "icu", "ijg", "imagemagick", "intel", "isc", "json", "libpng", "miros", "mit", "ms-pl", "mulanpsl", "multics",
    "naumen", "ncsa", "ntp", "odc-by", "ofl", "oldap", "openssl", "php", "postgresql", "psf", "public-domain", "python", "ruby", "ucl", "unicode", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "xnet", "zlib", "zpl",
))
BINDS = {"or": 1, "and": 2, "with": 3}

_words = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_tag = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
_ends = re.compile(r"\*/|-->|\"|'|;|,")
_token = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")


def postfix(expression: str) -> list[str]:
    """Shunting-yard; ValueError if it is no license expression."""
    out: list[str] = []
    held: list[str] = []
    at, operand = 0, True
    expression = expression.strip()
    while at < len(expression):
        if not (m := _token.match(expression, at)):
            raise ValueError(expression)
        at, token = m.end(), m[1]
        word = token.lower()
        if word in BINDS:
            if operand:
                raise ValueError(expression)
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError(expression)
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if operand or not held:
                raise ValueError(expression)
            held.pop()
        else:
            if not operand:
                raise ValueError(expression)
            out.append(token)
            operand = False
    if operand or "(" in held:
        raise ValueError(expression)
    return out + held[::-1]


def leading(line: str) -> str:
    """The longest leading part of ``line`` that is an expression; ValueError if there is none or an operator follows it."""
    at, depth, operand, end = 0, 0, True, 0
    while m := _token.match(line, at):
        token = m[1]
        name = token.rstrip(".")
        if token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token.lower() in BINDS:
            if operand:
                break
            operand = True
        else:
            if not operand or not name:
                break
            operand = False
        at = m.end() - len(token) + len(name)
        if not depth and not operand:
            end = at
        if name != token:
            break
    if not end or at > end:
        raise ValueError(line)
    return line[:end].strip()


_by_length = sorted(FAMILIES, key=len, reverse=True)


@functools.lru_cache(4096)
def family(identifier: str) -> str:
    """The family of an identifier like GPL-2.0-or-later, itself in lower case if it is of none."""
    low = identifier.lower()
    return next((f for f in _by_length if low == f or low.startswith(f + "-")), low)


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of the licenses, and whether permissive terms alone satisfy the expression."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token in BINDS:
            (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
            stack.append((left, left_ok) if token == "with" else (left | right, left_ok and right_ok if token == "and" else left_ok or right_ok))
        else:
            label = family(token)
            stack.append(({label}, label in PERMISSIVE))
    return stack.pop()


@functools.lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, label in BASE:
        made.add_word(f" {phrase} ", (len(phrase) + 1, label, "base", SURE_BASE))
    for phrase, label, sure in NOTICES:
        made.add_word(f" {phrase} ", (len(phrase) + 1, label, "notice", sure))
    made.add_word(f" {TAG} ", (len(TAG) + 1, "", "tag", 0))
    made.make_automaton()
    return made


def scan_text(text: str | None) -> dict:
    """What one text holds: the columns of ``scan``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(_words).split()
    flat = f" {b' '.join(words).decode('latin-1')} "
    places, spans, sure, tagged, counted, at = [], [], {}, False, 0, 0
    for end, (length, label, kind, weight) in sorted(_automaton().iter(flat), key=lambda x: x[0] - x[1][0]):
        start = end - length
        counted += flat.count(" ", at, start)
        at = start
        if kind == "tag":
            tagged = True
            continue
        spans.append({"word": counted, "label": label, "kind": kind})
        if kind == "base":
            places.append((counted, label))
        sure[label, kind] = max(weight, sure.get((label, kind), 0))
    expressions, permissive = [], None
    for m in _tag.finditer(text) if tagged else ():
        written = _ends.split(m[1])[0].strip()
        try:
            written = leading(written)
            labels, fine = evaluate(written)
        except ValueError:
            sure["", "broken"] = SURE_BROKEN
            continue
        expressions.append(written)
        permissive = fine if permissive is None else permissive and fine
        sure |= {(x, "tag"): SURE_TAG for x in labels}
    doubt = 1.0
    for key in sorted(sure):
        doubt *= 1 - sure[key]
    starts = [w for w, _ in places]
    base = sorted({x for _, x in places})
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(base), "labels": ",".join(sorted({x for x, _ in sure if x} | set(base))), "score": round(1 - doubt, 6),
        "spans": spans, "expressions": expressions, "permissive": permissive,
    }


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("kind", pa.string())]))), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()),
])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word: long, label: string, kind: string>>, expressions array<string>, permissive boolean"


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        rows = [{"doc_id": key} | scan_text(text) for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, RESULT)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: the counts, labels and score, the spans (word, label, kind), the parsed expressions and whether permissive terms satisfy all of them."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
