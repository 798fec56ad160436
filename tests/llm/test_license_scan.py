import math
import random
import re

import pytest

from veilscan.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def descend(tokens):
    """(labels, permissive) of the longest leading expression and what is left, by recursive descent; None for none."""

    def primary(at):
        if at < len(tokens) and tokens[at] == "(":
            got = either(at + 1)
            return (got[0], got[1] + 1) if got and got[1] < len(tokens) and tokens[got[1]] == ")" else None
        if at < len(tokens) and tokens[at] not in ("(", ")") and tokens[at].lower() not in ("and", "or", "with"):
            low = tokens[at].lower()
            fits = [f for f in L.FAMILIES if (low + "-").startswith(f + "-")]
            label = max(fits, key=len) if fits else low
            return ({label}, label in L.PERMISSIVE), at + 1
        return None

    def chain(word, below, join):
        def parse(at):
            got = below(at)
            while got and got[1] < len(tokens) and tokens[got[1]].lower() == word:
                more = below(got[1] + 1)
                if not more:
                    return None
                got = join(got[0], more[0]), more[1]
            return got

        return parse

    excepted = chain("with", primary, lambda a, b: a)
    both = chain("and", excepted, lambda a, b: (a[0] | b[0], a[1] and b[1]))
    either = chain("or", both, lambda a, b: (a[0] | b[0], a[1] or b[1]))
    return either(0)


def brute_labels(text):
    """Labels and score by sliding windows of words and recursive descent."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    sure = {}
    for kind, table in (("base", [(p, x, L.SURE_BASE) for p, x in L.BASE]), ("notice", L.NOTICES)):
        for phrase, label, weight in table:
            parts = phrase.split()
            if any(words[i : i + len(parts)] == parts for i in range(len(words))):
                sure[label, kind, phrase] = weight
    for m in re.finditer(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)", text or ""):
        line = re.split(r"\*/|-->|\"|'|;|,", m[1])[0]
        got = descend(re.findall(r"[()]|[A-Za-z0-9.+:-]+", line))
        for label in got[0][0] if got else ():
            sure[label, "tag", ""] = L.SURE_TAG
        if not got:
            sure["", "broken", ""] = L.SURE_BROKEN
    return {x for x, *_ in sure if x}, sure


CASES = [
    None, "", "...", "MIT License", "the MIT\n\nLicense, mit license mit license", "xmit license", "mit licenses", "cc-by cc by-sa CC BY",
    "GNU General Public License apache license " * 2000, "é mit license é", "mit\x80license", "licensed under the Apache License, Version 2.0. ퟿ MIT-License",
    "gnu general public license gnu general public", "word " * 100_000 + "apache license",
]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_base_places_match_brute_force(text):
    r = L.scan_text(text)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
    assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_expressions():
    assert L.postfix("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and", "or"]
    assert L.postfix("(MIT or BSD-3-Clause) and GPL-3.0+") == ["MIT", "BSD-3-Clause", "or", "GPL-3.0+", "and"]
    assert L.evaluate("MIT OR GPL-3.0") == ({"mit", "gpl"}, True)
    assert L.evaluate("MIT AND GPL-3.0") == ({"mit", "gpl"}, False)
    assert L.evaluate("(MIT OR GPL-3.0) AND LGPL-2.1 WITH x-exception") == ({"mit", "gpl", "lgpl"}, False)
    for bad in ("", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT GPL", "()", "MIT (GPL)", "MIT ; x"):
        with pytest.raises(ValueError):
            L.postfix(bad)


def test_tags_add_labels():
    r = L.scan_text("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nx\n# spdx-license-identifier: GPL-2.0 AND\n")
    assert r["labels"] == "apache,mit" and r["base_labels"] == "" and r["expressions"] == ["(MIT OR Apache-2.0)"] and r["permissive"] and r["score"] > 0.9


def test_the_leading_part_of_a_line_is_read():
    for line, lead in {
        "Apache-2.0 Copyright 2021 X": "Apache-2.0", "MIT (see LICENSE)": "MIT", "MIT.": "MIT", "MIT. With thanks": "MIT", "(MIT OR X).": "(MIT OR X)", "(MIT) x)": "(MIT)", "MIT)": "MIT", " MIT <br>": "MIT",
        "GPL-2.0 WITH Classpath-exception-2.0 foo": "GPL-2.0 WITH Classpath-exception-2.0", "MIT OR (GPL-2.0 AND ISC) é": "MIT OR (GPL-2.0 AND ISC)",
    }.items():
        assert L.leading(line) == lead, line
    for bad in ("", "...", "MIT OR", "MIT OR OR X", "OR MIT", "(MIT OR X", "(MIT.", "MIT AND .", "MIT AND (GPL", "MIT AND (GPL OR", "é MIT"):
        with pytest.raises(ValueError):
            L.leading(bad)
    r = L.scan_text("SPDX-License-Identifier: Apache-2.0 Copyright 2021 X\nSPDX-License-Identifier: GPL-2.0.\nSPDX-License-Identifier: ISC (see LICENSE)")
    assert r["labels"] == "apache,gpl,isc" and r["expressions"] == ["Apache-2.0", "GPL-2.0", "ISC"] and r["permissive"] is False and r["n_base"] == 0


EXPRESSIONS = ["MIT", "(MIT OR Apache-2.0)", "GPL-2.0-only WITH Classpath-exception-2.0", "MIT AND (BSD-3-Clause OR CC-BY-SA-4.0)", "Zlib AND", "( OR )", "LGPL-2.1+ OR CC0-1.0 AND ISC", "LicenseRef-Own", "CC-BY-NC-ND-4.0"]


@pytest.mark.parametrize("seed", range(40))
def test_labels_and_score_match_brute_force(seed):
    rng = random.Random(seed)
    parts = [p for p, *_ in L.BASE] + [p for p, *_ in L.NOTICES]
    pieces = []
    for _ in range(rng.randint(0, 8)):
        kind = rng.random()
        if kind < 0.4:
            phrase = rng.choice(parts)
            pieces.append(rng.choice((phrase, phrase.upper(), phrase.replace(" ", rng.choice(("-", "\n", ", "))), phrase[:-1])))
        elif kind < 0.7:
            pieces.append(f"\nSPDX-License-Identifier: {rng.choice(EXPRESSIONS)}\n")
        else:
            pieces.append(" ".join(rng.choice(("word", "license", "public", "gnu", "the")) for _ in range(rng.randint(1, 9))))
    text = " ".join(pieces)
    labels, sure = brute_labels(text)
    got = L.scan_text(text)
    assert set(filter(None, got["labels"].split(","))) == labels
    # phrases of one label and kind count once, the surest of them
    most = {}
    for (label, kind, _), w in sure.items():
        most[label, kind] = max(w, most.get((label, kind), 0))
    assert got["score"] == pytest.approx(1 - math.prod(1 - w for w in most.values()), abs=1e-6)


def test_families():
    for name, family in {"GPL-2.0-or-later": "gpl", "LGPL-3.0": "lgpl", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-ND-4.0": "cc-by-nc-nd", "0BSD": "0bsd", "BSD-2-Clause": "bsd", "MITx": "mitx", "Apache-2.0": "apache", "CC0-1.0": "cc0"}.items():
        assert L.family(name) == family
    assert set(L.PERMISSIVE) - {"public-domain"} <= set(L.FAMILIES) and not L.PERMISSIVE & {"gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "cc-by-nc", "cc-by-nd", "cc-by-sa"}


def test_whole_table_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = L.query(spark, d).collect()
    assert {r.doc_id for r in got} == set(texts) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == brute_labels(texts[r.doc_id])[0]
        assert (r.score > 0) == bool(r.labels) and (not r.base_labels or r.score >= L.SURE_BASE)


def test_odd_tables(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, None, "a"), (1, "mit license", None), (1, "mit license", None)], "doc_id long, text string, labels string")
    assert sorted(r.n_base for r in L.scan(rows).collect()) == [0, 1, 1]
