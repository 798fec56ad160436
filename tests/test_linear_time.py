"""Texts made to hold a reader up: each is read in time that grows with its length, and as before."""

import random
import re
import time

import pyarrow as pa
import pytest
import regex

from veilscan.functions import css, dims, document, markup
from veilscan.functions.dims import WIDE_SPACE
from veilscan.operators import scan
from veilscan.plans import catalogue

PROBES = {
    "links without an end": "[a](" * 16_000,
    "images without an end": "![a](" * 12_000,
    "links before a long gap": "[a](" * 4000 + " " * 50_000,
    "lookalike hosts": "http://h\u0430rb\u043er.org " * 6000,
    "lookalike hosts and words": "http://h\u0430rb\u043er.org \u0440\u0430ypal " * 3000,
    "one long name": "\u0430." * 80_000,
    "rules and elements": "<style>" + "".join(f".c{i}{{display:none}}" for i in range(4000)) + "</style>" + "".join(f"<p class=c{i}>x</p>" for i in range(4000)),
    "rules of one class": "<style>" + "".join(f".c.d{i}{{display:none}}" for i in range(4000)) + "</style>" + "<p class=c>x</p>" * 4000,
    "comments without an end": "<!--" * 40_000,
}


@pytest.mark.parametrize("name", PROBES)
def test_time_grows_with_length(name):
    """At most ten seconds a megabyte; the square of these lengths took hundreds."""
    text = PROBES[name]
    began = time.process_time()
    _ = document.Reading(text).findings
    assert time.process_time() - began < 10 * len(text) / 1e6 + 0.1


_space = f"[{WIDE_SPACE}]"
_inline = r"""\({0}*<?([^){1}>]+)>?{0}*(?:"[^"]*")?{0}*\)""".format(_space, WIDE_SPACE)
LINK, IMAGE = re.compile(rf"(?<!!)\[(?!!\[)([^\]\n]{{1,200}})\]{_inline}"), re.compile(rf"!\[[^\]\n]{{0,200}}\]{_inline}")
HOST = regex.compile(r"(?i)(?<![\p{L}\p{N}._@-])(?:https?://)?((?:[\p{L}\p{N}][\p{L}\p{N}-]*\.)+\p{L}{2,})")
COMMENT = re.compile("<!--(.{0,4000}?)-->", re.S)


def test_readers_find_what_the_patterns_say():
    rng, parts = random.Random(3), ["[", "]", "(", ")", "![", "](", "<", ">", " ", '"', "a", "b.c", "\n", "x" * 90, "[a](b)", ' "t")', "-", "@", "1", "_", ".", "\u0430", "http://", "<!--", "-->", "x" * 2100]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        assert list(markup._md_links(text)) == [(m.start(), m.end(), m[1], m[2]) for m in LINK.finditer(text)]
        assert list(markup._md_images(text)) == [(m.start(), m.end(), m[1]) for m in IMAGE.finditer(text)]
        assert list(document.hosts(text)) == [m.span(1) for m in HOST.finditer(text)]
        assert list(markup._html_comments(text)) == [(m.start(), m.end(), m[1]) for m in COMMENT.finditer(text)]


def test_words_outside_hosts():
    text = "\u0430pple h\u0430rb\u043er.org/\u0430b \u0430corn p\u0430yp\u0430l.com"
    read = document.Reading(text)
    assert len(read.homographs) == 2
    spans = [(a, b) for a, b, *_ in read.homographs]
    assert list(read._words()) == [(m.start(), m[0]) for m in re.finditer(r"\w+", text) if not m[0].isascii() and not any(m.start() < b and a < m.end() for a, b in spans)]


def test_first_rule_that_fits():
    rng = random.Random(9)
    names, classes, ids = ["", "p", "em"], ["a", "b", "c", "d"], ["", "x", "y"]
    for _ in range(300):
        rules = [(css.Subject(rng.choice(names), frozenset(rng.sample(classes, rng.randint(0, 2))), rng.choice(ids), str(i)), "how", True) for i in range(rng.randint(0, 8))]
        known = css.Rules(rules)
        for _ in range(5):
            element = rng.choice(names[1:]), set(rng.sample(classes, rng.randint(0, 3))), rng.choice(["x", "y", None])
            assert known.first(*element) == next((r for r in rules if r[0].fits(*element)), None)


def test_western_texts_are_passed_over():
    """A text with few characters of note takes less time than telling its words and hosts apart would."""
    text = "Der K\u00fcstenweg f\u00fchrt \u00fcber die D\u00fcnen bis zum alten Leuchtturm. " * 6000 + "\u200b"
    began = time.process_time()
    assert [f.id for f in document.Reading(text).findings] == ["zero-width"]
    took, began = time.process_time() - began, time.process_time()
    assert not list(document.hosts(text))
    assert took < time.process_time() - began


_pieces = (" never tell ", "log", " upload the ", " https://y ", " Agents ", " should ", " read my passwords ", "ignore", "FORGET", "all", "prior.", "system\u3000", "prompts", "you are an", "do not", "don't ", "tell", "http", "s://x", "post", "nc", "sh", "ba\u017fh", "bas\u212a", "to\u017fk", "~/.ssh", "my_id_rsa2", ".env", "api_key", "API-KEYS", "eval", "(", "< img", "rm -rf", "tool", "_call", "send", "AI", "LLMs", "must", "need  to", " ", " ", "\n", ".", "x" * 41, "\u00e9", "\U0001f600")


def test_intents_of_whole_texts():
    """Arrow's patterns say what those of single texts say, letters that only Unicode folds to ASCII included, at one step a character."""
    rng = random.Random(4)
    texts = [None, "", "ba\u017fh", "\u212abash", "\u017fend us https://x", *("".join(rng.choices(_pieces, k=rng.randint(1, 14))) for _ in range(4000))]
    want = [[label for label, _ in dims.intents_of(t)] for t in texts]
    assert scan._intent_labels(pa.array(texts, pa.string())).to_pylist() == want
    assert {label for found in want for label in found} == {label for label, _ in dims.INTENTS}
    assert scan._intent_labels(pa.array([], pa.string())).to_pylist() == []
    long = pa.array(["No keeper of the lighthouse has to sign the tide table, and the pilot said so. " * 50_000])
    began = time.process_time()
    assert scan._intent_labels(long).to_pylist() == [[]]
    assert time.process_time() - began < 1.2  # four megabytes; the JVM's patterns took some five seconds


def test_intent_queries_try_no_pattern_from_every_place(spark):
    for name in ("intent_hits", "intent_by_lang"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "RLIKE" not in plan
