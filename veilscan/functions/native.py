"""Column expressions: what Spark computes without leaving the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import BIDI, CONFUSABLES, HIDDEN_KINDS, INTENTS, LINEBREAK, SAME_SEVERITY_LABELS, SPACE, STRIPPABLE_KINDS, class_of, intent_pattern, spans_by_kind
from .urls import SAME_OWNER, SHARED_SUFFIXES

_western, _element, _assigned = r"\t\n\x20-\x7e\x{C0}-\x{FF}\x{152}\x{153}", "<[a-zA-Z]|<!--", r"(?i:(?:href|src|action)\s*=)"
#: Texts that match none of this cannot hold a finding: they are ASCII and precomposed Latin letters, which have no twin and are stable in all normal forms, and no markup.
SUSPECT = rf"[^{_western}]|{_element}|\]\(|\]:|{_assigned}|[A-Za-z0-9+/]{{40}}"


def suspect(text: Column) -> Column:
    """Whether a text has to be read character by character: it matches SUSPECT. Each part is looked for only in texts with what it needs, and a run of 40 only from where one begins."""
    has = lambda s: F.contains(text, F.lit(s))
    # taking out long runs is a dozen times faster than looking for a character that is in none
    strange = F.regexp_replace(text, f"[{_western}]++", "") != ""
    parts = strange, has("](") | has("]:"), has("<") & text.rlike(_element), has("=") & text.rlike(_assigned), text.rlike("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}")
    return F.coalesce(reduce(Column.__or__, parts), F.lit(False))


def chars(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


#: Characters that are of no note and drawn like no other: a short class, so that one quick pass leaves little for the long ones.
PLAIN = r"\t\n\r\x20-\x7e\x{A1}-\x{AC}\x{AE}-\x{1BF}"


def noted(text: Column) -> Column:
    """The characters of a text that may be of note."""
    return F.regexp_replace(text, f"[{PLAIN}]++", "")


def holds(text: Column, inside: str) -> Column:
    """Whether a text holds what is written with characters of note alone. Taking out long runs of plain ones first is a dozen times faster than looking for it from every place."""
    return noted(text).rlike(inside)


def without(text: Column, inside: str) -> Column:
    """A text without the characters of a class, none of which is plain; plain ones are passed over run by run."""
    return F.regexp_replace(text, f"([{PLAIN}]++)|[{inside}]", "$1")


def n_plain_letters(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]++", ""))


def beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7f]++", "")


def count_kind(text: Column, *kinds: str) -> Column:
    return F.coalesce(F.regexp_count(noted(text), F.lit(f"[{class_of(*kinds)}]")), F.lit(0)).cast("long")


def without_kind(text: Column, *kinds: str) -> Column:
    return without(text, class_of(*kinds))


def codepoints(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def utf16_units(text: Column) -> Column:
    return F.coalesce(F.octet_length(F.encode(text, "UTF-16BE")) / 2, F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def visible_text(text: Column) -> Column:
    return without_kind(text, *HIDDEN_KINDS)


def stripped_text(text: Column) -> Column:
    """The native part of sanitizing: hidden characters out, spaces and line breaks plain."""
    out = without_kind(text, *STRIPPABLE_KINDS)
    return F.regexp_replace(F.regexp_replace(out, f"[{class_of(SPACE)}]", " "), f"[{class_of(LINEBREAK)}]", "\n")


def points(text: Column, kind: str) -> Column:
    """Codepoints of one kind, in order."""
    return F.transform(F.filter(chars(text), lambda c: _within(F.ascii(c), kind)), lambda c: F.ascii(c))


def _within(cp: Column, kind: str) -> Column:
    out = F.lit(False)
    for low, high in spans_by_kind()[kind]:
        out = out | (cp == low if low == high else cp.between(low, high))
    return out


def kind_of(ch: Column) -> Column:
    """The kind of a character; null for one of no note."""
    cp = F.ascii(ch)
    out = F.when(cp.between(0x20, 0x7E), F.lit(None).cast("string"))
    for kind in spans_by_kind():
        out = out.when(_within(cp, kind), kind)
    return out


def decode_tags(text: Column) -> Column:
    """Text in the Tags block."""
    said = F.filter(points(text, "tags"), lambda cp: cp.between(0xE0020, 0xE007E) | cp.isin(0xE0009, 0xE000A, 0xE000D))
    return F.array_join(F.transform(said, lambda cp: F.decode(F.unhex(F.lpad(F.hex(cp - 0xE0000), 2, "0")), "UTF-8")), "")


def text_score(text: Column) -> Column:
    """The share of characters that are readable: ASCII counts 1, other letters, digits, punctuation and spaces 0.9; 0 for an empty text."""
    rest = F.regexp_replace(text, r"[\t\n\r\x20-\x7e]++", "")
    others = F.length(rest) - F.length(F.regexp_replace(rest, r"[\p{L}\p{N}\p{P}\p{Zs}]++", ""))
    return F.when(F.length(text) > 0, (F.length(text) - F.length(rest) + others * 0.9) / F.length(text)).otherwise(0.0)


def lossy(raw: Column) -> Column:
    """Bytes as text: what is no UTF-8 is replaced, one mark of byte order at the start dropped."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"^\x{FEFF}", "")


def decode_variation_selectors(cps: Column) -> Column:
    """Text in the bytes that selectors stand for."""
    mine = F.filter(cps, lambda cp: cp.between(0xFE00, 0xFE0F) | cp.between(0xE0100, 0xE01EF))
    return lossy(F.unhex(F.array_join(F.transform(mine, lambda cp: F.lpad(F.hex(cp - F.when(cp < 0xE0000, 0xFE00).otherwise(0xE00F0)), 2, "0")), "")))


def octets_of(bits: Column, high_first: bool) -> Column:
    """Bytes of a text of 0 and 1; a rest of less than eight is dropped."""
    of = (lambda x: x) if high_first else F.reverse
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(bits, F.lit("[01]{8}"), F.lit(0)), lambda x: F.lpad(F.conv(of(x), 2, 16), 2, "0")), ""))


def intents(text: Column) -> Column:
    """Labels of the intents of a text, in order."""
    tries = [F.when(text.rlike(intent_pattern(p, "java")), F.lit(label)) for label, p in INTENTS]
    return F.array_compact(F.array(*tries))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^\s*(?:https?:)?//(?:[^/@\s]*@)?([^/?#\s:]+)", 1))


def registrable(host: Column) -> Column:
    """The part of a host that an owner registers."""
    parts = F.split(F.regexp_replace(F.lower(host), r"\.\z", ""), r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    shared = [F.lit(s) for s in sorted(SHARED_SUFFIXES)]
    site = F.when(last(3).isin(*shared), last(4)).when(last(2).isin(*shared), last(3)).otherwise(last(2))
    owners = F.create_map(*[F.lit(x) for pair in sorted(SAME_OWNER.items()) for x in pair])
    return F.coalesce(owners[site], site)


def fingerprint(cps: Column) -> Column:
    """FNV-1a of the low three bytes of each codepoint; null for none."""
    low = F.flatten(F.transform(cps, lambda x: F.array(x.bitwiseAND(255), F.shiftright(x, 8).bitwiseAND(255), F.shiftright(x, 16).bitwiseAND(255))))
    h = F.aggregate(low, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.when(F.size(cps) > 0, F.lpad(F.lower(F.hex(h)), 8, "0"))


def confusable_count(text: Column) -> Column:
    """Characters of the table of lookalikes."""
    inside = "".join(f"\\x{{{cp:X}}}" for cp in sorted(CONFUSABLES))
    return F.coalesce(F.regexp_count(noted(text), F.lit(f"[{inside}]")), F.lit(0)).cast("long")


def severity_label(severity: Column) -> Column:
    return F.get(F.array(*map(F.lit, SAME_SEVERITY_LABELS)), severity + 1)


def human_text(text: Column) -> Column:
    """For texts without excused characters: hidden ones out, directional controls kept."""
    return without_kind(text, *[k for k in HIDDEN_KINDS if k != BIDI])
