"""Enough of CSS to know what is not drawn: declarations, rules of style sheets, and the elements they are for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from .dims import WIDE_SPACE

_lexical = re.compile(rf"(?P<comment>/\*.*?(?:\*/|\Z))|\\(?P<hex>[0-9a-f]{{1,6}})[{WIDE_SPACE}]?|\\(?P<char>.)|(?P<space>[{WIDE_SPACE}]+)", re.S | re.I | re.A)
_number = re.compile(rf"([-+]?(?:\d+\.?\d*|\.\d+))[{WIDE_SPACE}]*([a-z]+|%)?", re.A | re.I)
_important = re.compile(r" ?! ?important$", re.I)


def plain(text: str) -> str:
    """CSS without comments and escapes, white space as single spaces."""

    def one(m: re.Match) -> str:
        if m["hex"]:
            cp = int(m["hex"], 16)
            return chr(cp) if 0 < cp <= 0x10FFFF and not 0xD800 <= cp < 0xE000 else ""
        return "" if m["comment"] else m["char"] or " "

    return re.sub(f"[{WIDE_SPACE}]+", " ", _lexical.sub(one, text)).strip(" ")


class Declaration(NamedTuple):
    name: str
    value: str


def declarations(text: str) -> list[Declaration]:
    """Of text that is ``plain``."""
    out = []
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out.append(Declaration(name.strip(" ").lower(), _important.sub("", value.strip(" ").lower())))
    return out


def _quantity(value: str, whole: bool = True) -> tuple[float, str] | None:
    m = (_number.fullmatch if whole else _number.match)(value)
    return (float(m[1]), (m[2] or "").lower()) if m else None


def _is_zero(value: str, *units: str) -> bool:
    found = _quantity(value)
    return found is not None and found[0] == 0 and found[1] in ("", *units)


def _argument(value: str, function: str) -> tuple[float, str] | None:
    """The first argument of ``function`` if the value is a call of it."""
    name, bracket, rest = value.partition("(")
    return _quantity(rest.strip(" "), whole=False) if bracket and name.strip(" ") == function else None


def _far(d: Declaration) -> bool:
    found = _quantity(d.value, whole=False)
    return (d.name.endswith("left") or d.name in ("top", "text-indent")) and found is not None and found[0] <= -100 and found[1] in ("px", "em", "rem")


def _clipped(d: Declaration) -> bool:
    if d.name not in ("clip", "clip-path"):
        return False
    rect, inset = _argument(d.value, "rect"), _argument(d.value, "inset")
    return rect is not None and rect[0] == 0 or inset is not None and inset in ((100, "%"), (50, "%"))


def whitish(value: str) -> bool:
    """White, or transparent."""
    named = re.match(r"#fff(?:fff)?\b|white\b|transparent\b", value)
    return bool(named) or re.match(r"rgba?\(255,255,255", value.replace(" ", "")) is not None


def _grounded(d: Declaration) -> bool:
    """A background of its own, on which white may be read, or letters cut out of one."""
    if d.name in ("background-clip", "-webkit-background-clip"):
        return d.value.startswith("text")
    return d.name in ("background", "background-color", "background-image") and d.value != "" and not whitish(d.value) and not re.match(r"(?:none|inherit|initial|unset)\b", d.value)


#: What hides by a declaration of its own, in the order in which it is named.
_ways = (
    ("display:none", lambda d: d.name == "display" and d.value == "none"),
    ("visibility:hidden", lambda d: d.name == "visibility" and d.value in ("hidden", "collapse")),
    ("opacity:0", lambda d: d.name == "opacity" and _is_zero(d.value, "%")),
    ("font-size:0", lambda d: d.name == "font-size" and _is_zero(d.value, "px", "pt", "em", "rem", "%")),
    ("pushed off-screen", _far),
    ("clipped to nothing", _clipped),
)


def hiding(said: list[Declaration]) -> tuple[str, bool] | None:
    """(how, certain) of the first way in which these declarations hide."""
    for how, hides in _ways:
        if any(map(hides, said)):
            return how, True
    flat = next((i for i, d in enumerate(said) if d.name in ("height", "max-height") and _is_zero(d.value, "px")), len(said))
    if any(d.name == "overflow" and d.value == "hidden" for d in said[flat + 1 :]):
        return "zero height", True
    if any(d.name == "color" and whitish(d.value) for d in said) and not any(map(_grounded, said)):
        return "white or transparent text", False
    return None


class Block:
    """A prelude with what stands between its braces."""

    def __init__(self, prelude: str):
        self.prelude, self.said, self.inner = prelude, [], []


def parsed(sheet: str) -> Block:
    """The blocks of a sheet that is ``plain``; what is open at its end is closed there."""
    around, held = [Block("")], ""
    for part in re.split("([{};])", sheet):
        if part == "{":
            around[-1].inner.append(Block(held.strip(" ")))
            around.append(around[-1].inner[-1])
        elif part in (";", "}"):
            around[-1].said.append(held)
            if part == "}" and len(around) > 1:
                around.pop()
        else:
            held = part
            continue
        held = ""
    around[-1].said.append(held)
    return around[0]


def drawn(condition: str) -> bool:
    """Whether rules under this at-rule hold for a screen."""
    name, _, query = condition.lower().partition(" ")
    name = re.match("@?[a-z-]*", name)[0]
    if name == "@media":
        media = set(re.findall("[a-z-]+", condition.lower()))
        return "print" not in media or bool(media & {"screen", "all"})
    return name in ("@supports", "@layer", "@container", "@scope")


class Subject(NamedTuple):
    """The element that a selector ends on."""

    tag: str
    classes: frozenset
    id: str
    text: str

    def fits(self, tag: str, classes: set, id_: str | None) -> bool:
        return self.tag in ("", tag) and self.id in ("", id_) and self.classes <= classes


def subject(selector: str) -> Subject | None:
    """None for what depends on more than a tag, classes and an id."""
    steps = re.split("[ >+~]", selector.strip(" "))
    if not re.fullmatch(r"(?:[a-z][a-z0-9-]*)?(?:[.#][-_a-z0-9]+)*", steps[-1], re.I) or not steps[-1]:
        return None
    parts = {mark: [] for mark in ("", ".", "#")}
    for part in re.findall("[.#]?[^.#]+", steps[-1]):
        parts[part[0] if part[0] in ".#" else ""].append(part.lstrip(".#"))
    return Subject("".join(parts[""]).lower(), frozenset(parts["."]), (parts["#"] or [""])[-1], steps[-1])


class Rules:
    """Rules by the rarest part of their subjects, so that an element meets only those that it may fit."""

    def __init__(self, rules: list[tuple[Subject, str, bool]]):
        common = Counter(part for s, *_ in rules for part in self.parts(s))
        self.by: dict[tuple[str, str], list[tuple[int, tuple[Subject, str, bool]]]] = {}
        for n, rule in enumerate(rules):
            key = min(self.parts(rule[0]), key=common.__getitem__, default=("", ""))
            self.by.setdefault(key, []).append((n, rule))

    @staticmethod
    def parts(s: Subject) -> list[tuple[str, str]]:
        return [("#", s.id)] * (s.id != "") + [(".", c) for c in s.classes] + [("", s.tag)] * (s.tag != "")

    def first(self, tag: str, classes: set, id_: str | None) -> tuple[Subject, str, bool] | None:
        """The rule of least number that fits."""
        keys = [("", tag), ("", ""), *((".", c) for c in classes)] + [("#", id_)] * (id_ is not None)
        fits = (next((x for x in self.by.get(key, ()) if x[1][0].fits(tag, classes, id_)), None) for key in dict.fromkeys(keys))
        return min(filter(None, fits), key=lambda x: x[0], default=(0, None))[1]


def hiding_rules(sheet: str) -> Iterator[tuple[Subject, str, bool]]:
    """(subject, how, certain) of the rules of a sheet that hide on a screen, in order. White text under a dark scheme does not."""

    def walk(block: Block, dark: bool) -> Iterator[tuple[Subject, str, bool]]:
        for inner in block.inner:
            if inner.prelude.startswith("@"):
                if drawn(inner.prelude):
                    yield from walk(inner, dark or "prefers-color-scheme:dark" in inner.prelude.lower().replace(" ", ""))
                continue
            found = hiding(declarations(";".join(inner.said)))
            if found and (found[1] or not dark):
                for s in filter(None, map(subject, inner.prelude.split(","))):
                    yield s, *found
            yield from walk(inner, dark)

    return walk(parsed(plain(sheet)), False)
