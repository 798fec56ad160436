"""One pass over the tags of a text that may be HTML: start tags with their attributes and the place where each is closed."""

from __future__ import annotations

import html
import re

from .dims import WIDE_SPACE

_name = re.compile(f"</?[{WIDE_SPACE}]*([a-z][a-z0-9-]*)", re.A | re.I)
_special = re.compile("[\"'>]")
_attribute = re.compile(f"([^{WIDE_SPACE}\"'<>/=]+)(?:[{WIDE_SPACE}]*=[{WIDE_SPACE}]*(\"[^\"]*\"|'[^']*'|[^{WIDE_SPACE}>]+))?")


class Tag:
    """A start tag from ``start`` to ``end``; its element's content ends at ``closed``, -1 if nothing closes it."""

    __slots__ = ("_held", "_source", "closed", "end", "name", "start")

    def __init__(self, name: str, start: int, end: int, source: str):
        self.name, self.start, self.end, self.closed = name, start, end, -1
        self._source, self._held = source, None

    def raw(self, name: str) -> str | None:
        """The value of an attribute as it is written; None if there is none or it has no value. The first of equal names counts."""
        if self._held is None:
            self._held = {}
            for m in _attribute.finditer(self._source):
                value = m[2]
                if value and value[0] in "\"'":
                    value = value[1:-1]
                self._held.setdefault(m[1].lower(), value)
        return self._held.get(name)

    def get(self, name: str) -> str | None:
        value = self.raw(name)
        return html.unescape(value) if value and "&" in value else value


class _Ends:
    """Where tags end: at the first > outside quotes. All places that run into the same quote share one answer, so a text is scanned once."""

    def __init__(self, text: str):
        self.text, self.known, self.low, self.high = text, {}, 0, -1

    def _next(self, at: int) -> int:
        if not self.low <= at <= self.high:
            m = _special.search(self.text, at)
            self.low, self.high = at, m.start() if m else len(self.text)
        return self.high

    def of(self, at: int) -> int:
        path, end = [], -1
        while (here := self._next(at)) < len(self.text):
            if here in self.known:
                end = self.known[here]
                break
            path.append(here)
            if self.text[here] == ">":
                end = here + 1
                break
            at = self.text.find(self.text[here], here + 1) + 1
            if not at:
                break
        self.known.update(dict.fromkeys(path, end))
        return end


def start_tags(text: str) -> list[Tag]:
    """The start tags of a text in order. An end tag closes the last open element of its name, and those of its name that end in a slash since."""
    out: list[Tag] = []
    open_: dict[str, list[list[Tag]]] = {}  # by name: levels, each with the element that opened it and the slashed ones in it
    ends, at = _Ends(text), 0
    while (at := text.find("<", at)) >= 0:
        m = _name.match(text, at)
        closing = text[at + 1 : at + 2] == "/"
        if not m or not closing and not text[at + 1].isalpha():
            at += 1
            continue
        end = ends.of(m.end())
        if end < 0:
            at += 1
            continue
        name = m[1].lower()
        levels = open_.setdefault(name, [[]])
        if closing:
            for tag in levels[-1]:
                tag.closed = at
            levels[-1].clear()
            if len(levels) > 1:
                levels.pop()
        else:
            source = text[m.end() : end - 1]
            out.append(Tag(name, at, end, source))
            if source.rstrip().endswith("/"):
                levels[-1].append(out[-1])
            else:
                levels.append([out[-1]])
        at = end
    return out
