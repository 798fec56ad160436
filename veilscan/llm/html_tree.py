"""A forgiving HTML reader that keeps the block elements of a page and the text in them."""

from __future__ import annotations

import re
from html import unescape

#: Elements that stand inside a line of text, and those whose content is never shown.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head template noscript svg iframe object canvas math audio video map datalist".split())
RAW = frozenset("script style xmp noembed noframes textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head; the start of any other, or text, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Start tags that end an open paragraph, and elements that end their like.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",), "p": ENDS_P - {"p"}}
LIKE = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_attr = re.compile(r"(?:\b(?:class|id|role|aria-label|itemprop))\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_part = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Tree:
    """Parallel lists over block elements in page order; parents come before children.

    ``pieces`` holds (node, text, in a link) in page order, node -1 for a break.
    """

    __slots__ = ("tag", "parent", "depth", "tokens", "pieces", "controls", "links", "end")

    def __init__(self):
        self.tag, self.parent, self.depth, self.tokens = ["#root"], [-1], [0], [frozenset()]
        self.controls, self.links, self.pieces = [0], [0], []


def tokens_of(attributes: str) -> frozenset[str]:
    """Lower-case words of class, id, role and the like."""
    if "=" not in attributes:
        return frozenset()
    return frozenset(w.lower() for m in _attr.finditer(attributes) for w in _part.findall(m[1]))


def parse(html: str | None) -> Tree:
    tree = Tree()
    tag, parent, depth, tokens, pieces, controls, links = tree.tag, tree.parent, tree.depth, tree.tokens, tree.pieces, tree.controls, tree.links
    open_: list[tuple[str, int]] = [("#root", 0)]
    at, unseen, in_link, html = 0, 0, 0, html or ""
    head = 0  # place of the open head in open_, 0 for none

    def close(upto: int) -> None:
        nonlocal unseen, in_link, head
        while len(open_) > upto:
            name, _ = open_.pop()
            unseen -= name in UNSEEN
            in_link -= name == "a"
        if head >= upto:
            head = 0
        pieces.append((-1, "", False))

    def text(raw: str) -> None:
        if head and unseen == 1 and raw.strip(" \t\n\f\r"):
            close(head)
        if raw and not unseen:
            pieces.append((open_[-1][1], unescape(raw) if "&" in raw else raw, in_link > 0))

    for m in _markup.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == name:
                    if name in INLINE:
                        unseen_, pieces_ = unseen, len(pieces)
                        close(i)
                        del pieces[pieces_:]
                        unseen = unseen_
                    else:
                        close(i)
                    break
                if name in INLINE and open_[i][0] not in INLINE:
                    break
            continue
        # what stands in an element of the head that is not shown does not end the head, but for a body outside templates
        if head and (name not in HEAD if unseen == 1 else name == "body" and all(x != "template" for x, _ in open_[head:])):
            close(head)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = stop.start() if stop else len(html)
            if stop and (closed := html.find(">", at)) >= 0:
                at = closed + 1
            controls[open_[-1][1]] += name == "textarea"
            continue
        if name in VOID:
            if name not in ("wbr", "img"):
                pieces.append((-1, "", False))
            controls[open_[-1][1]] += name == "input"
            continue
        if name in INLINE:
            if not m[3].endswith("/"):
                if name == "a":
                    links[open_[-1][1]] += 1
                    in_link += 1
                open_.append((name, open_[-1][1]))
            continue
        for like in ("p", name) if name in ENDS_P else (name,):
            if like in ENDS_LIKE:
                same, bound = LIKE.get(like, {like}), ENDS_LIKE[like]
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] in same:
                        close(i)
                        break
                    if open_[i][0] in bound:
                        break
        node = len(tag)
        tag.append(name)
        parent.append(open_[-1][1])
        depth.append(len(open_))
        tokens.append(tokens_of(m[3]))
        controls.append(int(name in ("button", "select", "option", "label")))
        links.append(0)
        pieces.append((-1, "", False))
        unseen += name in UNSEEN
        if name == "head" and not head:
            head = len(open_)
        open_.append((name, node))
    text(html[at:])
    return tree
