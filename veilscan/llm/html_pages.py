"""Generated web pages of many layouts with known main text, to train the extraction.

A page is an article in one of ``LAYOUTS`` among furniture that is drawn at
random: menus, headers, footers, sidebars, notices, adverts, forms and reader
comments. ``marked`` pages carry the character ``MARK`` once in each text of the
article, so that a node is known by what it holds and not by how it is named.
"""

from __future__ import annotations

import html as escaping
import random
from collections.abc import Callable

#: Stands in article texts of marked pages; a private-use character, which no text of a page holds.
MARK = "\ue000"
_syllables = "an ar bel con da el fi gor ha in jo ka lu men no or pa qui re sol tu un ver wi yo za".split()
_odd = ("###", "%%%", "***", "$", "&", "...", ":", ";")


class Maker:
    """Draws the parts of one page and keeps the article's texts in page order."""

    def __init__(self, seed: int, marked: bool):
        self.r, self.marked, self.truth = random.Random(seed), marked, []
        self.ends, self.odd = self.r.choice((0.05, 0.15, 0.3)), self.r.choice((0, 0, 0, 0.2))
        #: How many of the article's texts are a link for the most part.
        self.linked = self.r.choice((0,) * 9 + (0.5, 1, 1))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        out = "".join(self.r.choices(_syllables, k=self.r.randint(1, 4)))
        return out + self.r.choice(_odd) if self.odd and self.chance(self.odd) else out

    def words(self, low: int, high: int) -> str:
        made = [self.word() + (self.r.choice(",.,.?") if self.chance(self.ends) else "") for _ in range(self.r.randint(low, high))]
        return " ".join(made).capitalize() + self.r.choice(("", ".", "."))

    def name(self, *names: str, always: bool = False) -> str:
        if not names or not (always or self.chance(0.7)):
            return ""
        quote = self.r.choice(('"', '"', "'"))
        return f" {self.r.choice(('class', 'class', 'id', 'role'))}={quote}{self.r.choice(names)}{quote}"

    def said(self, low: int, high: int) -> str:
        """Escaped text of the article."""
        text = self.words(low, high)
        self.truth.append(text)
        out = escaping.escape(text, quote=False).split(" ")
        if self.chance(self.linked):
            at = self.r.randint(0, min(2, len(out) - 1))
            out[at], out[-1] = f"<a href=/{self.word()}>{out[at]}", out[-1] + ("</a>" if at < len(out) - 1 else "")
            out[-1] += "</a>" if at == len(out) - 1 else ""
        elif self.chance(0.2):
            at, tag = self.r.randrange(len(out)), self.r.choice(("b", "em", "a href=/x", "span", "code", "i"))
            out[at] = f"<{tag}>{out[at]}</{tag.split()[0]}>"
        return (MARK if self.marked else "") + " ".join(out)

    # the article

    def heading(self) -> str:
        k = self.r.choice((1, 1, 2, 3))
        return f"<h{k}>{self.said(1, 12)}</h{k}>"

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.6:
            return f"<p{self.name('lead', 'text', 'para') if self.chance(0.15) else ''}>{self.said(1, 9) if self.chance(0.2) else self.said(8, 110)}{self.r.choice(('</p>', '</p>', '</p>', '', '<br></p>'))}"
        if kind < 0.7:
            return f"<div>{self.said(5, 90)}</div>"
        if kind < 0.79:
            return self.heading()
        if kind < 0.86:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.said(2, 25)}" for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if kind < 0.9:
            return f"<blockquote>{self.r.choice(('', '<p>'))}{self.said(8, 50)}</blockquote>"
        if kind < 0.93:
            return f"<pre>{self.said(3, 40)}</pre>"
        if kind < 0.96:
            return f"<figure><img src=x>{f'<figcaption>{self.said(3, 20)}</figcaption>'}</figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.said(1, 5)}" for _ in range(3)) for _ in range(self.r.randint(1, 4))) + "</table>"

    def blocks(self, low: int = 1, high: int = 10) -> list[str]:
        out = [self.heading()] if self.chance(0.7) else []
        for _ in range(self.r.randint(low, high)):
            out.append(self.block())
            if self.chance(0.05):
                out.append(self.r.choice((self.advert, self.notice, self.sidebar, self.form))(True))
        return out

    def broken(self) -> str:
        """Bare text with breaks."""
        return self.r.choice(("<br>", "<br><br>", "<br/>\n")).join(self.said(4, 70) for _ in range(self.r.randint(2, 9)))

    # the furniture

    def links(self, low: int, high: int) -> str:
        most = self.r.choice((1, 3, 3))
        one = lambda: f'<a href="/{self.word()}">{self.words(1, most)}</a>'
        n = self.r.randint(low, high)
        return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>" if self.chance(0.6) else self.r.choice((" | ", " ", " &middot; ", "", "")).join(one() for _ in range(n))

    def menu(self, _: bool = False) -> str:
        if self.chance(0.4):  # a few words side by side
            inside = self.r.choice(("", "", " ", " | ")).join(f"<a href=/{self.word()}>{self.word().capitalize()}</a>" for _ in range(self.r.choice((1, 1, 2, 3))))
            return f"<nav{self.name('menu', 'navbar') if self.chance(0.4) else ''}>{inside}</nav>"
        inside = self.links(1, 3) if self.chance(0.2) else self.links(2, 10)
        return f"<nav{self.name('menu', 'navbar')}>{inside}</nav>" if self.chance(0.6) else f"<div{self.name('menu', 'nav', 'breadcrumbs', 'main-nav', 'topNav', 'pager')}>{inside}</div>"

    def advert(self, inner: bool = False) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        return f"<{tag}{self.name('ad', 'ads', 'advert', 'ad-slot', 'banner', 'sponsored', 'promo', always=True)}>{self.words(2, 40)}</{tag}>"

    def notice(self, inner: bool = False) -> str:
        tag = self.r.choice(("div", "div", "section", "dialog"))
        return f"<{tag}{self.name('cookie-notice', 'notice', 'gdpr', 'cookies consent', 'alert', 'popup', 'modal overlay', always=tag != 'dialog')}>{self.r.choice(('', '<p>'))}{self.words(4, 40)}{self.r.choice(('', f'<button>{self.words(1, 2)}</button>'))}</{tag}>"

    def form(self, inner: bool = False) -> str:
        return f"<form{self.name('search', 'newsletter', 'signup', 'login-form')}>{self.r.choice(('<p>', '<label>', '<div>', ''))}{self.words(1, 15)}<input name=q><button>{self.words(1, 2)}</button></form>"

    def sidebar(self, inner: bool = False) -> str:
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice((self.links(2, 8), f"<p>{self.words(8, 40)}</p>", f"<p>{self.words(8, 60)}</p><p>{self.words(8, 60)}</p>"))
        return f"<aside{self.name('sidebar', 'related')}>{inside}</aside>" if self.chance(0.5) else f"<div{self.name('sidebar', 'side rail', 'related', 'widget', 'right-sidebar', always=True)}>{inside}</div>"

    def comments(self, inner: bool = False) -> str:
        def one() -> str:
            tag = self.r.choice(("div", "li", "article"))
            return f"<{tag}{self.name('comment', 'reply')}>{self.r.choice(('', f'<b>{self.word()}</b>', f'<h4>{self.word()}</h4>'))}<p>{self.words(4, 60)}</p></{tag}>"

        tag = self.r.choice(("section", "div", "ol"))
        return f"<{tag}{self.name('comments', 'comment-list', 'reader-comments', 'discussion', 'replies', always=True)}>{f'<h2>{self.words(1, 2)}</h2>' if self.chance(0.5) else ''}{''.join(one() for _ in range(self.r.randint(1, 6)))}</{tag}>"

    def footer(self, _: bool = False) -> str:
        tag, named = self.r.choice((("footer", self.name("bottom")), ("footer", ""), ("div", self.name("footer", "site-footer", "colophon", "copyright", always=True))))
        return f"<{tag}{named}>{self.r.choice(('', '<p>', '<small>'))}&copy; {self.word()} &middot; {self.words(3, 25)}{self.r.choice(('', self.links(1, 4)))}</{tag}>"

    def header(self, _: bool = False) -> str:
        tag, named = self.r.choice((("header", ""), ("header", self.name("top")), ("div", self.name("header", "masthead", "site-header", always=True))))
        inside = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(1, 8)}</p>", self.words(1, 5)))
        return f"<{tag}{named}>{inside}{self.r.choice(('', self.menu()))}</{tag}>"

    def unseen(self) -> str:
        return self.r.choice((f"<!-- {self.words(1, 9)} -->", f"<script>{self.word()}('<p>{self.word()}')</script>", f"<style>.{self.word()}{{color:red}}</style>", f"<noscript><p>{self.words(2, 9)}</p></noscript>"))


# Layouts of the article: HTML of it, its furniture being put around by ``page``.


def _semantic(m: Maker) -> str:
    tag = m.r.choice(("article", "article", "article", "main", "section"))
    inside = m.blocks()
    if m.chance(0.1):
        inside[0] = f"<header>{inside[0]}</header>" if inside[0].startswith("<h") else inside[0]
    if m.chance(0.15):
        inside.append(m.comments(True))
    return f"<{tag}{m.name('content', 'post', 'entry') if m.chance(0.4) else ''}>{''.join(inside)}</{tag}>"


def _named(m: Maker) -> str:
    inside = m.blocks() + ([m.comments(True)] if m.chance(0.15) else [])
    return f"<div{m.name('content', 'post-body', 'entry-content', 'article-text', 'story', 'main-content', always=True)}>{''.join(inside)}</div>"


def _plain(m: Maker) -> str:
    deep = m.r.randint(1, 3)
    return "<div>" * deep + "".join(m.blocks()) + "</div>" * deep


def _bare(m: Maker) -> str:
    return "".join(m.blocks())


def _divided(m: Maker) -> str:
    tag = m.r.choice(("div", "section"))
    return "".join(f"<{tag}>{m.block() if m.chance(0.3) else m.said(5, 90)}</{tag}>" for _ in range(m.r.randint(1, 9)))


def _cells(m: Maker) -> str:
    rows = [f"<td>{m.links(2, 9)}</td>"] if m.chance(0.7) else []
    rows.append(f"<td{' valign=top' if m.chance(0.5) else ''}>{m.broken() if m.chance(0.3) else ''.join(m.blocks())}</td>")
    if m.chance(0.3):
        rows.append(f"<td{m.name('ad', 'banner', 'promo', always=True)}>{m.words(2, 30)}</td>")
    return f"<table><tr>{''.join(rows)}</tr></table>"


def _typed(m: Maker) -> str:
    return f"<pre>{chr(10).join(m.said(2, 14) for _ in range(m.r.randint(2, 30)))}</pre>"


def _breaks(m: Maker) -> str:
    return m.r.choice(("{}", "{}", "<div>{}</div>", "<center>{}</center>", "<p>{}</p>")).format(m.broken())


def _text(m: Maker) -> str:
    return m.r.choice((" ", "\n", "\n\n")).join(m.said(3, 90) for _ in range(m.r.randint(1, 6)))


def _none(m: Maker) -> str:
    return "".join(m.r.choice((m.menu, m.form, m.advert, m.notice))() for _ in range(m.r.randint(1, 3)))


LAYOUTS: dict[str, Callable[[Maker], str]] = {
    "semantic": _semantic, "named": _named, "plain": _plain, "bare": _bare, "divided": _divided, "cells": _cells, "typed": _typed, "breaks": _breaks, "text": _text, "none": _none,
}
#: How often each layout is drawn, out of the sum.
OFTEN = {"semantic": 8, "named": 5, "plain": 4, "bare": 5, "divided": 3, "cells": 3, "typed": 2, "breaks": 3, "text": 2, "none": 2}


def page(seed: int, marked: bool = False, layouts: dict[str, Callable[[Maker], str]] = LAYOUTS) -> tuple[str, str]:
    """A page and its main text."""
    m = Maker(seed, marked)
    kind = m.r.choices(list(layouts), [OFTEN.get(x, 1) for x in layouts])[0]
    fragment = m.chance(0.8 if kind == "text" else 0.2)
    crowded = m.r.choice((0, 0.3, 0.6, 0.6, 0.9)) if kind != "text" else 0
    before = [f() for f in (m.header, m.menu, m.notice, m.advert, m.sidebar, m.form) if m.chance(crowded * 0.7)]
    if kind not in ("text", "none") and m.chance(0.3):
        before.append(m.menu())
    after = [f() for f in (m.sidebar, m.advert, m.comments, m.form, m.menu) if m.chance(crowded * 0.5)] + ([m.footer()] if m.chance(crowded) else [])
    between = lambda: m.r.choice(("", "", "\n", m.unseen()))
    inside = between().join(before) + between() + layouts[kind](m) + between() + between().join(after)
    if crowded and m.chance(0.25):
        inside = f"<div{m.r.choice(('', ' id=wrap', ' class=page', ' class=container'))}>{inside}</div>"
    if not fragment:
        head = f"<head><title>{m.words(2, 9)}</title>{''.join(m.unseen() for _ in range(m.r.randint(0, 3)))}" + m.r.choice(("</head>", "</head>", ""))
        inside = f"{m.r.choice(('<!DOCTYPE html>', ''))}<html>{head}<body>{inside}" + m.r.choice(("</body></html>", "</body></html>", ""))
    return inside, " ".join(" ".join(m.truth).split())
