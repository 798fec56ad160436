"""Addresses by their parts, and who owns a host."""

from __future__ import annotations

import re
from typing import NamedTuple

from .dims import WIDE_SPACE

#: Endings that make a bare word a host.
LABEL_TLDS = ("com", "net", "org", "edu", "gov", "mil", "int", "io", "dev", "app", "ai", "co", "xyz", "info", "biz", "cloud", "shop", "store", "online", "site", "tv", "gg", "link", "page", "news", "blog", "wiki", "tech", "bank")
#: Endings under which many owners register.
SHARED_SUFFIXES = frozenset((
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "gov.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "or.kr", "ac.kr", "go.kr", "com.cn", "net.cn", "com.tw", "com.hk", "com.sg", "co.in", "co.nz", "co.za", "com.br", "com.mx",
    "com.ar", "com.tr", "co.il", "co.id", "com.my", "com.ph", "com.vn", "github.io", "gitlab.io", "netlify.app", "vercel.app", "pages.dev", "workers.dev", "herokuapp.com", "blogspot.com", "web.app", "firebaseapp.com", "azurewebsites.net", "cloudfront.net",
    "ngrok.io", "ngrok-free.app", "glitch.me", "repl.co", "s3.amazonaws.com",
))
#: Short names of hosts and their owner's name.
SAME_OWNER = {
    "aka.ms": "microsoft.com", "youtu.be": "youtube.com", "goo.gl": "google.com", "g.co": "google.com", "git.io": "github.com", "amzn.to": "amazon.com", "fb.me": "facebook.com", "lnkd.in": "linkedin.com", "t.co": "x.com", "twitter.com": "x.com", "redd.it": "reddit.com",
    "wp.me": "wordpress.com",
}

_space = re.compile(f"[{WIDE_SPACE}]")
_run = re.compile(r"[a-z0-9.-]+", re.A | re.I)
_word_start = re.compile(f"(?:^|[{WIDE_SPACE}(<\"'])(?=[a-z0-9])", re.A | re.I)
_explicit = re.compile(r"https?://|(?<![A-Za-z0-9_])www\.", re.A | re.I)


class Address(NamedTuple):
    """scheme is "" for an address that only names a host."""

    scheme: str
    host: str
    query: str | None

    @property
    def parameters(self) -> list[tuple[str, str | None]]:
        """Names and values of the query; the value is None without an equals sign."""
        pairs = (part.partition("=") for part in (self.query or "").split("&"))
        return [(name, value if equals else None) for name, equals, value in pairs]


def address(url: str) -> Address | None:
    """The parts of an http address, or of one without a scheme; None for others."""
    url = url.strip()
    scheme, slashes, rest = url.partition("//")
    if not slashes or scheme.lower() not in ("", "http:", "https:"):
        return None
    authority = re.split(r"[/?#]", rest, maxsplit=1)[0]
    authority = _space.split(authority, maxsplit=1)[0]
    host = authority.rpartition("@")[2].partition(":")[0].lower()
    question = url.find("?")
    return Address(scheme.lower().rstrip(":"), host, url[question + 1 :] if question >= 0 else None) if host else None


def host_of(url: str) -> str | None:
    found = address(url)
    return found.host if found else None


def registrable(host: str) -> str:
    """The part of a host that an owner registers."""
    parts = host.lower().removesuffix(".").split(".")
    n = next((n for n in (3, 2) if ".".join(parts[-n:]) in SHARED_SUFFIXES and len(parts) >= n), 1)
    site = ".".join(parts[-n - 1 :])
    return SAME_OWNER.get(site, site)


def _labels(run: str) -> list[str]:
    """The leading labels of a run of host characters that are sound."""
    out = []
    for label in run.split("."):
        if not label or label[0] == "-" or label[-1] == "-":
            break
        out.append(label)
    return out


def host_in_label(label: str) -> str | None:
    """The host that a link's label names: of an address with a scheme or ``www.`` first, else a bare word with a known ending."""
    for m in _explicit.finditer(label):
        run = _run.match(label, m.end())
        parts = _labels(run[0]) if run else []
        for n in range(len(parts), 1, -1):
            ending = re.match("[a-z]{2,24}", parts[n - 1], re.I)
            if ending:
                return ".".join([*parts[: n - 1], ending[0]])
    for m in _word_start.finditer(label):
        parts = _labels(_run.match(label, m.end())[0])
        for n in range(len(parts), 1, -1):
            if parts[n - 1].lower() in LABEL_TLDS:
                return ".".join(parts[:n])
    return None
