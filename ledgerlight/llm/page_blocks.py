"""Blocks of text of an HTML page, by a tolerant scan of its tags.

The scan is linear in the page. Blocks inside what markup names as no text of the
page (menus, footers, forms, adverts, comments, ...) are left out; of the others it
is told whether they stand in what the page declares to be its article.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul option".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no text of the article.
_LEFT_OUT = frozenset("head script style title textarea iframe noembed noframes xmp noscript template svg math canvas object audio video nav footer aside form button select menu dialog search".split())
#: Words of a class or id, and roles, that name the same.
_NAMES = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs footer sidebar aside rail ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay interstitial paywall comment comments disqus respond replies share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login signin search widget widgets toolbar pagination pager copyright skip hidden".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOT = frozenset(("has", "with", "no", "without", "not"))
#: Classes and ids of what holds the article; the second kind may hold more besides.
_ARTICLE = frozenset("article article-body article-content article-text post post-body post-content entry entry-content story story-body".split())
_MAIN = frozenset("content main main-content page-content".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?/]")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SEPARATORS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(html: str, at: int, last_quote: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from behind its name, and where the tag ends; -1 if it does not."""
    found: dict[str, str] = {}
    n = len(html)
    while True:
        while at < n and (html[at].isspace() or html[at] == "/"):
            at += 1
        if at >= n:
            return found, -1
        if html[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(html, at) if at < last_quote or html[at] not in "\"'" else None
        if not m or m.end() == at:
            at += 1
            continue
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


def _named(value: str) -> bool:
    for name in value.split():
        words = [w for w in _SEPARATORS.split(_CAMEL.sub("-", name).lower()) if w]
        if words and words[0] not in _NOT and not _NAMES.isdisjoint(words):
            return True
    return False


def _left_out(name: str, attributes: dict[str, str]) -> bool:
    if name in _LEFT_OUT:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    return _named(attributes.get("class", "")) or _named(attributes.get("id", "")) or bool(_HIDDEN.search(attributes.get("style", "")))


def _is_header(name: str, attributes: dict[str, str]) -> bool:
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    return name == "header" or (name not in ("html", "body", "main", "article") and ("header" in words or "masthead" in words) and not {"header", "masthead"}.isdisjoint(_SEPARATORS.split(words)))


def _declared(name: str, attributes: dict[str, str]) -> int:
    """2 for an element that holds the article, 1 for one that holds it among others, else 0."""
    own = {*attributes.get("class", "").lower().split(), attributes.get("id", "").lower()}
    if name == "article" or attributes.get("itemprop") == "articleBody" or (own & _ARTICLE and name in ("div", "section", "td")):
        return 2
    return int(name == "main" or attributes.get("role") == "main" or bool(own & _MAIN and name in ("div", "section", "td")))


def blocks(html: str) -> tuple[list[str], bool]:
    """The blocks of a page, from top to bottom, and whether they are those of its declared article.

    White space in a block is one blank; empty blocks are left out. If the page
    declares an article with text, only its blocks are given (with a top heading that
    stands beside it in the declared main part).
    """
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, left out, header, declared
    opened: Counter[str] = Counter()
    out = headers = 0
    held = [0, 0, 0]  # open elements by what they declare
    heading = level = 0

    def end() -> None:
        nonlocal level
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                found.append((level, text))
            parts.clear()

    def pop() -> str:
        nonlocal out, headers, heading
        name, skipped, header, declared = stack.pop()
        opened[name] -= 1
        out -= skipped
        headers -= header
        heading -= name in _HEADINGS
        held[declared] -= 1
        return name

    at, n, last_quote = 0, len(html), max(html.rfind('"'), html.rfind("'"))
    while at < n:
        m = _TAG.search(html, at)
        upto = m.start() if m else n
        if upto > at and not out and not (headers and not (heading and (held[1] or held[2]))):
            level = 2 if held[2] or (held[1] and opened["h1"]) else 1 if held[1] else 0
            parts.append(html[at:upto])
        if not m:
            break
        if m[0] == "<!--":
            at = html.find("-->", m.end())
            at = n if at < 0 else at + 3
            continue
        if not m[2]:  # a declaration, or what browsers take for a comment
            at = html.find(">", m.end())
            at = n if at < 0 else at + 1
            continue
        name = m[2].lower()
        attributes, at = _attributes(html, m.end(), last_quote)
        if at < 0:
            break
        if name in _BLOCK:
            end()
        elif name == "br" or name in ("td", "th"):
            parts.append(" ")
        if m[1]:
            if opened[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\b", re.I).search(html, at)
            at = close.start() if close else n
            continue
        if name in _BLOCK and opened["p"] > 0:
            while pop() != "p":
                pass
        elif name in ("li", "dt", "dd", "option") and opened[name] > 0:
            above = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 33), -1) if stack[i][0] in ("li", "dt", "dd", "option", "ul", "ol", "dl", "select")), None)
            if above is not None and stack[above][0] not in ("ul", "ol", "dl", "select"):
                while len(stack) > above:
                    pop()
        skipped, header, declared = _left_out(name, attributes), _is_header(name, attributes), _declared(name, attributes)
        stack.append((name, skipped, header, declared))
        opened[name] += 1
        out += skipped
        headers += header
        heading += name in _HEADINGS
        held[declared] += 1
    end()
    best = max((level for level, _ in found), default=0)
    return [text for level, text in found if level >= best], best > 0
