"""Text blocks of an HTML page with the path of containers around them. One linear scan."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import xxhash

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_BARE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_DIGITS = re.compile(r"\d+")

#: Elements whose content is not text of the page, and those of them that hold elements of their own name.
RAW = frozenset("script style noscript template svg iframe select textarea title object canvas video audio".split())
NESTED = frozenset("svg object canvas video audio template noscript select".split())
#: Elements that make up the path of a block.
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table figure details"
    " dialog menu blockquote fieldset button".split()
)
#: Elements at whose borders a block ends.
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre figcaption hr address summary legend".split()
)
#: Containers that never hold the article, and those that don't outside of it.
ASIDE = frozenset("head nav footer aside form dialog menu button".split())
OUTER_ASIDE = frozenset(["header"])
#: Words of class, id and role that mark such containers.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav"
    " navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup"
    " modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations comment comments reply replies discussion respond disqus feedback footer widget toolbar"
    " pagination pager search contentinfo complementary dialog paywall".split()
)
OUTER_ASIDE_WORDS = frozenset(["header", "masthead", "topbar"])
#: Words that may stand beside them in a name. Inside the article a name with any other word tells of its subject.
LAYOUT_WORDS = frozenset(
    "area articles author bar block body bottom box btn button buttons card cards center code col column container"
    " content count desktop entry fixed flex form full grid group head heading icon icons inline inner input item items"
    " label large layout left link links list main mobile module mpu new news outer page pages panel post posts primary"
    " right row section sections slot small space sticky stories story tab text thread title to tools top unit us"
    " view wide wrap wrapper with".split()
)
#: The few of them that an article element itself must not carry.
ARTICLE_WORDS = frozenset("ad ads advert advertisement promo sponsored related comment comments reply replies".split())


@dataclass
class Place:
    """A container: its name, the hash of its path, and where that is."""

    name: str
    path: int
    aside: bool
    main: bool


@dataclass
class Block:
    place: Place
    text: str
    link_chars: int


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: open and close tags with attributes, and raw text."""
    at, n = 0, len(page)
    nested: dict[str, dict[int, int]] = {}
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        bare = _BARE.match(page, start)
        if bare and (name := bare[2].lower()) not in RAW:
            yield "close" if bare[1] else "open", name, ""
            at = bare.end()
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(page, start)
        if not tag:
            if page.startswith(("<!", "<?", "</"), start):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = start + 1
            continue
        end, quote_from = page.find(">", tag.end()), tag.end()
        while end >= 0:  # a ">" inside quotes does not end the tag
            inside = page[quote_from:end]
            quote = next((q for q in "\"'" if inside.count(q) % 2), None)
            closing = page.find(quote, end) if quote else -1
            if closing < 0:
                break
            quote_from, end = closing + 1, page.find(">", closing)
        if end < 0:
            return
        name, at = tag[2].lower(), end + 1
        if tag[1]:
            yield "close", name, ""
            continue
        yield "open", name, page[tag.end() : end]
        if name in NESTED:
            if page[end - 1] != "/":
                if name not in nested:
                    nested[name] = _nested_ends(page, name)
                at = nested[name].get(start, at)
        elif name in RAW:
            closing = re.compile(f"</{name}", re.I).search(page, at)
            if not closing:
                return
            end = page.find(">", closing.end())
            at = n if end < 0 else end + 1


def _nested_ends(page: str, name: str) -> dict[int, int]:
    """Where the elements of ``name`` end, by where they open; those that are never closed are left out."""
    ends, opened = {}, []
    for tag in _nested_tags(name).finditer(page):
        if tag[1]:
            if opened:
                ends[opened.pop()] = tag.end()
        elif not tag[2]:
            opened.append(tag.start())
    return ends


@functools.cache
def _nested_tags(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*?(/?)>", re.I)


def _words(attributes: str) -> tuple[list[list[str]], bool, str]:
    """Words of each name in class, id and role; whether the element is hidden; a label without numbers."""
    names, hidden, label = [], False, ""
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            names += [[w.lower() for w in _NAME.findall(part)] for part in value.split()]
            label += "." + _DIGITS.sub("0", value)
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= "display:none" in value.replace(" ", "").lower()
    return names, hidden, label


def _names_aside(words: list[str]) -> bool:
    """Inside the article a whole name must tell of an aside: ``share-buttons`` does, ``share-of-market`` not."""
    return any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in LAYOUT_WORDS or len(w) < 2 for w in words)


def _enter(parent: Place, name: str, attributes: str) -> Place:
    names, hidden, label = _words(attributes) if attributes else ([], False, "")
    words = {w for own in names for w in own}
    main = parent.main or name in ("article", "main") or "main" in words and name in ("div", "section")
    if name in ("html", "body", "main"):
        marked = False
    elif name == "article":
        marked = bool(words & ARTICLE_WORDS)
    elif parent.main:
        marked = any(map(_names_aside, names))
    else:
        marked = bool(words & (ASIDE_WORDS | OUTER_ASIDE_WORDS))
    aside = parent.aside or hidden or marked or name in ASIDE or not parent.main and name in OUTER_ASIDE
    key = f"{parent.path}/{name}{label}".encode()
    return Place(name, xxhash.xxh64_intdigest(key) >> 1, aside, main)


ROOT = Place("", 0, False, False)


def page_blocks(page: str | None) -> tuple[list[Block], list[Place]]:
    """Blocks outside of asides in page order, and every container in the order it opens."""
    blocks: list[Block] = []
    stack, opened = [ROOT], [ROOT]
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    links, in_link = 0, False

    def end_block() -> None:
        nonlocal parts, links
        if parts:
            text = "" if stack[-1].aside else " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1], text, min(links, len(text))))
            parts, links = [], 0

    for kind, name, rest in _events(page or ""):
        if kind == "text":
            parts.append(rest)
            if in_link:
                links += len(rest)
            continue
        if name == "a":
            in_link = kind == "open"
        elif name == "br":
            parts.append("\n")
        elif name in BLOCKS:
            end_block()
            if name not in CONTAINERS:
                continue
            if kind == "open":
                stack.append(_enter(stack[-1], name, rest))
                opened.append(stack[-1])
                open_names[name] += 1
            elif open_names[name]:
                while True:
                    left = stack.pop().name
                    open_names[left] -= 1
                    if left == name:
                        break
    end_block()
    return blocks, opened
