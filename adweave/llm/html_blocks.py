"""Splits a page into text blocks and tag tokens; a small helper of html_extraction."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# HTML element names by their role here, and class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title xmp noframes".split())
FURNITURE = frozenset("nav footer aside form menu head script style noscript template iframe textarea title button select svg dialog object canvas label input fieldset".split())
MAIN = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead toolbar pagination pager "
    "comment comments disqus reply replies respond form newsletter subscribe subscription signup login search share sharing social related recommended contentinfo complementary search banner".split()
)
# Words that leave a class name of page furniture what it is (ad-box, comments-list), and elements that are one block of text.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center col column container content desktop fixed floating global group head icon icons inline inner item items left level link links list lists "
    "main mobile module outer page panel popup post posts primary reader readers region right row secondary section site slot small sticky thread title top unit user users wrap wrapper zone js".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption pre summary legend option title hr address".split())
#: An open element of these closes an open one of the same set, within the nearest list or table.
SIBLINGS = {x: frozenset(g) for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for x in g}
SCOPES = frozenset("ul ol menu dl table select div article section main body html nav td th".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """A token of a page: a tag (text is null) or a block of text, in page order."""

    path: str
    text: str | None
    main: bool
    furniture: bool
    heading: bool
    #: Paths of the elements around it that can hold several blocks, itself included if it is the tag of one.
    around: tuple[str, ...]


class _Open(NamedTuple):
    name: str
    block: bool
    path: str
    main: bool
    furniture: bool
    around: tuple[str, ...]


def _furnished(value: str) -> bool:
    """Whether one of the names in a class, id or role is of page furniture: all of its words, but for neutral ones."""
    return any((words := set(_WORD.findall(name))) & FURNITURE_WORDS and words <= FURNITURE_WORDS | NEUTRAL_WORDS for name in value.lower().split())


def _opened(name: str, attrs: str, parent: _Open) -> _Open:
    values = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)]
    main = parent.main or name in MAIN or any(k == "role" and v.lower() == "main" for k, v in values)
    named = name not in MAIN and name not in ("html", "body") and any(_furnished(v) for _, v in values)
    furniture = parent.furniture or name in FURNITURE or (name == "header" and not parent.main) or named
    own = "".join(f".{v}" for k, v in values if k != "id")
    block = name in BLOCK
    path = f"{parent.path}/{name}{own}" if block else parent.path
    return _Open(name, block, path, main, furniture, (*parent.around, path) if block and name not in LEAVES else parent.around)


def blocks(page: str) -> list[Block]:
    """Tags of block elements and blocks of text of a page, in page order.

    Character references are decoded, white space in a block is one space, empty blocks
    are left out. Elements that are not closed end where HTML ends them: p at the next
    block, li at the next li, and so on; a tag cut off at the end of the page is no text.
    """
    out: list[Block] = []
    stack = [_Open("", True, "", False, False, ())]
    pieces: list[str] = []
    kept: list[str] = []

    def flush() -> None:
        for parts, furniture in ((kept, stack[-1].furniture), (pieces, True)):
            if parts and (text := " ".join(html.unescape("".join(parts)).split())):
                top = stack[-1]
                out.append(Block(top.path, text, top.main, furniture, any(x.name == "h1" for x in stack[-4:]), top.around))
            parts.clear()

    def close(i: int) -> None:
        if any(x.block for x in stack[i:]):
            flush()
        del stack[i:]

    def text(piece: str) -> None:
        if piece:
            top = stack[-1]
            (pieces if top.furniture and not next(x for x in reversed(stack) if x.block).furniture else kept).append(piece)

    at = 0
    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p" or stack[i].name in SIBLINGS.get(name, ()):
                    close(i)
                    break
                if stack[i].name in SCOPES:
                    break
            flush()
        opened = _opened(name, attrs, stack[-1])
        if opened.block:
            out.append(Block(opened.path, None, opened.main, opened.furniture, name == "h1", opened.around))
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        stack.append(opened)
    text(page[at:])
    flush()
    return out
