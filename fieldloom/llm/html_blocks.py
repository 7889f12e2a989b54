"""A tolerant HTML scanner: blocks of text with the containers they stand in, and media references in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_GAP = re.compile(r"[\s/=]*")
#: Their contents aren't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their begin and end part blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: Marked articles within each other that are told apart; deeper ones count as the innermost of them.
MARKS = 16
#: Open elements of these kinds end where a new one of the kind, or any block for p, begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div body html table ul ol dl nav aside header footer form figure td th".split())
#: Containers that never hold the article.
BOILER_TAGS = frozenset("nav aside footer form script style noscript template button select iframe menu dialog svg object canvas head search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu topnav breadcrumb breadcrumbs "
    "sidebar rail widget footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments commentlist discussion disqus reply replies respond pagination pager skip login search".split()
)


@dataclass
class Block:
    """One line of the stripped page."""

    text: str
    tag: str
    boiler: bool
    #: The marked articles (numbers in page order) that it stands in, from the outermost.
    articles: tuple[int, ...]
    link_chars: int


@dataclass
class Media:
    """A reference to a media payload, with the number of blocks that stand before it."""

    source: str
    digest: str
    alt: str
    after_blocks: int
    caption: str = ""


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    media: list[Media] = field(default_factory=list)


def attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` in a tag, and the place after its end; -1 where the tag doesn't end."""
    found: dict[str, str] = {}
    while True:
        if html.startswith(">", at):
            return found, at + 1
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            at = _GAP.match(html, at).end()
            if html.startswith(">", at):
                return found, at + 1
            if at >= len(html):
                return found, -1
            continue
        name = m[1].lower()
        if name not in found:
            found[name] = unescape(m[2] or m[3] or m[4] or "")
        at = m.end()


def _is_boiler(tag: str, found: dict[str, str]) -> bool:
    if tag in BOILER_TAGS or found.get("role", "").lower() in BOILER_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if tag in ("article", "main", "body", "html"):
        return False
    return any(x in BOILER_NAMES for x in re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))


@dataclass(slots=True)
class _Open:
    """An open element, with what holds for all inside it."""

    tag: str
    boiler: bool
    articles: tuple[int, ...]
    block: str
    link: bool
    figure: bool


def scan(html: str) -> Page:
    """Blocks and media of a page in page order. White space within a block is one space; references are decoded.

    One pass in time linear in the page: each open element knows its surroundings, and the last place of each tag is kept.
    As in browsers, a tag that doesn't end swallows the rest of the page.
    """
    page = Page()
    outside = _Open("", False, (), "", False, False)
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of each open tag
    scopes: list[int] = []
    parts: list[str] = []
    linked = 0
    figure: list[int] = []  # media of the open figure
    marks = 0

    def top() -> _Open:
        return stack[-1] if stack else outside

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                held = top()
                page.blocks.append(Block(text, held.block, held.boiler, held.articles, min(linked, len(text))))
                if held.block == "figcaption":
                    for k in figure:
                        page.media[k].caption = text
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        gone = stack[k:]
        if any(x.tag in BLOCK for x in gone) or (gone and gone[-1].boiler != (k > 0 and stack[k - 1].boiler)):
            flush()
        if any(x.tag == "figure" for x in gone):
            figure.clear()
        for x in reversed(gone):
            places[x.tag].pop()
            if x.tag in _SCOPE:
                scopes.pop()
        del stack[k:]

    def last(tag: str) -> int:
        held = places.get(tag)
        return held[-1] if held else -1

    def say(text: str) -> None:
        nonlocal linked
        parts.append(decoded := unescape(text))
        if top().link:
            linked += len(decoded.strip())

    at = 0
    while at < len(html):
        begin = html.find("<", at)
        if begin != at:
            say(html[at:] if begin < 0 else html[at:begin])
        if begin < 0:
            break
        sign = html[begin + 1 : begin + 2]
        if sign in ("!", "?"):
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if html.startswith(opening, begin):
                    end = html.find(closing, begin + len(opening))
                    at = len(html) if end < 0 else end + len(closing)
                    break
            continue
        name = _NAME.match(html, begin + (2 if sign == "/" else 1))
        if name is None:
            say("<")
            at = begin + 1
            continue
        tag = name[0].lower()
        found, at = attributes(html, name.end())
        if at < 0:
            break
        if sign == "/":
            k = last(tag)
            if k >= 0 and (tag in _SCOPE or not scopes or scopes[-1] < k):
                pop_to(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            k = max(last("p"), *(last(x) for x in _CLOSES.get(tag, ("p",))))
            if k >= 0 and (not scopes or scopes[-1] <= k):
                pop_to(k)
            flush()
        if tag == "br":
            parts.append("\n")
        elif tag == "img" or (tag in ("video", "audio", "source", "embed") and "src" in found):
            flush()
            figure.append(len(page.media))
            page.media.append(Media(found.get("src", ""), found.get("data-digest", ""), found.get("alt", ""), len(page.blocks)))
            if not top().figure:
                figure.clear()
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)  # head's title, scripts and styles are never page text
            continue
        held = top()
        # a header outside the article is the site's; inside it, it holds the title
        boiler = held.boiler or _is_boiler(tag, found) or (tag == "header" and not held.articles)
        if boiler != held.boiler:
            flush()  # an inline advert parts the text around it
        articles = held.articles
        if tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody":
            articles, marks = (*articles[:MARKS], marks), marks + 1
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(_Open(tag, boiler, articles, tag if tag in BLOCK else held.block, held.link or tag == "a", held.figure or tag == "figure"))
    flush()
    return page
