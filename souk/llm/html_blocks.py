"""Flat text blocks of an HTML page with the statistics that classify them.

``blocks(html)`` walks the markup once and returns the page's text blocks in
order.  A block is the text between two block-level tags; inline tags and
``<br>`` do not end it.  Raw-text and invisible elements (scripts, styles,
forms' controls, templates, hidden elements, the head) hold no text.
``features(blocks)`` adds the neighbours' word counts and link densities.
"""

from __future__ import annotations

import html as _html
import re

#: Element classes of HTML and the names sites give to page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select option button svg math title object canvas video audio "
                "map datalist noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var br wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_ITSELF = frozenset("li dt dd tr td th option".split())
FURNITURE = frozenset("nav header footer aside form dialog menu fieldset address".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
                            "status tablist note".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu topbar breadcrumb breadcrumbs header masthead footer sidebar side rail widget widgets ad ads adv advert "
    "adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "warning newsletter subscribe subscription signup login popup modal overlay comment comments commentlist discussion reply "
    "replies respond disqus share sharing social related recommended recommendations teaser copyright legal disclaimer toolbar "
    "pagination pager search skip announcement poll survey feedback reviews".split())
CONTENT_WORDS = frozenset("article content main post entry story body text maincontent articlebody postbody".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("text", "words", "link_words", "main", "furniture", "heading", "item", "depth")

    def __init__(self, text, words, link_words, main, furniture, heading, item):
        self.text, self.words, self.link_words = text, words, link_words
        self.main, self.furniture, self.heading, self.item = main, furniture, heading, item


def _kind(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """(main content, page furniture, hidden) as an element's tag and attributes say."""
    main, furniture, hidden = tag in ("article", "main"), tag in FURNITURE, False
    if attrs.strip(" /"):
        for m in _ATTR.finditer(attrs):
            name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if name in ("class", "id"):
                words = {w.lower() for w in _WORDS.findall(value)}
                if words & FURNITURE_WORDS:
                    furniture = True
                elif words & CONTENT_WORDS:
                    main = True
            elif name == "role":
                furniture |= value.lower() in FURNITURE_ROLES
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return main, furniture, hidden


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    text: list[str] = []  # pieces of the open block
    link: list[str] = []  # those of them inside a link
    stack: list[tuple] = []  # open block-level elements: (tag, main, furniture, hidden)
    in_link, n, pos = False, len(page), 0

    def close():
        nonlocal text, link
        if text:
            words = _html.unescape("".join(text)).split()
            if words:
                top = stack[-1] if stack else ("", False, False, False)
                tags = [s[0] for s in stack]
                out.append(Block(" ".join(words), len(words), len(_html.unescape(" ".join(link)).split()), top[1], top[2],
                                 any(t in HEADINGS for t in tags), "li" in tags))
            text, link = [], []

    while pos < n:
        m = _TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos and not (stack and stack[-1][3]):
            piece = page[pos:end]
            text.append(piece)
            if in_link:
                link.append(piece)
        if m is None:
            break
        pos = m.end()
        if not m.group(2):
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in RAW:
            if not closing and not m.group(3).rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, pos)
                pos = stop.end()
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in INLINE:
            hidden = not closing and m.group(3).strip() and _kind(tag, m.group(3))[2]
            if hidden:  # an inline element that is not shown: up to its end tag
                stop = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, pos)
                pos = stop.end()
        elif closing:
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    in_link = False
                    break
        else:
            close()
            # end tags left out: a block ends an open paragraph, an item the item before it
            while stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ENDS_ITSELF)):
                stack.pop()
            if tag in VOID or m.group(3).rstrip().endswith("/"):
                continue
            up = stack[-1] if stack else ("", False, False, False)
            main, furniture, hidden = _kind(tag, m.group(3))
            stack.append((tag, (up[1] or main), (up[2] or furniture), up[3] or hidden or tag == "head"))
            if tag in ("html", "body"):  # classes of the whole page say nothing of its parts
                stack[:] = [s for s in stack[:-1] if s[0] != "head"]
                stack.append((tag, False, False, hidden))
    close()
    return out


NAMES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_main", "in_furniture",
         "heading", "item", "page_has_main")


def features(bs: list[Block]) -> list[tuple]:
    """One row per block, in the order of ``NAMES``; beyond the ends: 0 words, density 0."""
    dens = [min(1.0, b.link_words / b.words) for b in bs]
    has_main = float(any(b.main and not b.furniture for b in bs))
    out = []
    for i, b in enumerate(bs):
        p, q = i - 1, i + 1
        out.append((float(b.words), dens[i], float(bs[p].words) if p >= 0 else 0.0, dens[p] if p >= 0 else 0.0,
                    float(bs[q].words) if q < len(bs) else 0.0, dens[q] if q < len(bs) else 0.0, float(b.main),
                    float(b.furniture), float(b.heading), float(b.item), has_main))
    return out
