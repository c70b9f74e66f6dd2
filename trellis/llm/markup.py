"""Containers of a web page: a small reader of HTML for the tasks of ``extraction``.

A page is read once, in time linear in its length however broken it is: tags that are never closed end
with the page, end tags without a start are skipped, and paragraphs, list items and cells end where the
next one begins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe noembed noframes svg canvas object audio video map select option datalist button textarea input head title dialog".split())
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre "
    "search section summary table caption colgroup thead tbody tfoot tr td th ul".split())
CONTAINERS = frozenset("html body main article section div td center blockquote details figure table tbody tr form dl ul ol".split())
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 dd figcaption".split())
#: Elements, roles and words of classes and ids that name what is not the article.
ASIDE_TAGS = frozenset("nav footer aside menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus respond replies "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager skip skiplink".split())
MAYBE_WORDS = frozenset("header masthead banner notice notices alert announcement warning message widget tags toolbar search form meta byline aside teaser promotion outbrain taboola".split())
MAIN_WORDS = frozenset("article content post entry story main body text page".split())
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies ad ads advert advertisement sponsor sponsored promo related teaser".split())

_TOKEN = re.compile(
    # A comment; any other declaration; a tag, whose quotes count after an equals sign alone.  Each alternative that begins also ends.
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="']++)\s*+(?:=\s*+(?:"([^"]*+)|'([^']*+)|([^\s>"'][^\s>]*+)))?+""")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NUMBER = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What the next block-level element or item ends, and where the search for it stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_WALLS = frozenset("html table td th caption button object template".split())


@dataclass
class Element:
    tag: str
    step: str
    parent: int
    #: Why it is no part of an article: 0 not at all, 1 by its words, 2 by its tag or role as a form, 3 by its tag.
    aside: int
    bonus: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, text, letters of it in links) of every run of text between block boundaries, in page order.
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def _step(tag: str, classes: list[str]) -> str:
    """A tag and its classes, sorted, with numbers generalised."""
    return ".".join([tag, *sorted({_NUMBER.sub("#", c.lower()) for c in classes})])


def _aside(tag: str, attributes: dict[str, str], inside_article: bool) -> int:
    if tag in UNSEEN or tag in ASIDE_TAGS or tag == "header" and not inside_article:
        return 3
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return 3
    if tag == "form" or attributes.get("role", "").lower() in ASIDE_ROLES:
        return 2
    if tag in ("html", "body", "main"):
        return 0
    words = {w.lower() for w in _WORD.findall(unescape(attributes.get("class", "") + " " + attributes.get("id", "")))}
    if tag == "article":
        return 1 if words & COMMENT_WORDS else 0
    return 1 if words & ASIDE_WORDS or words & MAYBE_WORDS and not words & MAIN_WORDS else 0


def read(html: str) -> Page:
    """The elements and the blocks of text of a page."""
    page = Page([Element("", "", -1, 0)])
    elements, blocks = page.elements, page.blocks
    stack: list[int] = [0]
    depth: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
    walls: list[int] = []  # places of those that end tags of others do not cross
    texts: list[str] = []
    linked = links = articles = 0
    outer = [0]  # the open block-level elements
    block = 0

    def flush() -> None:
        nonlocal texts, linked
        if texts:
            text = " ".join(unescape("".join(texts)).split())
            if text:
                blocks.append((block, text, linked))
            texts, linked = [], 0

    def pop_to(place: int) -> None:
        nonlocal links, articles, block
        while len(stack) > place:
            gone = elements[stack.pop()]
            depth[gone.tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            links -= gone.tag == "a"
            articles -= gone.tag in ("article", "main")
            if gone.tag in BLOCKS:
                flush()
                outer.pop()
                block = outer[-1]

    at = 0
    for start, stop, close, tag, rest in _tokens(html):
        if start > at:
            piece = html[at:start]
            if elements[stack[-1]].tag not in UNSEEN:
                texts.append(piece)
                if links:
                    linked += len(piece.strip())
        at = stop
        if not tag:
            continue
        if close:
            open_ = depth.get(tag)
            if open_ and not (walls and walls[-1] > open_[-1] and tag not in ("table", "html", "body")):
                pop_to(open_[-1])
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            paragraph = depth.get("p")
            if paragraph and not (walls and walls[-1] > paragraph[-1]):
                pop_to(paragraph[-1])
        if tag in _ENDS:
            ended, stops = _ENDS[tag]
            least = max((depth[s][-1] for s in stops if depth.get(s)), default=-1)
            found = [depth[e][0 if depth[e][0] > least else -1] for e in ended if depth.get(e) and depth[e][-1] > least]
            if found:
                pop_to(min(found))
        if tag == "br" or tag == "hr":
            texts.append(" ")
        if tag in VOID:
            continue
        attributes = _attributes(rest) if rest.strip(" /\n\t\r\f") else {}
        parent = stack[-1]
        up = elements[parent].aside
        aside = max(up, _aside(tag, attributes, articles > 0))
        classes = unescape(attributes.get("class", "")).split()
        bonus = tag in ("article", "main") or bool({w.lower() for w in _WORD.findall(" ".join(classes) + " " + attributes.get("id", ""))} & MAIN_WORDS) and tag not in ("html", "body")
        elements.append(Element(tag, _step(tag, classes), parent, aside, bonus))
        depth.setdefault(tag, []).append(len(stack))
        if tag in _WALLS:
            walls.append(len(stack))
        stack.append(len(elements) - 1)
        links += tag == "a"
        articles += tag in ("article", "main")
        if tag in BLOCKS:
            block = len(elements) - 1
            outer.append(block)
    if at < len(html) and elements[stack[-1]].tag not in UNSEEN:
        texts.append(html[at:])
    flush()
    return page


def _tokens(html: str):
    """(start, stop, close, tag, attributes) of every tag, and of what is skipped, with an empty tag."""
    at = 0
    while (found := _TOKEN.search(html, at)) is not None:
        tag = (found[2] or "").lower()
        at = found.end()
        yield found.start(), at, bool(found[1]), tag, found[3] or ""
        if tag in _CLOSE and not found[1]:
            end = _CLOSE[tag].search(html, at)
            stop = end.start() if end else len(html)
            yield stop if tag == "xmp" else at, stop, False, "", ""  # its content is no markup
            at = stop


def scores(page: Page, level: int) -> list[float]:
    """How much prose each element holds, against what surrounds articles.

    ``level`` is the least reason of ``Element.aside`` that counts.
    """
    out = [0.0] * len(page.elements)
    for at, text, linked in page.blocks:
        element = page.elements[at]
        if element.aside >= level:
            out[at] -= min(len(text), 100) / 4
        elif element.tag in PROSE:
            out[at] += max(len(text) - 2 * linked, -len(text))
        else:
            out[at] += len(text) / 2 - 2 * linked
    for at in range(len(page.elements) - 1, 0, -1):
        out[page.elements[at].parent] += out[at]
    return [s * 1.25 if e.bonus and s > 0 else s for s, e in zip(out, page.elements, strict=True)]


#: A container gives way to one inside that holds this part of its score, unless its name says what it is.
MOST = 0.8
_INNER = frozenset("main article section div td center".split())


def best(page: Page) -> tuple[int, float]:
    """The container with the highest score, the innermost of equals, and its score; the whole page (0) where none has any.

    What surrounds an article often has no telling names, so nameless containers give way to one of their inner ones that holds nearly all.
    """
    for level in (1, 2, 3):  # a page that is nothing but what is left out is judged by fewer rules
        values = scores(page, level)
        fit = [i for i, e in enumerate(page.elements) if (not i or e.tag in CONTAINERS) and e.aside < level and values[i] > 0]
        if not fit:
            continue
        at = max(fit, key=lambda i: (values[i], i))
        end = list(range(1, len(page.elements) + 1))  # what is inside an element comes after it, up to here
        for i in range(len(page.elements) - 1, 0, -1):
            end[page.elements[i].parent] = max(end[page.elements[i].parent], end[i])
        i = at
        while (i := i + 1) < end[at] and not page.elements[at].bonus:
            e = page.elements[i]
            if e.tag in _INNER and e.aside < level and values[i] >= MOST * values[at]:
                at = i
        return at, values[at]
    return 0, 0.0


def path(page: Page, at: int) -> str:
    """The steps from the top to an element, by spaces, which no step holds."""
    steps = []
    while at > 0:
        steps.append(page.elements[at].step)
        at = page.elements[at].parent
    return " ".join(reversed(steps))


def matching(page: Page, paths: list[str]) -> list[list[int]]:
    """The elements at each of ``paths``; a prefix tree is walked along with the page."""
    tree: dict = {}
    for k, p in enumerate(paths):
        node = tree
        for step in p.split(" "):
            node = node.setdefault(step, {})
        node[None] = k
    nodes: list[dict | None] = [tree]
    found: list[list[int]] = [[] for _ in paths]
    for i, e in enumerate(page.elements[1:], 1):
        up = nodes[e.parent]
        node = None if up is None else up.get(e.step)
        nodes.append(node)
        if node is not None and None in node:
            found[node[None]].append(i)
    return found


def text_of(page: Page, roots: list[int]) -> str:
    """The blocks under any of ``roots`` in page order, but for what is no part of an article."""
    under = [False] * len(page.elements)
    for r in roots:
        under[r] = True
    for i, e in enumerate(page.elements[1:], 1):
        under[i] = under[i] or under[e.parent]
    for level in (1, 2, 3):
        kept = [text for at, text, _ in page.blocks if under[at] and page.elements[at].aside < level]
        if kept:
            return "\n\n".join(kept)
    return ""
