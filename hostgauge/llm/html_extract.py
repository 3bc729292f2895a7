"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into text blocks. A classifier gives each block two costs, that of
calling it content and that of calling it boilerplate; they become the capacities
of its edges to the two terminals. Blocks next to each other, and blocks of one
parent element, are tied by smoothness edges. The cheapest labelling is a minimum
cut, found by max-flow, so a short paragraph goes with its neighbours and a long
advert does not drag the article along.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hostgauge.llm.common import map_texts

# Fixed values of HTML: elements that never hold text of the page, that have no end
# tag, and that stand inside a line of text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas",
       "audio", "video", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
          "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

# What the classifier looks at, with its costs. Names that authors choose weigh less than what an element is; neither can
# carry a block against a container of content and the block's own text, nor against neighbours that all say otherwise.
HIDDEN, TAG, NAME, PART, WEAK = 12.0, 8.0, 7.0, 6.0, 1.0
LINKS = 3.2  # of a block that is all link
PHRASE = 3.0
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form",
                "menu", "menubar", "toolbar"}
BOILER_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb",
    "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus",
    "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promoted", "promotion",
    "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signin", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toc", "toolbar", "topbar", "trending",
    "widget", "widgets",
}
# words that turn the name of a part of the page into a property of what has the name: "has-sidebar", "comments-open"
PROPERTIES = {"has", "with", "without", "no", "is", "are", "open", "closed", "enabled", "disabled", "on", "off", "left", "right",
              "active", "visible", "supports", "layout", "template", "page", "format", "type", "category", "tag", "hentry", "status"}
# how notices and footers speak, in any element
_PHRASES = re.compile(
    r"\u00a9|\(c\) ?\d{4}|copyright|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|subscribe|newsletter"
    r"|sign (?:in|up)|log ?in\b|share (?:this|on)|follow us|read more|advertisement|sponsored|related (?:posts|articles)", re.I,
)
CONTENT_TAGS = {"article", "main"}
CONTENT_NAMES = {"article", "body", "content", "entry", "main", "post", "story", "text"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "figcaption", "td"}
NEXT_TO, SAME_PARENT = 1.2, 0.7  # smoothness; the former is divided by the distance of the blocks in the tree
CONTAINER = 4.0  # of a container of content

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SENTENCE = re.compile(r"[.!?\u2026]['\"\u00bb\u201d)]?$")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple  # numbers of the open block elements
    boiler: float  # cost of calling it content, from the elements around it
    content: float  # cost of calling it boilerplate, likewise
    linked: int  # characters inside links
    tag: str


def _named(value: str) -> float:
    """How much the names of an element (its class or id) speak for boilerplate: a whole name more than a part of one, and
    parts next to a word that makes them a property not at all."""
    most = 0.0
    for name in value.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if name.lower() in BOILER_NAMES:
            most = max(most, NAME)
        elif not PROPERTIES & set(parts) and not CONTENT_NAMES & set(parts) and BOILER_NAMES & set(parts):
            most = max(most, PART)
        elif CONTENT_NAMES & set(parts) and parts and parts[-1] in BOILER_NAMES and not PROPERTIES & set(parts):
            most = max(most, PART)  # "post-comments", "article-footer"
    return most


def _marks(tag: str, attributes: str, inside_content: bool) -> tuple[float, float, float]:
    """(boilerplate evidence, content evidence, of the former what cannot be outweighed: hidden) of one element."""
    boiler = TAG if tag in BOILER_TAGS or tag == "header" and not inside_content else 0.0
    content, hidden = CONTAINER if tag in CONTENT_TAGS else 0.0, 0.0
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = HIDDEN
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = HIDDEN
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    boiler = max(boiler, TAG)
                elif value.lower() in ("main", "article"):
                    content = max(content, CONTAINER)
            elif name in ("class", "id") and tag not in ("body", "html"):
                found = _named(value)
                # a bare "header" inside the article is the article's own
                if found and inside_content and tag in TEXT_TAGS | {"header"}:
                    if {p.lower() for p in _NAME_PARTS.findall(value)} & BOILER_NAMES <= {"header"}:
                        found = 0.0
                boiler = max(boiler, found)
                if not found and {p.lower() for p in _NAME_PARTS.findall(value)} & CONTENT_NAMES:
                    content = max(content, CONTAINER)
    return max(boiler, hidden), content, hidden


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with character references decoded and white space made single."""
    out: list[Block] = []
    # open elements: tag, number, boiler, content, is content, is block
    stack: list[tuple[str, int, float, float, bool, bool]] = [("", 0, 0.0, 0.0, False, True)]
    numbers, parts, linked, links = 0, [], 0, 0

    def close_block() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            inner = next(e for e in reversed(stack) if e[5])
            top = stack[-1]
            out.append(Block(text, tuple(e[1] for e in stack if e[5]), top[2], top[3], linked, inner[0]))
        parts, linked = [], 0

    def pop_to(at: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[at:])
        del stack[at:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                end = at - 3 if page.endswith("]]>", m.start() + 9, at) else at
                say(page[m.start() + 9 : end].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                close_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and stack[i][5]:
                    break  # an inline end tag reaches no further than its block
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        block = tag not in INLINE
        if block:
            close_block()
        if tag in VOID:
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else set())
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    pop_to(i)
                    if tag not in ("tr",):
                        break
                elif stack[i][5] and stack[i][0] not in ("td", "th", "tr", "p") or stack[i][0] in ("table", "ul", "ol", "dl"):
                    break
        top = stack[-1]
        boiler, content, hidden = _marks(tag, attributes, top[4]) if attributes or block else (0.0, 0.0, 0.0)
        numbers += 1
        # the innermost evidence counts: a part of the page inside a container of content is no content of it, while an
        # element that says it is the content keeps that against names around it, but not against what is around it
        if boiler and not (content and boiler < TAG):
            held = (max(top[2], boiler), 0.0)
        elif content and not boiler:
            held = (top[2] if top[2] >= TAG else top[2] / 2, max(top[3], content))
        else:
            held = (max(top[2], boiler), max(top[3], content))
        stack.append((tag, numbers, *held, top[4] or content > 0, block))
        if tag == "a":
            links += 1
    close_block()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content)."""
    n = len(b.text)
    content = b.content + min(2.0, n / 100) + (WEAK if b.tag in TEXT_TAGS else 0.0)
    content += 0.5 * bool(_SENTENCE.search(b.text))
    boiler = b.boiler + (LINKS * b.linked / n if n else 0.0) + (WEAK if b.tag == "li" else 0.0) + 0.2
    if n < 300 and _PHRASES.search(b.text) and not b.content:
        boiler += PHRASE
    return content, boiler


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (the smallest such side).

    ``source[i]`` and ``sink[i]`` are the capacities of node i's terminal edges;
    ``edges`` hold (i, j, capacity both ways). Blocking flows: each round numbers the
    nodes by their distance from what is left of the sources, and sends all that fits
    along shortest ways before it starts anew; as costs meet their match a few blocks on, rounds are few.
    """
    n, small = len(source), 1e-9
    # what goes straight through a node is sent at once; what remains is one-sided
    excess = [s - t for s, t in zip(source, sink)]
    head: list[list[int]] = [[] for _ in range(n)]  # numbers of the edges that leave a node; the one back has the last bit turned
    to: list[int] = []
    room: list[float] = []
    for i, j, c in edges:
        head[i].append(len(to))
        head[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
    while True:
        level = [0 if e > small else -1 for e in excess]
        queue, met = deque(i for i in range(n) if not level[i]), False
        while queue:
            i = queue.popleft()
            for e in head[i]:
                j = to[e]
                if room[e] > small and level[j] < 0:
                    level[j] = level[i] + 1
                    met |= excess[j] < -small
                    queue.append(j)
        if not met:
            return [at >= 0 for at in level]
        tried = [0] * n
        for start in range(n):
            while excess[start] > small:
                path, i = [], start
                while excess[i] >= -small or not path:  # down the levels to a node that takes something
                    edge = -1
                    while tried[i] < len(head[i]):
                        e = head[i][tried[i]]
                        if room[e] > small and level[to[e]] == level[i] + 1:
                            edge = e
                            break
                        tried[i] += 1
                    if edge >= 0:
                        path.append(edge)
                        i = to[edge]
                    elif path:  # a dead end: back, and not this way again
                        i = to[path.pop() ^ 1]
                        tried[i] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(excess[start], -excess[i], *(room[e] for e in path))
                excess[start] -= flow
                excess[i] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def _apart(a: tuple, b: tuple) -> int:
    """Steps between two elements of the tree, from the paths to them."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def main_text(page: str | None) -> str:
    """The blocks on the content side, in page order, joined by one space; null or no content: empty."""
    found = blocks(page or "")
    if not found:
        return ""
    cost = [costs(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_TO / max(1, _apart(found[i - 1].path, b.path))))
        for element in b.path[-2:]:  # text of one element, and elements of one parent
            if element in last:
                edges.append((last[element], i, SAME_PARENT))
            last[element] = i
    kept = minimum_cut([c for c, _ in cost], [b for _, b in cost], edges)
    return " ".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) per row; null pages give empty text.

    Every page is read whole and on its own, so repeated rows give equal results
    and nothing is shuffled. Broken markup never fails: open tags end with the page.
    """
    keep = keep or ["page_id", "url"]
    found = map_texts(pages, keep, [page], "text string", lambda p: (main_text(p),))
    return found.select(*keep, "text", F.length("text").cast("bigint").alias("n_chars"))
