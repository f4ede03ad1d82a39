"""Main text of web pages by composite text density.

A tolerant reader makes a tree of each page in one pass. Elements that are never article text (by tag, role or being
hidden) are left out. For every other node, with C characters, T tags, L characters and M tags in links below it, the
density is the composite text density of Sun, Song and Liao (2011):

    C / T * log(C / L * T / M) / log(ln(C / (C - L) * L + Lb / Cb * C + e))

(b: the body; zeros count as 1). Class and id names that tell of menus, adverts, comments and the like make a node's
density, and that of all below it, smaller (UNLIKELY); they rule nothing out. The node, not inline, whose children's densities have
the largest sum is the core. The least density on the path from it to the body is the threshold:

- the chosen subtree grows from the core to each ancestor that has another part of at least that density and not much
  less text than the core, and then to the article or main element around the core, beyond which it never goes;
- without such an element it also grows to an ancestor that adds little but the page's h1;
- below the chosen node, parts with unlikely names whose density stays under the threshold are left out, and outside
  article and main so are lists of links under it. Everything else of the chosen subtree is kept.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_VALUE = re.compile(r"[^>=]*(=\s*)?")
_BARE_VALUE = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr output picture q rb rp rt ruby s samp small source span strike strong sub sup time "
    "tt u var wbr script style template noscript svg math object canvas select textarea button map area embed iframe "
    "mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation g path text tspan".split()
)
#: Elements of which none holds article text.
OUTSIDE = frozenset("head nav footer aside form button input dialog menu".split()) | RAW
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words within class and id names of menus, headers, footers, sidebars, notices, adverts and reader comments.
_UNLIKELY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus "
    "recommended recommendations login signup signin toolbar widget pagination pager hidden teaser".split()
)
#: Whole names of the same that are made of words which articles have in names of their own.
_UNLIKELY_NAMES = frozenset(
    "side side-bar side-nav side-menu menu main-menu menu-main site-menu menu-item search search-form search-box search-bar site-search discussion discussions notice notices notice-bar "
    "site-notice alert alerts alert-bar tags tag-list tags-list post-tags entry-tags share sharing share-buttons share-links share-bar social social-share social-links social-buttons "
    "social-icons social-media-links related related-posts related-articles related-content related-links related-stories replies reply reply-form".split()
)
_HEADER_WORDS = frozenset("header head topnav".split())
#: What an unlikely name leaves of a density.
UNLIKELY = 0.02
#: Articles beside the chosen one belong to the text from this share of its characters.
EQUAL = 0.5
#: A part counts as text of its own from this share of the core's characters.
PART = 0.1
#: Elements whose class and id say what the article tells.
_TELLING_TAGS = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
_HEAD_TAGS = frozenset("base link meta title script style noscript template head html body".split())
_CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = ("table", "td", "th", "caption", "button")
_LISTS, _TABLE = ("ul", "ol", "menu"), ("table",)
#: A start tag closes the innermost of these that is open, unless one of the second kind is open further in.
_CLOSES = {"li": (("li",), _LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), _TABLE), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_STOPS = {"table": (), "li": (*_LISTS, *_SCOPE), "td": _TABLE, "th": _TABLE, "tr": _TABLE, "tbody": _TABLE, "thead": _TABLE, "tfoot": _TABLE, "caption": _TABLE, "button": ()}


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*>?", re.IGNORECASE)


class Page:
    """A page's nodes in page order: tag, parent, and the range of its events. Events are texts, None for a break.

    Every character is looked at a bounded number of times: what is not found once isn't looked for again, and the open
    elements are known by tag, so a closing tag costs the same however many are open.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#page"], [-1], [""]
        self.begin, self.end = [0], [0]
        self.events: list[str | None] = []
        self.owner: list[int] = []
        self._source = source
        self._gone: dict[str, int] = {}
        self._stack = [0]
        self._open: dict[str, list[int]] = {}  # depths of the open elements by tag
        self._blocks = [0]  # depths of the open elements that aren't inline
        self._read()

    def _find(self, what: str, at: int) -> int:
        if at >= self._gone.get(what, at + 1):
            return -1
        found = self._source.find(what, at)
        if found < 0:
            self._gone[what] = at
        return found

    def _after(self, what: str, at: int) -> int:
        found = self._find(what, at)
        return len(self._source) if found < 0 else found + len(what)

    def _text(self, text: str) -> None:
        if text:
            if self.tags[self._stack[-1]] == "head" and not text.isspace():
                self._close(len(self._stack) - 1)
            self.events.append(html.unescape(text) if "&" in text else text)
            self.owner.append(self._stack[-1])

    def _break(self) -> None:
        self.events.append(None)
        self.owner.append(self._stack[-1])

    def _close(self, depth: int) -> None:
        while len(self._stack) > depth:
            node = self._stack.pop()
            self.end[node] = len(self.events)
            self._open[self.tags[node]].pop()
            if self._blocks[-1] == len(self._stack):
                self._blocks.pop()
                self._break()

    def _innermost(self, names: tuple[str, ...], stops: tuple[str, ...]) -> int:
        depth = max((self._open[x][-1] for x in names if self._open.get(x)), default=0)
        return depth if all(not self._open.get(x) or self._open[x][-1] <= depth for x in stops) else 0

    def _tag_end(self, at: int) -> int:
        """The place after a tag's >, which quotes hide only as parts of values. A quote that never ends hides nothing."""
        source, size = self._source, len(self._source)
        while True:
            found = _TO_VALUE.match(source, at)
            at = found.end()
            if at >= size:
                return size
            if source[at] == ">":
                return at + 1
            if source[at] in "\"'":
                stop = self._find(source[at], at + 1)
                if stop < 0:
                    return self._after(">", at)
                at = stop + 1
            else:
                at = _BARE_VALUE.match(source, at).end()

    def _read(self) -> None:
        source, at, size = self._source, 0, len(self._source)
        while at < size:
            start = source.find("<", at)
            if start < 0:
                self._text(source[at:])
                break
            closing = source.startswith("/", start + 1)
            name = _NAME.match(source, start + 1 + closing)
            if name:
                self._text(source[at:start])
                stop = self._tag_end(name.end())
                if closing:
                    self._end_tag(name[0].lower())
                    at = stop
                else:
                    at = self._start_tag(name[0].lower(), source[name.end() : stop].rstrip(">"), stop)
            elif source.startswith("<!--", start):
                self._text(source[at:start])
                short = next((x for x in (">", "->") if source.startswith(x, start + 4)), None)
                at = start + 4 + len(short) if short else self._after("-->", start + 4)
            elif source[start + 1 : start + 2] in ("!", "?") or closing:
                self._text(source[at:start])
                at = self._after(">", start + 2)
            else:
                self._text(source[at : start + 1])
                at = start + 1
        self._close(1)
        self.end[0] = len(self.events)

    def _end_tag(self, name: str) -> None:
        if name in ("html", "body"):  # what follows still belongs to the body
            return
        depth = self._innermost((name,), _STOPS.get(name, _SCOPE))
        if depth and name in INLINE and name != "a" and self._blocks[-1] > depth:
            return
        if depth:
            self._close(depth)
        elif name in ("p", "br"):
            self._break()

    def _start_tag(self, name: str, attributes: str, at: int) -> int:
        if name in ("html", "body") and self._open.get(name):
            return at
        if name not in _HEAD_TAGS and self._open.get("head"):
            self._close(self._open["head"][-1])
        if name in _CLOSES_P and (depth := self._innermost(("p",), _SCOPE)):
            self._close(depth)
        elif name in _CLOSES and (depth := self._innermost(*_CLOSES[name])):
            self._close(depth)
        elif name == "a" and (depth := self._innermost(("a",), ())) and self._blocks[-1] < depth:
            self._close(depth)
        if name not in INLINE:
            self._break()
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(self._stack[-1])
        self.attributes.append(attributes)
        self.begin.append(len(self.events))
        self.end.append(len(self.events))
        if name in RAW and not attributes.rstrip().endswith("/"):
            stop = _raw_end(name).search(self._source, at)
            return stop.end() if stop else len(self._source)
        if name not in VOID and name not in RAW:
            depth = len(self._stack)
            self._stack.append(node)
            self._open.setdefault(name, []).append(depth)
            if name not in INLINE:
                self._blocks.append(depth)
        return at


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(raw)}


def _is_outside(tag: str, found: dict[str, str], in_article: bool, has_heading: bool, is_wrapper: bool) -> bool:
    if tag in OUTSIDE and not is_wrapper:
        return True
    if tag == "header" and not (in_article and has_heading):
        return True
    if tag in ("html", "body"):
        return False
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    return tag not in _TELLING_TAGS and not is_wrapper and found.get("role", "").lower() in _OUTSIDE_ROLES


def _is_unlikely(tag: str, found: dict[str, str], has_heading: bool) -> bool:
    names = set(re.sub(r"_+", "-", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{found.get('class', '')} {found.get('id', '')}").lower()).split())
    words = {w for name in names for w in name.split("-")}
    if words & _UNLIKELY_WORDS:
        return True
    # Sections, also those made of div, are named after their headings.
    if names & _UNLIKELY_NAMES and tag != "section" and "section" not in names:
        return True
    return bool(words & _HEADER_WORDS) and not has_heading


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """The composite text density; 0 without characters, and where links leave nothing."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_share * chars + math.e)
    value = chars / max(1, link_chars) * tags / max(1, link_tags)
    return chars / tags * math.log(max(value, 1.0)) / math.log(max(base, 1.0001)) if base > 1.0001 else chars / tags * math.log(max(value, 1.0)) / 1e-4


class Densities:
    """What the choice looks at, for each node of a page; sums are over a node and all below it that is not outside."""

    def __init__(self, page: Page):
        tags, parents = page.tags, page.parents
        n = len(tags)
        found = [_attributes(x) if x and not x.isspace() else {} for x in page.attributes]
        heading, told = [tag in ("h1", "h2") for tag in tags], [tag in ("article", "main") for tag in tags]
        held = [0] * n
        for text, node in zip(page.events, page.owner, strict=True):
            if text:
                held[node] += len("".join(text.split()))
        below = held[:]
        for node in range(n - 1, 0, -1):
            up = parents[node]
            heading[up] |= heading[node]
            told[up] |= told[node]
            below[up] += below[node]
        self.out, self.likely, self.unlikely = [False] * n, [1.0] * n, [False] * n
        self.aside = [False] * n  # articles within or beside another that are named as comments, adverts and the like
        in_article, link = [False] * n, [False] * n
        for node in range(1, n):
            up, tag = parents[node], tags[node]
            in_article[node] = in_article[up] or tag in ("article", "main")
            link[node] = link[up] or tag == "a"
            # Forms around the article or most of the text are no forms to fill in, but a page's layout.
            wrapper = tag == "form" and (told[node] or 2 * below[node] > below[0])
            self.out[node] = self.out[up] or _is_outside(tag, found[node], in_article[node], heading[node], wrapper)
            self.unlikely[node] = tag not in _TELLING_TAGS and not wrapper and bool(found[node]) and _is_unlikely(tag, found[node], heading[node])
            self.aside[node] = tag == "article" and bool(found[node]) and _is_unlikely(tag, found[node], heading[node])
            self.likely[node] = self.likely[up] * (UNLIKELY if self.unlikely[node] else 1.0)
        self.chars = [0 if self.out[k] else held[k] for k in range(n)]
        self.link_chars = [held[k] if link[k] and not self.out[k] else 0 for k in range(n)]
        self.count, self.link_count = [1] * n, [int(tag == "a") for tag in tags]
        for node in range(n - 1, 0, -1):
            if not self.out[node]:
                up = parents[node]
                self.chars[up] += self.chars[node]
                self.link_chars[up] += self.link_chars[node]
                self.count[up] += self.count[node]
                self.link_count[up] += self.link_count[node]
        self.body = next((k for k in range(n) if tags[k] == "body" and self.chars[k]), 0)
        share = self.link_chars[self.body] / max(1, self.chars[self.body])
        self.density = [0.0 if self.out[k] else self.likely[k] * density(self.chars[k], self.count[k], self.link_chars[k], self.link_count[k] - (tags[k] == "a"), share) for k in range(n)]
        self.total = [0.0] * n
        for node in range(1, n):
            self.total[parents[node]] += self.density[node]


def core_and_threshold(page: Page, of: Densities) -> tuple[list[int], float]:
    """The path from the core (no inline element) to the body, and the least density on it."""
    inside = [k for k in range(len(page.tags)) if not of.out[k] and page.tags[k] not in INLINE and page.begin[of.body] <= page.begin[k] and page.end[k] <= page.end[of.body] and k >= of.body]
    path = [max(inside, key=lambda k: (of.total[k], -k))]
    while path[-1] not in (of.body, 0):
        path.append(page.parents[path[-1]])
    return path, min(of.density[k] for k in path)


def chosen_subtree(page: Page, of: Densities, path: list[int], least: float) -> tuple[int, bool]:
    """The node whose subtree is the article, and whether an article or main element says so."""
    tags, parents, core = page.tags, page.parents, path[0]
    around = [k for k in path if tags[k] == "article"] or [k for k in path if tags[k] == "main"]
    if around:
        return _with_equals(page, of, path, around[0], least), True
    n, on_path = len(tags), set(path)
    text = [not of.out[k] and k not in on_path and of.density[k] >= least and of.chars[k] >= PART * of.chars[core] for k in range(n)]
    title = [of.chars[k] if tags[k] == "h1" and of.likely[k] == of.likely[core] else 0 for k in range(n)]  # characters in titles
    for k in range(n - 1, 0, -1):
        title[parents[k]] += title[k]
    chosen = core
    grows = {parents[k] for k in range(1, n) if text[k] and parents[k] in on_path}
    for k in range(n - 1, 0, -1):
        if text[k] and parents[k] not in on_path:
            text[parents[k]] = True
        if text[k] and parents[k] in on_path:
            grows.add(parents[k])
    for up in path[1:]:
        if up in grows:
            chosen = up
    for up in path[path.index(chosen) :]:
        if title[chosen]:
            break
        if title[up] and of.chars[up] - title[up] <= 1.2 * of.chars[chosen]:
            chosen = up
    return chosen, False


def _with_equals(page: Page, of: Densities, path: list[int], own: int, least: float) -> int:
    """The article itself, or the part of the path that also has the other articles of the same main element or body.

    Such are as dense as the threshold asks, have EQUAL of the article's characters and no name that makes them unlikely.
    """
    if page.tags[own] != "article":
        return own
    up = path[path.index(own) :]
    border = next((k for k in up if page.tags[k] == "main"), up[-1])
    chosen = own
    for k in range(len(page.tags)):
        inside = page.begin[border] <= page.begin[k] and page.end[k] <= page.end[border]
        apart = page.end[k] <= page.begin[own] or page.begin[k] >= page.end[own]
        if page.tags[k] == "article" and inside and apart and not of.out[k] and not of.aside[k] and of.likely[k] >= of.likely[own] and of.density[k] >= least and of.chars[k] >= EQUAL * of.chars[own]:
            chosen = next(x for x in up[up.index(chosen) :] if page.begin[x] <= page.begin[k] and page.end[k] <= page.end[x])
    return chosen


def main_text(source: str | None) -> str:
    """The article's text; an empty text for null, empty and textless pages."""
    if not source:
        return ""
    page = Page(source)
    of = Densities(page)
    if not of.chars[of.body]:
        return ""
    path, least = core_and_threshold(page, of)
    chosen, told = chosen_subtree(page, of, path, least)
    on_path, out = set(path), of.out[:]
    for k in range(chosen + 1, len(page.tags)):
        if page.begin[k] >= page.end[chosen] and page.parents[k] < chosen:
            break
        links = not told and page.tags[k] not in INLINE and of.link_count[k] >= 3 and of.link_chars[k] >= 0.8 * of.chars[k]
        out[k] = out[k] or k not in on_path and (out[page.parents[k]] or of.aside[k] or (of.unlikely[k] or links) and of.density[k] < least)
    some = slice(page.begin[chosen], page.end[chosen])
    parts = [" " if text is None else text for text, node in zip(page.events[some], page.owner[some], strict=True) if not out[node]]
    return " ".join("".join(parts).split())


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html); other columns are ignored.

    Null and empty pages have an empty text. Rows are read one by one, so repeated rows give repeated results. Reading
    takes time in proportion to a page's length, whatever it holds.
    """
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
