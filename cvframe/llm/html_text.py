"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element) and every line weighs
its text length.  Sums over a sliding window of ``WINDOW`` lines rise where
the text begins (surge) and fall to nothing where it ends (dive); the text
between is kept.  What is known of a line only changes its weight:

* lines that are mostly links weigh nothing outside of an article element;
* lines of elements with the names of page furniture (menus, forms, notices)
  weigh a fraction and have windows of their own: such a block stays if it
  surges even so, else it goes and parts no text.  Adverts, readers'
  comments and hidden elements weigh nothing;
* lines in an article or main element weigh ``SURGE`` more, and where there
  are such lines those outside of one weigh a fraction; the windows do not
  reach across the border of an article.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3          # lines per block
SURGE = 80          # weighed characters in a window that start a region
HINTED = 0.2        # weight of a character in furniture by its name, or beside an article
ELEMENT = 0.05      # in a furniture element

RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "button", "object", "math",
       "canvas", "audio", "video", "title", "option"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
AROUND = {"form", "fieldset"}     # these may also hold a whole page
ROOTS = {"html", "body"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody",
          "tfoot", "tr", "caption", "section", "article", "main", "blockquote", "pre", "hr", "figure", "figcaption", "address",
          "header", "footer", "nav", "aside", "form", "menu", "dialog", "fieldset", "details", "summary", "html", "head",
          "body", "center", "hgroup", "search"}
SPACING = {"br", "td", "th", "img", "wbr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
HINTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored",
         "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup",
         "modal", "overlay", "newsletter", "subscribe", "signup", "sidebar", "rail", "menu", "navbar", "nav", "navigation",
         "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "disqus", "respond", "replies", "share",
         "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "toolbar",
         "login", "search", "skip", "contentinfo", "complementary", "form", "dialog"}
READERS = {"comment", "comments", "disqus", "respond", "replies"}
#: Hints of no weight at all; a name made of a hint and parts below is known furniture too.
SURE = READERS | {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsored", "cookie",
                  "cookies", "consent", "gdpr", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "pagination", "pager"}
PARTS = {"", "box", "bar", "block", "button", "buttons", "link", "links", "list", "item", "items", "container", "wrapper", "wrap",
         "inner", "outer", "section", "area", "panel", "unit", "slot", "icon", "icons", "post", "posts", "article", "articles",
         "story", "stories", "top", "bottom", "left", "right", "inline", "media", "site", "page", "main", "header", "thread"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TITLED = HEADINGS | {"section", "hgroup"}     # their ids are often slugs of titles
SITE_HEADERS = {"header", "site", "page", "top", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_HINTED = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Line:
    text: str          # decoded, white space collapsed
    linked: int        # characters inside links
    article: bool      # inside an article or main element
    weight: float = 1.0
    element: int = -1  # the furniture element it is in, by its place on the page


def _weight(name: str, attrs: str, inside: bool) -> float:
    """Weight of an element's lines by its name and attributes."""
    if name in ROOTS:
        return 1.0
    if attrs and _HIDDEN.search(attrs):
        return 0.0
    if name in ("article", "main"):
        words = {w for m in _HINTED.finditer(attrs) for w in _WORDS.findall(_value(m).lower())}
        return 0.0 if words & READERS else 1.0
    known = _known(name, attrs) if attrs else set()
    if known & SURE:
        return 0.0
    if name in FURNITURE or not inside and (name == "header" or "header" in known):
        return ELEMENT
    return HINTED if known - {"header"} else 1.0


def _value(m: re.Match) -> str:
    return m[2] or m[3] or m[4] or ""


def _known(name: str, attrs: str) -> set[str]:
    """Hints an element gives by whole names of known furniture.

    A name (class, role, id or a whole label) counts if it is a hint or a
    hint with PARTS (a site's header: with SITE_HEADERS).  Ids of headings
    and sections are their titles: a heading's never counts, a section's only
    if it names readers' comments."""
    found = set()
    for m in _HINTED.finditer(attrs):
        kind, value = m[1].lower(), _value(m).lower()
        for token in ["-".join(value.split())] if kind == "aria-label" else value.split():
            words = set(re.split(r"[-_\d]+", token))
            if kind == "id" and name in TITLED and (name in HEADINGS or not words <= READERS):
                continue
            if words <= HINTS | PARTS:
                found |= words & HINTS
            if "header" in words and words <= SITE_HEADERS:
                found.add("header")
    return found


def lines_of(page: str, plain: frozenset[int] = frozenset()) -> list[Line]:
    """The page as lines, one per block element, in page order; elements that
    begin at a place in ``plain`` are no furniture."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    skip, depth = "", 0          # the furniture element that is open, and how many of its name
    weight, element = 1.0, -1    # its weight and place
    within, below = "", 0        # an element of less weight in it, and how many of its name
    inner, place = 1.0, -1       # that one's weight and place
    inside = 0                   # open article and main elements
    link, linked_any = 0, False  # in a link; it has had text
    blocks: list[str] = []       # blocks opened inside the link
    pos, n = 0, len(page)

    def end_line():
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, linked, inside > 0, inner if within else weight, place if within else element))
            parts.clear()
        linked = 0

    while pos < n:
        m = _TOKEN.search(page, pos)
        text = page[pos:m.start() if m else n]
        if text:
            parts.append(text)
            if link:
                linked += len(text)
                linked_any = linked_any or not text.isspace()
        if not m:
            break
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                pos = end.end() if end else n
                parts.append(" ")
            continue
        if name == "a":
            link, linked_any = int(not closing and bool(_HREF.search(attrs))), False
            blocks.clear()
        if name in SPACING:
            parts.append(" ")
        if name in BLOCKS:
            end_line()
            if link:             # a link ends with the block it began in, and before a further block
                if closing and name in blocks:
                    while blocks.pop() != name:
                        pass
                elif closing or linked_any and not blocks:
                    link = 0
                elif name not in VOID:
                    blocks.append(name)
        if name in VOID:
            continue
        own = 1.0 if closing or attrs.endswith("/") or m.start() in plain else _weight(name, attrs, inside > 0)
        if skip:
            if within:
                if name == within:
                    below += -1 if closing else 1
                    if below <= 0:
                        end_line()
                        within = ""
            elif own < weight:
                end_line()
                within, below, inner, place = name, 1, own, m.start()
            if name == skip:
                depth += -1 if closing else 1
                if depth <= 0:
                    end_line()
                    skip, within, weight, element = "", "", 1.0, -1
            elif name in ("article", "main") and not closing and not inside and own == 1.0:
                end_line()       # an article ends furniture that was never closed
                skip, within, weight, element, inside = "", "", 1.0, -1, 1
            continue
        if own < 1.0:
            end_line()
            skip, depth, weight, element = name, 1, own, m.start()
        elif name in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
    end_line()
    return out


def _around(page: str, lines: list[Line], plain: frozenset[int]) -> frozenset[int]:
    """Elements taken for furniture that hold most of the page's unlinked text
    and no article has text beside them: they are around the page."""
    free: dict[int, int] = {}
    for x in lines:
        if x.weight > 0:
            free[x.element] = free.get(x.element, 0) + max(0, len(x.text) - x.linked)
    total = sum(free.values())
    if any(x.article and x.element < 0 for x in lines):
        return plain
    return plain | {e for e, size in free.items() if e >= 0 and 2 * size > total
                    and (m := _TOKEN.match(page, e)) and ((m["name"] or m["name2"]).lower() in AROUND
                                                         or (m["name"] or m["name2"]).lower() not in FURNITURE | {"header"})}


def regions(weights: np.ndarray, surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges [first, last) between each surge and the dive after it.

    The sum of a window that begins at line i covers i .. i + window - 1.  A
    run of positive sums is a region if its largest sum reaches ``surge``;
    it spans its first to its last line with any weight."""
    if not len(weights):
        return []
    padded = np.concatenate([weights, np.zeros(window - 1)])
    sums = np.convolve(padded, np.ones(window), "valid")
    on = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    steps = np.diff(on)
    found = []
    for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
        if sums[a:b].max() >= surge:
            own = np.flatnonzero(weights[a:b]) + a
            found.append((int(own[0]), int(own[-1]) + 1))
    return found


def _spans(weights: np.ndarray) -> list[tuple[int, int]]:
    """Regions that surge; where none does, those that come half as high as the highest."""
    spans = regions(weights, SURGE)
    if not spans and weights.any():
        spans = regions(weights, np.convolve(weights, np.ones(WINDOW)).max() / 2)
    return spans


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, lines on the page, lines kept) of one page; NULL: empty.

    First the windows of each furniture element say which of its lines stay,
    then the windows over what is left say where the text lies."""
    page = page or ""
    plain: frozenset[int] = frozenset()
    lines = lines_of(page)
    while (more := _around(page, lines, plain)) != plain:
        plain, lines = more, lines_of(page, more)
    of: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.element >= 0:
            of.setdefault(x.element, []).append(i)
    stays = {i for i, x in enumerate(lines) if x.element < 0}
    for rows in of.values():
        own = [lines[i] for i in rows]
        weighed = np.array([x.weight * len(x.text) * (4 * x.linked <= len(x.text)) for x in own])
        for a, b in regions(weighed, SURGE):
            stays.update(rows[a:b])
    left = [x for i, x in enumerate(lines) if i in stays]
    beside = HINTED if any(x.article for x in left) else 1.0
    weights: list[float] = []
    at: list[int] = []
    for i, x in enumerate(left):
        if i and x.article != left[i - 1].article:
            weights += [0.0] * WINDOW            # windows end where an article does
        at.append(len(weights))
        weights.append(len(x.text) + SURGE if x.article else beside * len(x.text) * (2 * x.linked <= len(x.text)))
    keep = np.zeros(len(weights), bool)
    for a, b in _spans(np.array(weights)):
        keep[a:b] = True
    kept = [x.text for x, k in zip(left, at) if keep[k]]
    return "\n".join(kept), len(lines), len(kept)


_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()),
                        T.StructField("n_kept", T.IntegerType())])


@F.pandas_udf(_SCHEMA)
def _extract(pages: pd.Series) -> pd.DataFrame:
    rows = [main_text(p) for p in pages]
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_kept"])


def extract(html_col: Column) -> Column:
    """Column of struct(text, n_lines, n_kept) for a column of whole pages.

    Row by row, so ties, repeated rows, extra columns and empty tables need
    nothing: NULL or empty html, or a page without article text, gives an
    empty text; a page cut off anywhere (inside a tag, a script, an open
    element) is read to its end.  Inside a block white space (decoded
    character references included) becomes one space; blocks are joined by
    one newline; nothing else is dropped or capped."""
    return _extract(html_col)
