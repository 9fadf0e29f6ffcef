"""HTML main-text extraction with nearest-URL page differencing.

Method: within each host, pages are sorted by URL path (then id), and every
page is paired with the neighbour whose path has the longer common start, the
earlier one if both are alike.  The text lines of both are aligned by a longest
common subsequence.  Shared lines are deleted as template, with one exception:
inside an article only those go that stand at the same end of both articles and
of the article on the page's other side, if the host has a page there, since a
line in its midst, or one that a single other page has too, is a quotation or a
common phrase; and copies of one article under two URLs, whose shared lines
hold ``COPY`` of its characters or more, keep all of it.  What markup names as
menu, header, footer, sidebar, notice, advert, form or comments goes as well,
since a template line may also stand on one page only.

Ranges of (host, path, id) are cut at keys drawn by a hash, so no host is held
together; the first and last page of a range are sent to the adjoining one as
guests, so a page's neighbour doesn't depend on the number of ranges.

Defined cases: null html is an empty page; a null url has an empty host and
path; a null id sorts before others; a page without a neighbour of its host
loses no shared lines; repeated rows are paired like any neighbours; an empty
table gives an empty result; other columns are ignored, whatever their names.
Texts are never cut: reading takes time in proportion to a page's length, and
aligning takes space in proportion to its lines.
"""

from __future__ import annotations

import bisect
import html
import math
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .urls import host_path

# Element names by role, and words in class, id or role attributes that name what is not main text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head", "datalist", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "article", "main", "section", "div", "body", "blockquote"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "disqus", "replies", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "skip", "search", "login"}

_name = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
_tail = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_attr = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)")
_word = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")
MAIN, PLAIN, BOILER = 2, 1, 0
COPY = 0.5


def _named_as_boiler(name: str, attrs: str, inside: bool) -> bool:
    if not attrs or ("=" not in attrs and "hidden" not in attrs):
        return False
    if _hidden.search(attrs):
        return True
    for m in _attr.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            words = set(_word.findall(value))
            if words & NAMES or (not inside and "header" in words):
                return True
    return False


class Open:
    """The stack of open elements: (name, region inside, position of the nearest that is no inline element)."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        self.boiler: list[int] = []
        self.main = 0
        self.region = PLAIN

    def push(self, name: str, region: int) -> None:
        at = len(self.stack)
        self.where.setdefault(name, []).append(at)
        if name in SCOPES:
            self.scopes.append(at)
        if name not in INLINE:
            self.blocks.append(at)
        if region == BOILER:
            self.boiler.append(at)
        self.main += region == MAIN
        self.stack.append((name, region))
        self.region = region

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name, region = self.stack.pop()
            at = len(self.stack)
            self.where[name].pop()
            for positions in (self.scopes, self.blocks, self.boiler):
                if positions and positions[-1] == at:
                    positions.pop()
            self.main -= region == MAIN
        self.region = self.stack[-1][1] if self.stack else PLAIN

    def last(self, *names: str) -> int:
        """Position of the nearest open element of these names, or -1."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)


def tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether an end tag, lower-cased name, attributes) of every tag, then the text that is left with an empty name.

    One pass: comments and raw elements are left out; a quote that is never
    closed is read as a plain character from there on.
    """
    at, text, size, last, quotes = 0, [], len(page), page.rfind(">"), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            break
        text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
            continue
        closing = page[lt + 1] == "/"
        m = _name.match(page, lt + 1 + closing)
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        tail = _tail.match(page, m.end()) if quotes else None
        if tail is None:
            quotes = False
            at = page.find(">", m.end()) + 1
        else:
            at = tail.end()
        name = m.group().lower()
        yield "".join(text), closing, name, page[m.end() : at - 1]
        text = []
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?![a-zA-Z0-9-])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or size) if end else size
    yield "".join(text) + page[at:], False, "", ""


def lines(page: str) -> list[tuple[str, int]]:
    """(text, region) of every block in page order; region says article, other text, or named boilerplate."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    open_ = Open()

    def close_block() -> None:
        if parts:
            text = _space.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, open_.region))
            parts.clear()

    def pop_to(k: int) -> None:
        close_block()
        open_.pop_to(k)

    for text, closing, name, attrs in tags(page):
        if text:
            parts.append(text)
        if not name or (name in RAW and not closing):
            continue
        if closing:  # an end tag closes the nearest element of its name; a stray one does nothing
            k = open_.last(name)
            if name in INLINE:
                if k > (open_.blocks[-1] if open_.blocks else -1) and open_.stack[k][1] == open_.region:
                    open_.pop_to(k)
            elif k >= 0:
                pop_to(k)
            else:
                close_block()
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                parts.append(" " if name == "br" else "")
            elif not attrs.endswith("/"):
                open_.push(name, open_.region)
            continue
        if name in VOID:
            close_block()
            continue
        inside = open_.main > 0
        if name in ("article", "main", "footer", "body") and open_.boiler:  # these don't stand in a menu: its end tag is missing
            k = open_.boiler[0]
            if open_.stack[k][0] in ("nav", "head", "header", "form"):
                pop_to(k)
        k = open_.last(*CLOSED_BY_BLOCK, *SIBLINGS.get(name, ()))  # implied end tags
        if k > max((x for x in open_.scopes[-1:] if x != k), default=-1):
            pop_to(k)
        close_block()
        if open_.region == BOILER or name in DROPPED or (name == "header" and not inside) or _named_as_boiler(name, attrs, inside):
            inner = BOILER
        elif name in ("article", "main"):
            inner = MAIN
        else:
            inner = open_.region
        if not attrs.endswith("/") or name in ("article", "main"):
            open_.push(name, inner)
    close_block()
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of b with every start of a, by bit-parallel rows."""
    where: dict = {}
    for i, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << i
    v = ones = (1 << len(a)) - 1
    for line in b:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & ones
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list) -> set[int]:
    """Indices in ``a`` of a longest common subsequence with ``b``; space grows with the lines, not with their product."""
    common = set(a) & set(b)
    left, right = [(i, x) for i, x in enumerate(a) if x in common], [x for x in b if x in common]
    out: set[int] = set()
    todo = [(left, right)]
    while todo:
        x, y = todo.pop()
        head = 0
        while head < min(len(x), len(y)) and x[head][1] == y[head]:
            out.add(x[head][0])
            head += 1
        x, y = x[head:], y[head:]
        while x and y and x[-1][1] == y[-1]:
            out.add(x.pop()[0])
            y.pop()
        if not x or not y:
            continue
        if len(y) == 1:
            out.update([i for i, line in x if line == y[0]][:1])
            continue
        half, texts = len(y) // 2, [line for _, line in x]
        cut = int(np.argmax(_lengths(texts, y[:half]) + _lengths(texts[::-1], y[half:][::-1])[::-1]))
        todo += [(x[:cut], y[:half]), (x[cut:], y[half:])]
    return out


def _ends(a: list[str], b: list[str]) -> set[int]:
    """Indices of the lines that both lists start (maybe after a title of their own) or end with."""
    least = min(len(a), len(b))
    title = int(least > 0 and a[0] != b[0])
    head = next((k for k in range(title, least) if a[k] != b[k]), least)
    tail = next((k for k in range(least) if a[-1 - k] != b[-1 - k]), least)
    return {*range(title, head), *range(len(a) - tail, len(a))}


Page = list[tuple[str, int]]


def main_text(page: Page, neighbour: Page | None, other: Page | None = None) -> str:
    """The page's main lines: named boilerplate left out, and template lines that the neighbour shares deleted; ``other`` is the page on its other side."""
    marked = lambda lines: [(t, r == MAIN) for t, r in lines]
    gone = shared_lines(marked(page), marked(neighbour)) if neighbour else set()
    article = [k for k, (_, r) in enumerate(page) if r == MAIN]
    if not article:
        return "\n".join(t for k, (t, r) in enumerate(page) if r == PLAIN and k not in gone)
    own, ends = [page[k][0] for k in article], set()
    if neighbour and sum(len(page[k][0]) for k in article if k in gone) < COPY * sum(map(len, own)):
        ends = _ends(own, [t for t, r in neighbour if r == MAIN])
        if other:
            ends &= _ends(own, [t for t, r in other if r == MAIN])
    return "\n".join(t for n, t in enumerate(own) if n not in ends)


PAGES_PER_RANGE, MOST_RANGES, DRAWN_PER_RANGE = 1024, 16_384, 16


def ranges(keys: DataFrame) -> list[tuple]:
    """Ascending (host, path, id) borders that cut the keys into ranges of about ``PAGES_PER_RANGE``, at most ``MOST_RANGES``."""
    total = keys.count()
    many = min(MOST_RANGES, -(-total // PAGES_PER_RANGE))
    if many < 2:
        return []
    share = math.ceil(min(1.0, DRAWN_PER_RANGE * many / total) * (1 << 20))
    drawn = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(*keys.columns), F.lit(1 << 20)) < share).collect())  # DRAWN_PER_RANGE keys a range
    return sorted({drawn[k * len(drawn) // many] for k in range(1, many)}) if drawn else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    host, path = host_path(url_col)
    number = F.col(id_col).cast("long")
    key = [host.alias("host"), path.alias("path"), F.coalesce(number, F.lit(-(2**63))).alias("at")]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), *key)
    keys = pages.select(*key)
    borders = ranges(keys)
    shared = pages.sparkSession.sparkContext.broadcast(borders)  # MOST_RANGES keys at most

    def number_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect.bisect_right(shared.value, k) for k in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "part"])

    # The first and last key of every range: one row a range.  These pages are sent to the adjoining range too.
    edges = map_arrow(keys, number_of, "host string, path string, at long, part int").groupBy("part").agg(F.min(F.struct("host", "path", "at")).alias("lo"), F.max(F.struct("host", "path", "at")).alias("hi")) if borders else None
    found = sorted((r.part, tuple(r.lo), tuple(r.hi)) for r in edges.collect()) if borders else []
    guests: dict[tuple, set[int]] = {}
    for (p, _, hi), (q, lo, _) in zip(found[:-1], found[1:], strict=True):
        if hi[0] == lo[0]:  # of one host
            guests.setdefault(hi, set()).add(q)
            guests.setdefault(lo, set()).add(p)
    visits = pages.sparkSession.sparkContext.broadcast(guests)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, part, guest = [], [], []
            for n, k in enumerate(zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True)):
                for p in (bisect.bisect_right(shared.value, k), *sorted(visits.value.get(k, ()))):
                    guest.append(bool(part) and bool(take) and take[-1] == n)
                    take.append(n)
                    part.append(p)
            got = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(part, pa.int32()), pa.array(guest, pa.bool_())], names=[*batch.schema.names, "part", "guest"])

    kind = pages.schema[id_col].dataType.simpleString()
    placed = map_arrow(rows, place, f"id {kind}, url string, html string, host string, path string, at long, part int, guest boolean")
    sorted_rows = placed.repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("part", "host", "path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def pages_in_order():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                for start in range(0, batch.num_rows, 64):
                    for i, u, h, *rest in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                        yield i, u, *rest, lines(h)
            yield None

        def common(a, b) -> int:
            return len(os.path.commonprefix([a[3], b[3]])) if a and b and a[2] == b[2] and a[5] == b[5] else -1

        before = page = None
        ids, urls, texts = [], [], []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, "url", "text", "n_chars"])
            for x in (ids, urls, texts):
                x.clear()
            return got

        for after in pages_in_order():
            if page and not page[6]:
                left, right = common(page, before), common(page, after)
                near, far = (before, after) if left >= right else (after, before)
                ids.append(page[0])
                urls.append(page[1])
                texts.append(main_text(page[7], near[7] if max(left, right) >= 0 else None, far[7] if min(left, right) >= 0 else None))
                if len(ids) == 64:
                    yield out()
            before, page = page, after
        if ids:
            yield out()

    return map_arrow(sorted_rows, run, f"{id_col} {kind}, url string, text string, n_chars long")
