"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page; what belongs to
menus, headers, footers, adverts and the like is stripped to blank lines. The
text lengths of sliding windows of lines surge where the article begins and dive
where it ends; the lines between are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lodefit.llm.common import batch_of, small_batches, table, texts

_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9-]*))", re.I)
_ATTRIBUTES = {q: re.compile("(?:[^>" + q + "]+" + "".join(f"|{c}[^{c}]*{c}" for c in q) + ")*+") for q in ("\"'", '"', "'", "")}
#: Elements whose inside isn't markup, and where it ends.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template textarea svg iframe title".split()}
#: Decimal character references that are too long for any character, but for leading zeros.
_LONG_REFERENCE = re.compile(r"&#(0*)([0-9]{8,})")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog button select fieldset".split())
#: What HTML lets go unclosed: a start of these names closes the open elements named next, up to one named last.
_BLOCK = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul"
_CELLS = "td th caption button object html"
IMPLIED = {
    start: (frozenset(closed.split()), frozenset(border.split()))
    for starts, closed, border in (
        (_BLOCK, "p", f"{_CELLS} table"), ("li", "li p", f"{_CELLS} table ul ol menu"), ("dt dd", "dt dd p", f"{_CELLS} table dl"), ("option optgroup", "option", "select"),
        ("td th", "td th", "tr table"), ("tr", "tr td th", "table"), ("tbody thead tfoot", "tbody thead tfoot tr td th", "table"), ("body", "head", "html"),
    )
    for start in starts.split()
}
#: Open elements that are told apart; what is nested deeper belongs to the deepest of them, as in browsers.
DEPTH = 512
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Parts of class, id and role names that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promotion promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)


@dataclass(frozen=True)
class Settings:
    """window: lines of a sliding window; surge: characters outside links that a window must reach for text of no
    article element; dive: characters of a window below which such text has not begun or is over."""

    window: int = 3
    surge: int = 86
    dive: int = 30


#: Beginnings that mark as well, and first parts of a name that only say something of another element.
STEMS = ("advert", "breadcrumb", "comment", "cookie", "navig", "newsletter", "sidebar", "sponsor", "subscri")
MODIFIERS = frozenset("has hide is no show with without".split())
#: What marks an article element that isn't the page's own.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related replies reply sponsored teaser".split())


@dataclass(frozen=True)
class Tag:
    """A piece of markup: a comment or declaration has no name; raw: an element whose inside isn't read, up to its end."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    raw: bool = False
    attributes: str = ""


class Tags:
    """The markup of a page from any place on, in time linear in the page, whatever is left unclosed.

    A tag with no > after it is text. A quote that nothing closes is a letter like
    any other; and once all of the rest would be one tag, quotes hold nothing any more.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.plain = len(page)  # tags that start from here on have no quotes

    def next(self, pos: int) -> Tag | None:
        page = self.page
        while (m := _START.search(page, pos)) is not None:
            start, pos = m.start(), m.end()
            if m[1] or m[2]:
                end = page.find("-->" if m[1] else "]]>", pos)
                return Tag(start, len(page) if end < 0 else end + 3)
            if pos > self.last:
                continue
            if m[3]:
                return Tag(start, page.index(">", start) + 1)
            end = self._end_of_attributes(start, pos)
            name, attributes = m[5].lower(), page[pos:end]
            if not m[4] and name in RAW and not (name == "svg" and attributes.endswith("/")):
                close = RAW[name].search(page, end + 1)
                return Tag(start, close.end() if close else len(page), raw=True)
            return Tag(start, end + 1, name, bool(m[4]), False, attributes)
        return None

    def _end_of_attributes(self, start: int, pos: int) -> int:
        """Where the > is that ends a tag; there is one after pos."""
        page, at = self.page, pos
        quotes = "\"'" if start < self.plain else ""
        while True:
            at = _ATTRIBUTES[quotes].match(page, at).end()
            if at >= len(page):
                self.plain = start
                return page.index(">", pos)
            if page[at] == ">":
                return at
            quotes = quotes.replace(page[at], "")
            at += 1


def _unescape(text: str) -> str:
    if "&#" in text:
        text = _LONG_REFERENCE.sub(lambda m: f"&#{m[2][:8]}", text)
    return html.unescape(text)


def _names(attributes: str) -> Iterator[list[str]]:
    """The words of each class, id and role name, but for names that only modify."""
    if attributes:
        for a, b, c in _NAMES.findall(attributes):
            for name in (a or b or c).lower().split():
                words = _WORD.findall(name)
                if words and words[0] not in MODIFIERS:
                    yield words


def _marked(attributes: str, article: bool) -> bool:
    return any(
        not MARKS.isdisjoint(words)
        or any(w.startswith(STEMS) and not w.startswith("commentar") for w in words)
        or (not article and "header" in words and (len(words) == 1 or not {"site", "page", "top", "global"}.isdisjoint(words)))
        for words in _names(attributes)
    )


def lines_of(page: str, window: int) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside the article) of each line; a main element is the article where there is no other.

    A part that isn't the article leaves window blank lines, so no window reaches over it,
    unless the text before and after it stands in the same element as it does.
    """
    lines: list[tuple[str, int, bool]] = []
    held: list[str] = []
    places: list[tuple[int, ...]] = []  # the innermost blocks of each line, by where their tags start
    gaps: list[tuple[int, int]] = []  # where blank lines start, and the block they are in
    within: tuple[int, ...] = ()
    state = {"free": 0, "article": 0, "link": 0}
    stack: list[tuple[str, int]] = []  # open elements and where their tags start
    outer: list[tuple[int, int]] = []  # the two innermost blocks at each of them
    count: Counter[str] = Counter()  # of each name in it
    skip, at = -1, 0  # the place in the stack of the element that is skipped
    start, unclosed = 0, set()
    own = "article" if re.search(r"<article\b", page, re.I) else "main"

    def outside(name: str, attributes: str) -> bool:
        if name in ("html", "body", "main") or name in VOID:
            return False
        if name == "article":
            return any(not OTHER_ARTICLES.isdisjoint(words) for words in _names(attributes))
        return name in OUTSIDE or (name == "header" and not state["article"]) or _marked(attributes, state["article"] > 0)

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            lines.append((text, min(state["free"], len(text)), state["article"] > 0))
            places.append(within)
        held.clear()
        state["free"] = 0

    def blocks(most: int) -> tuple[int, ...]:
        return outer[-1][:most] if outer else (-1, -1)[:most]

    def add(raw: str) -> None:
        nonlocal within
        text = _unescape(raw)
        if not text.isspace():
            within = blocks(2)
        held.append(text)
        if not state["link"]:
            state["free"] += len(text.strip())

    def push(name: str, start: int) -> None:
        if len(stack) >= DEPTH and skip < 0:
            return
        inner = outer[-1] if outer else (-1, -1)
        outer.append(inner if name in INLINE else (start, inner[0]))
        stack.append((name, start))
        count[name] += 1

    def pop(i: int, to: int | None = None) -> None:
        count.subtract([n for n, _ in stack[i:to]])
        del stack[i:to], outer[i:to]

    def implied(name: str) -> None:
        """Close what a start of name closes."""
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop(len(stack) - 1)
        closed, border = IMPLIED.get(name, (frozenset(), frozenset()))
        if any(count[n] for n in closed):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in closed:
                    pop(i)

    def end(name: str) -> None:
        """Close the innermost element of name: with what is open in it, but for blocks within an inline one."""
        nonlocal skip
        if not count[name]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                if name in INLINE and any(n not in INLINE for n, _ in stack[i:]):
                    pop(i, i + 1)
                    skip = skip - 1 if i < skip else len(stack) if i == skip else skip
                else:
                    pop(i)
                return
            if name not in ("table", "html", "body") and stack[i][0] in ("td", "th", "caption") and name not in ("tr", "tbody", "thead", "tfoot"):
                return

    def again() -> bool:
        """Whether the skipped element is to be read after all, as nothing closes it before the page's end."""
        name = stack[skip][0]
        if name in OUTSIDE and not re.compile(rf"<{own}\b", re.I).search(page, stack[skip][1] + 1):
            return False
        unclosed.update(at for _, at in stack[skip:])
        return True

    pos, tags = 0, Tags(page)
    while True:
        m = tags.next(pos)
        if m is None:
            if skip >= 0 and again():
                pos = at = start
                pop(skip)
                skip = -1
                continue
            break
        pos = m.end
        if skip < 0 and m.start > at:
            add(page[at : m.start])
        at = pos
        name = m.name
        if not name:
            if skip < 0 and m.raw:
                close()
            continue
        if skip >= 0 and m.closing and name in ("body", "html") and again():
            pos = at = start
            pop(skip)
            skip = -1
            continue
        if m.closing:
            own_end = skip >= 0 and name == stack[skip][0]
            end(name)
        else:
            own_end = False
            implied(name)
        if skip >= 0:
            if len(stack) > skip:
                if not m.closing and name not in VOID and not m.attributes.endswith("/"):
                    push(name, m.start)
                continue
            skip = -1
            if own_end:
                continue
        if not m.closing and m.start not in unclosed and outside(name, m.attributes):
            close()
            gaps.append((len(lines), blocks(1)[0]))
            lines.extend([("", 0, False)] * window)
            places.extend([()] * window)
            skip, start = len(stack), m.start
            push(name, m.start)
            continue
        if not m.closing and name not in VOID and not m.attributes.endswith("/"):
            push(name, m.start)
        if name == own:
            close()
            state["article"] = max(0, state["article"] + (-1 if m.closing else 1))
        if name == "a":
            state["link"] = 0 if m.closing else 1
        elif name not in INLINE:
            close()
            state["link"] = 0
    if skip < 0:
        add(page[at:])
        close()
    inner = set()
    full = [i for i, (text, _, _) in enumerate(lines) if text]
    for i, block in gaps:
        n = bisect_left(full, i)
        if 0 < n < len(full) and block in places[full[n - 1]] and block in places[full[n]]:
            inner.update(range(i, i + window))
    return [x for i, x in enumerate(lines) if i not in inner]


def extract(page: str | None, settings: Settings = Settings()) -> str:
    """The main text of one whole page, blocks joined by one space; empty if there is none or the page is null.

    An article element is the whole of it if it holds most of the text outside links; else its text is kept with the rest's.
    """
    lines = lines_of(page or "", settings.window)
    marked = any(article for _, _, article in lines) and 2 * sum(free for _, free, article in lines if article) >= sum(free for _, free, _ in lines)
    # the text that counts: all of an article element, and what isn't linked where there is no such or more outside
    weight = [len(t) if article else 0 if marked else free for t, free, article in lines]
    k = settings.window
    sums = [sum(weight[i : i + k]) for i in range(len(lines))]
    kept: list[tuple[int, int]] = []
    best: tuple[int, int, int] | None = None
    i = 0
    while i < len(lines):
        if not weight[i]:
            i += 1
            continue
        dive = i  # the surge is here; the dive is where a whole window is blank
        while dive < len(lines) and sums[dive]:
            dive += 1
        peak = max(sums[i:dive])
        if marked or any(article for _, _, article in lines[i:dive]):
            kept.append((i, dive))
        elif peak >= settings.surge:
            first, last = i, dive - 1
            while sums[first] < min(peak, settings.dive):
                first += 1
            while sum(weight[max(first, last - k + 1) : last + 1]) < min(peak, settings.dive) and last > first:
                last -= 1
            kept.append((first, last + 1))
        elif best is None or peak > best[0]:
            best = (peak, i, dive)
        i = dive
    if not kept and best:
        kept = [best[1:]]
    # short and linked lines between the first surge and the last dive belong to the text
    span = range(kept[0][0], kept[-1][1]) if kept else range(0)
    return " ".join(lines[i][0] for i in span if lines[i][0] and (weight[i] or not marked))


def extract_table(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; one row for each row.

    Null and empty pages have the empty text. Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(t, settings) for t in texts(b, "html")]
            yield batch_of([b.column(0), b.column(1), found, [len(t) for t in found]], _OUT)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_table(table(spark, sf_dir, "pages"))
