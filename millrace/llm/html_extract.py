"""Main-text extraction from HTML by the line-block distribution.

Markup is stripped to lines, one per block element in page order. Lines inside menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles and comment sections are blank to the distribution. The text lengths of the
others, without those of links, are summed over a sliding window of `window` lines. A surge point is a line with text whose
window is not blank and holds at least `surge` characters, or as many as the page's fullest window where that is less;
the dive point after it is the first line from which a whole window is blank. The lines with text between a surge and its
dive are kept.

Article and main elements outside of all that is dropped bound the search: no window reaches over their edges. Inside of them
each line with text is a surge, links or not, as the page says that it is text. Whether that is so is for the distribution
to say: where all that it finds outside is over `trust` times as long as the longest marked element, the marks are
taken for teasers; of the marked elements only one with the page's first-level heading is kept then, and what lies
between surge and dive outside of them.

What an element is goes by its tag and by the names in its class, id and role, each name as a whole: sidebar, left-sidebar
and sidebar_box are sidebars, has-sidebar and search-trees are not; a name that begins or ends with comment(s) is a
comment section, unless it only says whether there are any. Only containers are judged by names, and paragraphs by
their class; headings never are. A header inside of an article is its title. A section of an article that begins with a
heading is a chapter, even if it is called login or search.

The page is read once from left to right: of a tag, a comment or a quoted value that doesn't end, no part is read again.

Defined results: null or empty html gives an empty text and 0 characters; a page that ends inside a tag, an element or a
character reference gives what it has; pages without block elements are one block; repeated rows are judged alike; no
text is capped. Each page is judged by itself, so an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: What can end a tag, or begin a quoted value in it.
IN_TAG = re.compile(r""">|=\s*+["']""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in ("script", "style", "textarea", "noscript", "template", "title", "iframe", "svg")}
CUE = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", re.I)
SPACE = re.compile(r"\s+")
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "area", "base", "col", "embed", "track"}
BLOCKS = set("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre section article main aside header footer nav form figure figcaption address details summary fieldset legend body html head hr center".split())
DROPPED = set("nav footer aside form menu dialog button select label input head".split())
#: Elements that are judged by the names they bear.
CONTAINERS = set("div section article aside nav header footer ul ol dl table form details figure p".split())
#: Words of class, id and role that mark what isn't the article's own text.
NOISE = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices alert newsletter subscribe subscription share sharing social related recommended gdpr comment comments commentlist reply replies respond disqus footer pagination pager popup modal widget toolbar search login signup complementary contentinfo form".split())
#: Words that mark a page's own head, but inside of an article its title.
TITLES = {"header", "masthead"}
#: Words that leave a name what it is when they stand in it beside the others.
PARTS = set("site page main top bottom left right center primary secondary inner outer global fixed sticky floating area box bar block list item items link links wrap wrapper container section content panel group row col column button buttons icon icons slot unit text body user users reader readers post posts article articles story entry blog thread collapse trail wp fb c".split())
#: Words beside comment(s) that say whether there are any.
WHETHER = set("has have no with without open opened closed on off enabled disabled allow allowed show hide".split())
#: What a chapter may be about.
CHAPTERS = set("search login signup alert form notice notices navigation menu modal widget toolbar".split())
HEADING = re.compile(r"\s*+<h[1-6]\b", re.I)
OWN_TITLE = {"article", "articles", "post", "posts", "story", "entry", "blog", "content"}
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@lru_cache(10_000)
def kind_of(name: str) -> str:
    """noise, title (noise outside of an article only), chapter (noise unless it is one) or nothing, by a name as a whole."""
    in_order = [w.lower() for w in WORDS.findall(name)]
    words = set(in_order)
    if words and {in_order[0], in_order[-1]} & {"comment", "comments"} and not words & WHETHER:
        return "noise"
    if words & NOISE and words & NOISE <= CHAPTERS and words <= NOISE | PARTS:
        return "chapter"
    if not words <= NOISE | TITLES | PARTS:
        return ""
    if words & TITLES and not words & NOISE:
        return "" if words & OWN_TITLE else "title"
    return "noise" if words & (NOISE | TITLES) else ""


def is_noise(tag: str, attributes: str, in_article: bool, chapter: bool) -> bool:
    for attribute, value in CUE.findall(attributes):
        if tag == "p" and attribute.lower() != "class":
            continue
        for name in value.strip("\"'").split():
            kind = kind_of(name[:80])
            if kind == "noise" or kind == "chapter" and not chapter or kind == "title" and not in_article and tag != "p":
                return True
    return False


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag that is open at `at` ends; a quote that is nowhere closed is a character like any other."""
    while found := IN_TAG.search(page, at):
        quote = found[0][-1]
        if quote == ">":
            return found.end()
        at = found.end()
        if quote not in unclosed:
            end = page.find(quote, at)
            if end < 0:
                unclosed.add(quote)
            else:
                at = end + 1
    return len(page)


class Line(NamedTuple):
    text: str
    plain: int  # characters outside of links, without spaces
    mark: int  # the marked element that it stands in, from 1
    title: bool  # a first-level heading


def lines_of(page: str) -> list[Line]:
    """The page's blocks with text that are not dropped."""
    out: list[Line] = []
    parts: list[str] = []
    plain = [0]
    stack: list[tuple[str, bool]] = []  # open elements that make a difference, and whether they are dropped
    open_: Counter[str] = Counter()
    dropped = articles = marks = link = 0

    def flush() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Line(text, plain[0], marks if articles else 0, open_["h1"] > 0))
        parts.clear()
        plain[0] = 0

    def add(raw: str) -> None:
        if raw and not dropped:
            text = html.unescape(raw)
            parts.append(text)
            if not link:
                plain[0] += len(text) - text.count(" ")

    at, unclosed = 0, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        mark = page[start + 1 : start + 2]
        closing = mark == "/"
        named = NAME.match(page, start + 1 + closing)
        if not named and mark not in ("!", "?", "/"):
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        if not named:
            end = page.find("-->", start + 4) + 3 if page.startswith("<!--", start) else page.find(">", start) + 1
            at = end if end > 2 or end == 1 else len(page)
            continue
        at = tag_end(page, named.end(), unclosed)
        name, rest = named[0].lower(), page[named.end() : at].rstrip(">")
        if name in RAW_END and not closing:
            if not rest.endswith("/"):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            link = 0 if closing else 1
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS and name not in DROPPED:
            continue
        if not dropped:
            flush()
        if name in VOID:
            continue
        if closing:
            if open_[name]:
                while stack:
                    n, was = stack.pop()
                    open_[n] -= 1
                    dropped -= was
                    articles -= n in ("article", "main") and not was
                    if n == name:
                        break
            continue
        while stack and stack[-1][0] == "p":  # a block ends an open paragraph
            open_["p"] -= 1
            dropped -= stack.pop()[1]
        page_header = name == "header" and not articles
        chapter = name == "section" and articles > 0 and bool(HEADING.match(page, at))
        drop = name in DROPPED or page_header or bool(rest) and name in CONTAINERS and is_noise(name, rest, articles > 0, chapter)
        open_[name] += 1
        stack.append((name, drop))
        dropped += drop
        if name in ("article", "main") and not drop:
            marks += not articles and not dropped
            articles += 1
        link = 0
    flush()
    return out


def between(sizes: list[int], window: int, least: int) -> list[bool]:
    """Which lines stand between a surge, a window of at least so many characters, and its dive, a blank window."""
    dense = np.array(sizes, np.int64)
    sums = np.convolve(dense, np.ones(window, np.int64))[window - 1 :]
    kept, inside = [], False
    for size, total in zip(sizes, sums.tolist(), strict=True):
        inside = total > 0 if inside else total >= least and size > 0
        kept.append(inside)
    return kept


def main_lines(page: str | None, window: int = 3, surge: int = 40, trust: float = 2.0) -> tuple[list[str], str]:
    """The lines of the main text, and whether the page's own marks bound it (marked), were passed over (free) or are none (unmarked)."""
    runs = [(mark, list(run)) for mark, run in groupby(lines_of(page or ""), key=lambda x: x.mark)]
    fullest = max((sum(x.plain for x in run[i : i + window]) for mark, run in runs if not mark for i in range(len(run))), default=0)
    found = []
    for mark, run in runs:
        kept = between([len(x.text) if mark else x.plain for x in run], window, 1 if mark else max(min(surge, fullest), 1))
        found.append((mark, [x for x, keep in zip(run, kept, strict=True) if keep]))
    marked, free = Counter(), 0
    for mark, kept in found:
        marked[mark] += sum(len(x.text) for x in kept)
        free += sum(x.plain for x in kept) if not mark else 0
    del marked[0]
    by = "unmarked" if not marked else "marked" if free <= trust * max(marked.values()) else "free"
    titled = {mark for mark, kept in found if mark and any(x.title for x in kept)}
    wanted = marked.keys() if by == "marked" else {0} | titled
    return [x.text for mark, kept in found if mark in wanted for x in kept], by


def main_text(page: str | None, **limits: float) -> str:
    return "\n".join(main_lines(page, **limits)[0])


@pandas_udf(T.StringType())
def extract(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_pages(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The pages, all columns, with the main text in `out`."""
    return pages.withColumn(out, extract(F.col(html_col)))
