"""Main text of web pages by the line-block distribution.

The markup is stripped into lines, one per block element.  A line's weight is
the length of its text without links; lines of menus, headers, footers,
sidebars, notices, adverts, forms and comments weigh nothing, nor do, on a
page whose article is marked as such, lines outside it.  Weights are summed
over sliding windows of lines.  A window above the threshold that stays above
zero is a surge point, the next empty window a dive point, and the lines
between them are kept.

A class or id tells little: a wrapper named ``container sidebar-right`` holds
the article.  An element marked by such a name is therefore judged by where
the page's text lies (``lifted``), the outermost first, and is no frame if it
holds most of the text around a heading or article, or if too little is left
outside of it.  Elements and roles that are frames by definition stay frames,
so a heading in a page header outside ``article`` and ``main`` is left out.

Edge cases: a null or empty page gives an empty text; markup that is never
closed ends with the page; a page whose windows never reach the threshold
takes its greatest window instead; equal rows give equal texts.
"""

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from jobloom.llm.common import small_batches

WINDOW = 3
THRESHOLD = 60

# Elements that break lines, have no content, hide their content, or hold no part of an article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video head title select option datalist textarea button".split())
ASIDES = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skip masthead copyright disclaimer reply replies".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
COMMENTS = frozenset("comment comments disqus reply replies".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
SECTIONS = frozenset("thead tbody tfoot".split())
# Start tags that end open elements whose end tag is left out, and the elements beyond which they end none.
IMPLIED_END = (
    {"li": ({"li"}, BLOCKS - {"address", "div", "p", "li"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "tr": ({"tr", "td", "th"}, SECTIONS | {"table"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, BLOCKS - {"address", "div", "p", "dt", "dd"}))
    | dict.fromkeys(("td", "th"), ({"td", "th"}, SECTIONS | {"table", "tr"}))
    | dict.fromkeys(SECTIONS, (SECTIONS | {"tr", "td", "th"}, {"table"}))
    | {"p": ({"p"}, BLOCKS - {"p"})}
)
MODIFIERS = frozenset("has no with without".split())  # such a name tells what an element has, not what it is
PLAIN = frozenset("html body article main".split())

TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
BLANK = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    linked: int  # characters of links
    aside: bool
    article: bool
    mark: int = -1  # the innermost marked element
    heading: bool = False


@dataclass
class Mark:
    """An element whose class or id sounds like a frame."""

    parent: int
    article: bool  # is an article element
    comments: bool
    within: bool  # stands in an article
    holds: bool = False  # has a heading of the page, an article or a main part inside
    text: int = 0
    linked: int = 0


class Lines(HTMLParser):
    """Lines of a page and its marked elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.marks: list[Mark] = []
        self.inside: list[int] = []  # the open marked elements
        self.text: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, str]] = []  # tag and kind of the open elements
        self.at: dict[str, list[int]] = {}  # places of the open elements of a tag
        self.depth = {"aside": 0, "hidden": 0, "article": 0, "link": 0, "mark": 0}

    def end_line(self) -> None:
        text = BLANK.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.linked, self.depth["aside"] > 0, self.depth["article"] > 0, self.inside[-1] if self.inside else -1, any(self.at.get(h) for h in HEADINGS)))
        self.text, self.linked = [], 0

    def kind(self, tag: str, attrs: list) -> str:
        if tag in HIDDEN:
            return "hidden"
        a = {k: v or "" for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return "hidden"
        whole = tag in ("article", "main") or a.get("role") in ("article", "main")
        if not whole and (tag in ASIDES or a.get("role", "").lower() in ROLES or tag == "header" and not self.depth["article"]):
            return "aside"
        names = self.marked(a) if tag == "article" or tag not in PLAIN else set()
        if names:
            self.marks.append(Mark(self.inside[-1] if self.inside else -1, whole, bool(names & COMMENTS), self.depth["article"] > 0))
            return "mark"
        return "article" if whole else "link" if tag == "a" else ""

    @staticmethod
    def marked(a: dict) -> set[str]:
        names = (TOKEN.findall(name) for name in (a.get("class", "") + " " + a.get("id", "")).split())
        return {t.lower() for words in names if words and words[0].lower() not in MODIFIERS for t in words} & MARKS

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        if self.at.get("head") and tag not in IN_HEAD and (tag == "body" or self.stack[-1][0] == "head"):
            self.close_from(self.at["head"][-1])
        if tag in VOID:
            return
        if tag in IMPLIED_END:
            ended, beyond = IMPLIED_END[tag]
            bound = max((self.at[t][-1] for t in beyond if self.at.get(t)), default=-1)
            self.close_from(min((k for t in ended if self.at.get(t) and (k := self.at[t][-1]) > bound), default=len(self.stack)))
        kind = self.kind(tag, attrs)
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, kind))
        if kind:
            self.depth[kind] += 1
        if self.inside and not self.depth["aside"] and not self.depth["hidden"] and (kind == "article" or tag == "h1"):
            self.marks[self.inside[-1]].holds = True
        if kind == "mark":
            self.inside.append(len(self.marks) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:  # a slash closes foreign and inline elements only
            self.handle_endtag(tag)

    def close_from(self, k: int) -> None:
        while len(self.stack) > k:
            tag, kind = self.stack.pop()
            self.at[tag].pop()
            if kind:
                self.depth[kind] -= 1
            if kind == "mark":
                self.inside.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if self.at.get(tag):
            self.close_from(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.at.get("head") and self.stack[-1][0] == "head" and data.strip():
            self.close_from(self.at["head"][-1])
        if self.depth["hidden"]:
            return
        self.text.append(data)
        if self.depth["link"]:
            self.linked += len(data.strip())


def own(line: Line) -> int:
    """Characters of a line outside links."""
    return max(0, len(line.text) - line.linked)


def greatest_window(weights: list[int], window: int = WINDOW) -> int:
    return max((sum(weights[i:i + window]) for i in range(len(weights))), default=0)


def lifted(lines: list[Line], marks: list[Mark]) -> list[bool]:
    """Which marked elements are no frames, by the distribution of the page's text.

    One inside a frame is a frame.  Otherwise it must hold most of the text
    outside links, and less in links than outside them; and it must hold a top
    heading or an article, or leave too little outside: besides headings no
    window of lines that reaches the threshold or, in an article, less than a
    tenth of its own text.  Readers' comments need the former, and a top
    heading or an article is not told from a commenter's, so they must hold
    nine tenths.
    """
    seen = [x for x in lines if not x.aside]
    for x in seen:
        if x.mark >= 0:
            marks[x.mark].text += own(x)
            marks[x.mark].linked += x.linked
    for m in reversed(marks):  # an element comes after the one it is in
        if m.parent >= 0:
            up = marks[m.parent]
            up.text, up.linked, up.holds = up.text + m.text, up.linked + m.linked, up.holds or m.holds or m.article and not m.comments
    total = sum(map(own, seen))
    out: list[bool] = []
    for k, m in enumerate(marks):
        most = m.text * 2 > total and m.text > m.linked
        if not most or m.parent >= 0 and not out[m.parent]:
            out.append(False)
        elif m.comments:
            out.append(m.holds and m.text * 10 >= total * 9)
        else:
            left = [own(x) for x in seen if not x.heading and (x.article or not m.within) and (x.mark < 0 or x.mark < k and out[x.mark])]
            out.append(m.holds or (10 * sum(left) < m.text if m.within else greatest_window(left) < THRESHOLD))
    return out


def lines_of(html: str) -> list[Line]:
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    free = lifted(page.lines, page.marks)
    article = []
    for m in page.marks:
        article.append(m.article or m.parent >= 0 and article[m.parent])
    return [x if x.mark < 0 else x._replace(aside=x.aside or not free[x.mark], article=x.article or article[x.mark]) for x in page.lines]


def line_weights(lines: list[Line]) -> tuple[list[int], int]:
    """Weight of every line, and the threshold of a surge."""
    inside = sum(len(x.text) for x in lines if x.article and not x.aside)
    outside = sum(own(x) for x in lines if not x.article and not x.aside)
    marked = inside > 0 and 2 * inside >= outside
    if marked:
        return [len(x.text) if x.article and not x.aside else 0 for x in lines], 1
    return [0 if x.aside else own(x) for x in lines], THRESHOLD


def spans_between(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges from surge to dive."""
    padded = weights + [0] * (window - 1)
    sums = [sum(padded[i:i + window]) for i in range(len(weights))]
    if not sums or not max(sums):
        return []
    threshold = min(threshold, max(sums))
    out, i = [], 0
    while i < len(sums):
        if sums[i] >= threshold and weights[i]:
            end = i
            while end < len(sums) and sums[end]:
                end += 1
            out.append((i, end))
            i = end
        i += 1
    return out


def blocks(html: str) -> list[str]:
    """Text blocks of the main part, in page order."""
    lines = lines_of(html)
    weights, threshold = line_weights(lines)
    marked = threshold == 1
    return [lines[k].text for a, b in spans_between(weights, threshold) for k in range(a, b) if (weights[k] if marked else not lines[k].aside)]


def main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every page, its blocks joined by an empty line."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(blocks(h)) for h in htmls.fillna("")], dtype=object)

    return pages.withColumn(name, run(F.col(html)))
